"""Flush windows of reporters as a running job: counted in state, flushed when the watermark passes."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KEY = ["side", "route", "subject", "code", "detail"]
PLACE = ["window_start", "window_end", "reporter", "share"]
PARTIAL = (
    "window_start timestamp, window_end timestamp, reporter string, share int, "
    "side string, route string, subject string, code string, detail string, n bigint, ts timestamp, message_id bigint"
)
FLUSHED = "window_start timestamp, reporter string, side string, route string, subject string, code string, detail string, n bigint, kind string"
#: Rows of one output batch.
ROWS = 2048
#: A window's keys are kept in so many buckets by their hash, and a flush adds up one bucket after the other.
BUCKETS = 16


def _partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per key and Arrow batch with its count and first arrival."""
    by = [*PLACE, *KEY]
    for pdf in batches:
        first = pdf.sort_values(["ts", "message_id"]).drop_duplicates(by).set_index(by)[["ts", "message_id"]]
        counted = pdf.groupby(by, dropna=False, sort=False).size().rename("n")
        yield first.join(counted).reset_index()[[*by, "n", "ts", "message_id"]]


def _text(value: object) -> str | None:
    return None if pd.isna(value) else value


def _bucket(at: list[str | None]) -> int:
    return zlib.crc32(json.dumps(at).encode()) % BUCKETS


class FlushWindow(StatefulProcessor):
    """Counts of one window's keys until its end lies before the watermark; then they are given out and forgotten.

    With ``keys``, later new keys are only counted. What comes after the flush is given out at once as ``late``.
    Without it no key has to be found again before the flush, so what arrives is kept as it came, one entry of
    state a bucket and Arrow batch and not one a key; entries are added up when the window is given out.
    """

    def __init__(self, keys: int | None = None) -> None:
        self.keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "side string, route string, subject string, code string, detail string", "n bigint")
        self.totals = handle.getValueState("totals", "keys bigint, dropped bigint")
        self.parts = handle.getMapState("parts", "bucket int, part bigint", "rows string")
        self.held = handle.getValueState("held", "parts bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start, end, reporter, _ = key
        ends = int(pd.Timestamp(end, tz="UTC").timestamp() * 1000) if pd.Timestamp(end).tzinfo is None else int(pd.Timestamp(end).timestamp() * 1000)
        if ends <= timerValues.getCurrentWatermarkInMs():
            for pdf in rows:
                late = pdf.assign(window_start=start, reporter=reporter, kind="late")
                yield late[_names(FLUSHED)]
            return
        if self.keys is None:
            self._keep(rows, ends)
            return
        known, dropped = self.totals.get() if self.totals.exists() else (0, 0)
        if not self.totals.exists():
            self.handle.registerTimer(ends)
        # Only a limit of keys makes the order of arrival matter, and then state is bounded by it.
        for *parts, n in pd.concat(list(rows)).sort_values(["ts", "message_id"])[[*KEY, "n"]].itertuples(index=False, name=None):
            at = tuple(_text(p) for p in parts)
            if self.counts.containsKey(at):
                self.counts.updateValue(at, (self.counts.getValue(at)[0] + int(n),))
            elif known < self.keys:
                self.counts.updateValue(at, (int(n),))
                known += 1
            else:
                dropped += int(n)
        self.totals.update((known, dropped))
        yield from ()

    def _keep(self, rows: Iterator[pd.DataFrame], ends: int) -> None:
        if self.held.exists():
            n_parts = self.held.get()[0]
        else:
            n_parts = 0
            self.handle.registerTimer(ends)
        for pdf in rows:
            buckets: dict[int, list] = {}
            for *parts, n in pdf[[*KEY, "n"]].itertuples(index=False, name=None):
                at = [_text(p) for p in parts]
                buckets.setdefault(_bucket(at), []).append([*at, int(n)])
            for bucket, held in buckets.items():
                self.parts.updateValue((bucket, n_parts), (json.dumps(held),))
            n_parts += 1
        self.held.update((n_parts,))

    def _added(self) -> Iterator[tuple]:
        """(key, n) of the window, by buckets."""
        n_parts = self.held.get()[0]
        for bucket in range(BUCKETS):
            sums: dict[tuple, int] = {}
            for part in range(n_parts):
                if held := self.parts.getValue((bucket, part)):
                    for *at, n in json.loads(held[0]):
                        sums[tuple(at)] = sums.get(tuple(at), 0) + n
            yield from sums.items()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start, _, reporter, _ = key
        held: list[tuple] = []
        for at, n in self._added() if self.keys is None else ((at, n[0]) for at, n in self.counts.iterator()):
            held.append((start, reporter, *at, n, "kept"))
            if len(held) == ROWS:
                yield pd.DataFrame(held, columns=_names(FLUSHED))
                held = []
        dropped = 0 if self.keys is None else self.totals.get()[1]
        if dropped:
            held.append((start, reporter, *[None] * len(KEY), dropped, "dropped"))
        if held:
            yield pd.DataFrame(held, columns=_names(FLUSHED))
        for state in (self.parts, self.held) if self.keys is None else (self.counts, self.totals):
            state.clear()

    def close(self) -> None:
        pass


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def stream_flush_windows(decisions: DataFrame, every: str, lateness: str, reporter: str = "reported_by",
                         keys: int | None = None, shares: int = 64) -> DataFrame:
    """A stream of flushes (output mode ``append``): window_start, reporter, the key, n and ``kind``.

    ``kept``: a key's count in a window, once, when the watermark (``lateness`` behind the newest message) has
    passed the window's end; its state ends there. ``late``: messages that came after that, given out in the
    batch that they came in. ``dropped``: with ``keys``, how many messages of a reporter's window belonged to
    keys beyond the first that many; order of arrival is that of batches, then of (ts, message_id).

    Sums over ``kept`` and ``late`` are what :func:`violations.violation_flush_windows` counts in closed
    windows, however the messages were spread over batches and restarts. Messages are combined before they
    are shuffled. Without ``keys`` a window's keys are dealt to ``shares`` groups, so a reporter with a third
    of all messages doesn't hold one task; with it a window is one group of at most that many keys.
    Messages without ``ts`` belong to no window and are left out.
    """
    dealt = F.lit(0) if keys is not None else F.pmod(F.xxhash64(*KEY), F.lit(shares)).cast("int")
    window = F.window("ts", every)
    placed = decisions.where("ts is not null").withWatermark("ts", lateness).select(
        window["start"].alias("window_start"), window["end"].alias("window_end"), F.col(reporter).alias("reporter"),
        dealt.alias("share"), *KEY, "ts", "message_id",
    )
    partial = placed.mapInPandas(_partials, PARTIAL)
    return partial.groupBy(*PLACE).transformWithStateInPandas(
        statefulProcessor=FlushWindow(keys), outputStructType=FLUSHED, outputMode="Append", timeMode="EventTime"
    )
