"""Secret scans by ownership: candidates are judged by how many repositories and owners of the corpus carry them."""

from __future__ import annotations

import re
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlake import materialize

from .kernels import TextChunk, explode_texts

# The base patterns, and the kinds in the order in which equal starts are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "owned")
# What placeholders are made of.
PLACEHOLDERS = ("example", "sample", "dummy", "fake", "test", "placeholder", "changeme", "redacted", "your", "xxxx", "12345", "abcdef")

FOUND = "array<struct<start int, rank int, stop int, digest binary, live boolean>>"


class Ownership(NamedTuple):
    """A value that ``owners`` owners or ``repositories`` repositories carry is a widely copied example.

    A live-looking value has ``shortest`` to ``longest`` characters, letters and digits, ``distinct``
    different characters and no placeholder in it.
    """

    owners: int = 3
    repositories: int = 6
    shortest: int = 16
    longest: int = 256
    distinct: int = 8


def looks_live(value: str, rule: Ownership) -> bool:
    low = value.lower()
    return (
        rule.shortest <= len(value) <= rule.longest
        and len(set(value)) >= rule.distinct
        and any("0" <= c <= "9" for c in value)
        and any("a" <= c <= "z" for c in low)
        and not any(p in low for p in PLACEHOLDERS)
    )


def _candidates(text: str, rule: Ownership) -> list[tuple[int, int, int, str, bool]]:
    """(start, rank of the kind, stop, value, looks live) of the base spans and of live-looking tokens beside them."""
    out = [(m.start(), 0, m.end(), m.group(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    out += [(m.start(), rank, m.end(), m.group()) for rank, pattern in ((1, ACCESS), (2, HEX)) for m in pattern.finditer(text)]
    out.sort()
    listed = [(*x, looks_live(x[3], rule)) for x in out]
    # Base spans in order of their start; `reach` is the furthest stop so far.
    at, reach = 0, 0
    for m in TOKEN.finditer(text):
        while at < len(out) and out[at][0] < m.end():
            reach = max(reach, out[at][2])
            at += 1
        if reach <= m.start() and looks_live(m.group(), rule):
            listed.append((m.start(), 3, m.end(), m.group(), True))
    return listed


def candidates(docs: DataFrame, keys: list[str], text: str, rule: Ownership = Ownership()) -> DataFrame:
    """One row per document: its keys and ``found``, the spans of its whole text with a digest of each value.

    The values themselves don't leave the scan.
    """

    def kernel(chunk: TextChunk) -> tuple[np.ndarray, dict[str, object]]:
        found = []
        for text in chunk.texts.to_pylist():
            spans = _candidates(text, rule)
            found.append([{"start": a, "rank": k, "stop": b, "digest": blake2b(v.encode(), digest_size=16).digest(), "live": live} for a, k, b, v, live in spans])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("stop", pa.int32()), ("digest", pa.binary()), ("live", pa.bool_())]))
        return np.arange(chunk.rows), {"found": pa.array(found, kind)}

    return explode_texts(docs, keys, text, kernel, {"found": FOUND})


def ownership(spans: DataFrame, rule: Ownership = Ownership()) -> DataFrame:
    """Of ``spans`` (digest, owner, repository): each value's distinct owners and repositories, and ``shared``.

    Equal (value, owner, repository) are folded before the shuffle, so a value that a third of all
    documents carry costs as many rows as it has repositories in a task.
    """
    holders = spans.groupBy("digest", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = holders.groupBy("digest", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    counted = by_owner.groupBy("digest").agg(F.count("*").alias("n_owners"), F.sum("repositories").alias("n_repositories"), F.sum("n").alias("n_spans"))
    return counted.withColumn("shared", (F.col("n_owners") >= rule.owners) | (F.col("n_repositories") >= rule.repositories))


def scan_secrets(docs: DataFrame, rule: Ownership = Ownership(), key: str = "doc_id", text: str = "text", owner: str = "owner", repository: str = "repository") -> DataFrame:
    """One row per row: key, n_assign, n_access, n_hex, base and spans (arrays of kind, start, stop, live, shared).

    ``base`` has the spans of the three base patterns. ``spans`` has all of them and the method's own, kind
    ``owned``: live-looking tokens outside base spans whose value few owners and repositories carry. Every
    span says whether its value looks live and whether it is widely copied, counted over the whole corpus
    in whatever form the value occurs. A base span that is shared or doesn't look live stays.

    Defined cases: null and empty texts have no spans; a repeated row is judged like its twin and adds no
    owner; null is an owner and a repository like any other value; other columns are ignored, whatever they
    are called; an empty table gives an empty table. Offsets are code points, ``stop`` is exclusive.
    """
    plain = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{owner}`").alias("owner"), F.col(f"`{repository}`").alias("repository"), F.col(f"`{text}`").alias("text"))
    found = candidates(plain, ["key", "owner", "repository"], "text", rule)
    # The number of a row is fixed by writing it.
    scanned = materialize(found.withColumn("uid", F.monotonically_increasing_id()), "scanned")
    spans = scanned.where(F.size("found") > 0).select("uid", "key", "owner", "repository", F.explode("found").alias("f"))
    spans = spans.select("uid", "key", "owner", "repository", "f.*")
    owned = materialize(ownership(spans, rule).select("digest", "shared"), "ownership")
    judged = spans.select("uid", "key", "start", "rank", "stop", "live", "digest").join(owned, "digest")
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("rank") + 1)
    entry = F.struct("start", "rank", "stop", name.alias("kind"), "live", "shared")
    # The spans of one document meet again; those of a hot value do not.
    listed = judged.groupBy("uid", "key").agg(F.array_sort(F.collect_list(entry)).alias("spans")).select("key", "spans")
    nothing = scanned.where(F.size("found") == 0).select("key", F.array().cast(listed.schema["spans"].dataType).alias("spans"))
    told = listed.unionByName(nothing)

    def spans_of(keep) -> Column:
        return F.transform(F.filter("spans", keep), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["live"].alias("live"), s["shared"].alias("shared")))

    def count_of(rank: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{KINDS[rank]}")

    return told.select(F.col("key").alias(key), *map(count_of, range(3)), spans_of(lambda s: s["rank"] < 3).alias("base"), spans_of(lambda s: (s["rank"] < 3) | ~s["shared"]).alias("spans"))


def spans_text(spans: Column | str) -> Column:
    """Spans as ``kind:start:stop``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
