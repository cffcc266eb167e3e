"""Chat formatting: records of unlike layouts become canonical turns, and turns one marked text with a loss mask."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END, BREAK = "<|im_start|>", "<|im_end|>", "\n"
TURN = "struct<position:bigint,role:string,text:string>"


class Mapping(NamedTuple):
    """How one layout gives turns. ``paths`` is the layout: its nested field paths, arrays marked by ``[]``.

    Either ``items`` is the path of an array of messages with the fields ``role`` and ``text``; or ``role``
    and ``text`` are fields of a record that is one turn itself, placed by ``position``; or ``fixed`` lists
    (role, path) pairs, in order, of which absent ones are skipped.
    """

    paths: tuple[str, ...]
    items: str | None = None
    role: str | None = None
    text: str | None = None
    position: str | None = None
    fixed: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()


#: Public layouts of instruction and chat records. A caller may give others.
LAYOUTS = (
    Mapping(("role", "text", "turn"), role="role", text="text", position="turn"),
    Mapping(("messages[].content", "messages[].role"), items="messages", role="role", text="content"),
    Mapping(("conversations[].from", "conversations[].value"), items="conversations", role="from", text="value", roles=(("human", "user"), ("gpt", "assistant"))),
    Mapping(("instruction", "output"), fixed=(("user", "instruction"), ("assistant", "output"))),
    Mapping(("input", "instruction", "output"), fixed=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping(("completion", "prompt"), fixed=(("user", "prompt"), ("assistant", "completion"))),
    Mapping(("prompt", "response"), fixed=(("user", "prompt"), ("assistant", "response"))),
    Mapping(("prompt", "response", "system"), fixed=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
)


def layout_key(paths: tuple[str, ...]) -> Column:
    return F.sha2(F.lit("\n".join(sorted(set(paths)))), 256)


def schema_paths(record: Column, depth: int = 3) -> Column:
    """The sorted leaf paths of a variant's objects, down to ``depth`` levels; an array counts through its items."""

    def names(v: Column) -> Column:
        return F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))

    def leaves(v: Column, level: int) -> Column:
        fields = F.coalesce(names(v), F.array().cast("array<string>"))
        if level == depth:
            return F.transform(fields, lambda k: k)
        as_map = F.try_variant_get(v, "$", "map<string,variant>")

        def of(k: Column) -> Column:
            child = as_map[k]
            kind = F.schema_of_variant(child)
            items = F.coalesce(F.try_variant_get(child, "$", "array<variant>"), F.array().cast("array<variant>"))
            below = F.when(kind.startswith("OBJECT"), F.transform(leaves(child, level + 1), lambda x: F.concat(k, F.lit("."), x)))
            below = below.when(kind.startswith("ARRAY<OBJECT"), F.array_distinct(F.flatten(F.transform(items, lambda i: F.transform(leaves(i, level + 1), lambda x: F.concat(k, F.lit("[]."), x))))))
            return F.coalesce(below, F.array(k))

        return F.flatten(F.transform(fields, of))

    return F.array_sort(F.array_distinct(leaves(record, 1)))


def fingerprint(record: Column, ignore: tuple[str, ...] = (), depth: int = 3) -> Column:
    """SHA-256 of a record's field paths; members of ``ignore`` (ids, sources) don't count."""
    paths = schema_paths(record, depth)
    if ignore:
        paths = F.filter(paths, lambda p: ~F.regexp_extract(p, r"^[^.\[]*", 0).isin(*ignore))
    return F.sha2(F.array_join(paths, "\n"), 256)


def _text(record: Column, path: str) -> Column:
    return F.try_variant_get(record, "$." + path, "string")


def _turns(record: Column, m: Mapping) -> Column:
    def named(role: Column) -> Column:
        role = F.coalesce(role, F.lit(""))
        for old, new in m.roles:
            role = F.when(role == old, F.lit(new)).otherwise(role)
        return role

    def turn(position: Column, role: Column, text: Column) -> Column:
        return F.struct(position.cast("long").alias("position"), role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    if m.items:
        items = F.try_variant_get(record, "$." + m.items, "array<variant>")
        return F.transform(items, lambda v, i: turn(i, named(_text(v, m.role)), _text(v, m.text)))
    if m.fixed:
        turns = F.array(*[F.when(_text(record, path).isNotNull(), turn(F.lit(i), F.lit(role), _text(record, path))) for i, (role, path) in enumerate(m.fixed)])
        return F.filter(turns, lambda t: t.isNotNull())
    return F.array(turn(F.try_variant_get(record, "$." + m.position, "long"), named(_text(record, m.role)), _text(record, m.text)))


def canonical_turns(records: DataFrame, key: str, record: str, layouts: tuple[Mapping, ...] = LAYOUTS, ignore: tuple[str, ...] = (), levels: int = 2) -> DataFrame:
    """One row per turn (key, position, role, text), and one with layout null per record of an unknown layout.

    ``record`` is a variant column. Its field paths, ``levels`` deep, are hashed and the hash selects one of
    the declarative ``layouts``. Nothing is guessed: a record whose fingerprint is not listed keeps its row,
    with null position, role and text, so that nothing is lost silently.
    """
    v = F.col(f"`{record}`")
    tagged = records.select(F.col(f"`{key}`").alias("key"), v.alias("record"), fingerprint(v, ignore, levels).alias("layout"))
    turns, known = F.lit(None).cast(f"array<{TURN}>"), F.lit(False)
    for m in reversed(layouts):
        turns = F.when(F.col("layout") == layout_key(m.paths), _turns(F.col("record"), m)).otherwise(turns)
        known = known | (F.col("layout") == layout_key(m.paths))
    rows = tagged.select("key", F.when(known, F.col("layout")).alias("layout"), F.explode_outer(turns).alias("t"))
    return rows.select("key", "layout", "t.position", "t.role", "t.text")


def escape(text: Column) -> Column:
    """No control string is left in the result: every ``<``, backslashes, ``|`` gets one backslash more."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role stands on one line: a backslash is doubled and a line feed spelled out."""
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    parts = F.transform(F.split(role, r"\\\\"), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return unescape(F.array_join(parts, "\\"))


def format_chats(turns: DataFrame, learn_from: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per key: ``formatted``, the marked text, and ``loss``, (start, length) spans in code points.

    A turn is written ``<|im_start|>role``, line feed, text, ``<|im_end|>``, line feed. ``turns`` has key,
    position, role and text; turns are ordered by position (null first), then role, then text, so repeated
    rows and ties have one defined order. The spans cover the escaped texts of the roles in ``learn_from``.

    Defined cases: null text or role is empty; an empty text gives an empty span; control strings in texts
    and roles are escaped and come back; a conversation is one row of the result, so one task must hold its
    text, while its turns are sorted and added up as a stream; an empty table gives an empty table.
    """
    from pyspark.sql import Window

    rows = turns.select("key", "position", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit(BREAK))
    rows = rows.withColumn("head", head).withColumn("body", escape(F.col("text")))
    piece = F.concat("head", "body", F.lit(END + BREAK))
    order = Window.partitionBy("key").orderBy("position", "role", "text")
    rows = rows.withColumn("piece", piece).withColumn("before", F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("place", F.row_number().over(order))
    start = F.coalesce("before", F.lit(0)) + F.length("head")
    span = F.when(F.col("role").isin(*learn_from), F.struct(F.col("place"), start.cast("long").alias("start"), F.length("body").cast("long").alias("length")))
    made = rows.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "piece"))).alias("pieces"), F.sort_array(F.collect_list(span)).alias("spans"))
    return made.select(
        "key",
        F.array_join(F.col("pieces.piece"), "").alias("formatted"),
        F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))).alias("loss"),
    )


def read_chats(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text, unescaped, in order."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")

    def turn(piece: Column) -> Column:
        inner = F.substring(piece, F.lit(len(START) + 1), F.length(piece))
        cut = F.instr(inner, "\n")
        return F.struct(unescape_role(F.substring(inner, F.lit(1), cut - 1)).alias("role"), unescape(F.substring(inner, cut + 1, F.length(inner))).alias("text"))

    return F.transform(pieces, turn)


def learned_text(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped: each span in order, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
