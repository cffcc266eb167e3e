"""Column functions, all built from native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..wire import Wire

# Patterns of names and labels.
SUBJECT_PATTERN = r"^[A-Za-z0-9_]+(\.[A-Za-z0-9_]+)*\z"
SCHEMA_ID_PATTERN = r"^[0-9a-f]{32}\z"
SEMVER_PATTERN = (
    r"^[0-9]+\.[0-9]+\.[0-9]+"
    r"(-(0|[1-9][0-9]*|[0-9]*[A-Za-z-][0-9A-Za-z-]*)"
    r"(\.(0|[1-9][0-9]*|[0-9]*[A-Za-z-][0-9A-Za-z-]*))*)?\z"
)
SUBJECT_MAX = 512
WHITESPACE = r"[\s\x0B\x{85}\p{Z}]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pack_id(c: Column | str) -> Column:
    """A schema id as bytes, half as long, to shuffle and join by; any other text becomes longer than an id's 16 bytes."""
    c = _col(c)
    return F.when(c.rlike(SCHEMA_ID_PATTERN), F.unhex(c)).otherwise(F.concat(F.lit(bytes(17)), c.cast("binary")))


def unpack_id(c: Column | str) -> Column:
    """The text of a packed id."""
    c = _col(c)
    return F.when(F.octet_length(c) == 16, F.lower(F.hex(c))).otherwise(F.substring(c, 18, 1 << 30).cast("string"))


def strip(c: Column | str) -> Column:
    """Trim every Unicode white space character, not only blanks."""
    return F.regexp_replace(_col(c), rf"^{WHITESPACE}+|{WHITESPACE}+\z", "")


def blank(c: Column | str) -> Column:
    c = _col(c)
    return c.isNull() | (strip(c) == "")


def to_int32(c: Column | str) -> Column:
    """Digits only, within 32 bits; anything else is null."""
    c = _col(c)
    return F.when(c.rlike(r"^[0-9]+\z"), c.try_cast("int"))


def utf16_length(c: Column | str) -> Column:
    """Length in UTF-16 code units: a supplementary character counts twice."""
    c = _col(c)
    return F.length(c) + F.length(c) - F.length(F.regexp_replace(c, r"[\x{10000}-\x{10FFFF}]", ""))


def utf16_clamp(c: Column | str, limit: int) -> Column:
    """First ``limit`` UTF-16 code units, never ending on half a character."""
    c = _col(c)
    marked = F.regexp_replace(c, r"([\x{10000}-\x{10FFFF}])", "$1\u0000")
    cut = F.regexp_replace(
        F.regexp_replace(F.substring(marked, 1, limit), r"[\x{10000}-\x{10FFFF}]\z", ""), "\u0000", ""
    )
    return F.when(F.length(c) * 2 <= limit, c).when(utf16_length(c) <= limit, c).otherwise(cut)


def subject_valid(c: Column | str) -> Column:
    """True when the trimmed text is a subject name."""
    t = strip(c)
    return F.coalesce((F.length(t) <= SUBJECT_MAX) & t.rlike(SUBJECT_PATTERN), F.lit(False))


def normalize_subject(c: Column | str) -> Column:
    """Message type to subject text for plain type names (no closed generics)."""
    t = strip(c)
    head = strip(F.regexp_replace(t, r"(?s),.*\z", ""))
    return F.coalesce(F.translate(head, "+:", ".."), F.lit(""))


def is_generic_type(c: Column | str) -> Column:
    """A backtick before the first bracket: the generic spelling the text kernel handles."""
    c = _col(c)
    tick, bracket = F.locate("`", c), F.locate("[", c)
    return (tick > 0) & (bracket > tick)


def generic_subject(c: Column | str) -> Column:
    """Message type to subject text for closed generics: ``Outer`1[[Arg, Assembly]]`` is ``Outer_of_Arg``.

    The innermost spelling is rewritten first, again and again: a bracketed argument becomes its name, the
    arguments of a list are joined with ``_and_``, and a list without brackets inside closes its type. What
    doesn't close is treated as a plain name.
    """
    text = strip(c)
    here = "\u0001"  # marks an argument, so that an empty one counts

    def round_(acc: Column, _: Column) -> Column:
        acc = F.regexp_replace(acc, r"([\[,])\s*\[\s*([^\[\]`,]*?)\s*(?:,[^\[\]`]*)?\]\s*(?=[,\]])", f"$1$2{here}")
        acc = F.regexp_replace(acc, r"(`[^`\[\]]*\[[^\[\]`]+),\]", "$1]")
        acc = F.regexp_replace(acc, r"(`[^`\[\]]*\[[^\[\]`,]*?)\s*,\s*([^\[\]`]*\])", f"$1{here}_and_$2")
        return F.regexp_replace(acc, r"\s*`[^`\[\],]*\[\s*([^\[\]`,]+?)\s*\](?:[^,\[\]]|\[\s*\])*", "_of_$1")

    rounds = F.sequence(F.lit(1), F.length(text) - F.length(F.translate(text, "[,", "")) + 1)
    spelled = F.aggregate(rounds, text, round_)
    closed = is_generic_type(text) & ~spelled.rlike(r"[`\[\]]")
    return normalize_subject(F.when(closed, F.replace(spelled, F.lit(here), F.lit(""))).otherwise(text))


def parse_selector(c: Column | str) -> Column:
    """``latest`` | ``N`` | ``>=N`` to ``struct(kind, ordinal)``; null when not a selector."""
    t = strip(c)
    pinned = to_int32(t)
    floor = F.when(F.startswith(t, F.lit(">=")), to_int32(strip(F.substr(t, F.lit(3)))))
    kind = (
        F.when(F.lower(t) == "latest", F.lit("latest"))
        .when(pinned >= 1, F.lit("pinned"))
        .when(floor >= 1, F.lit("range"))
    )
    value = F.when(kind == "pinned", pinned).when(kind == "range", floor)
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), value.alias("ordinal")))


def selector_accepts(selector: Column, ordinal: Column, latest: Column) -> Column:
    """Does a parsed selector accept ``ordinal`` while the subject's tip is ``latest``?"""
    return F.coalesce(
        F.when(selector["kind"] == "latest", latest == ordinal)
        .when(selector["kind"] == "pinned", selector["ordinal"] == ordinal)
        .when(selector["kind"] == "range", ordinal >= selector["ordinal"]),
        F.lit(False),
    )


def semver_valid(c: Column | str) -> Column:
    """A release or pre-release label whose three numbers fit 32 bits and that has no build part."""
    t = strip(c)
    core = F.split(F.regexp_extract(t, r"^([0-9]+\.[0-9]+\.[0-9]+)", 1), r"\.")
    fits = F.forall(core, lambda x: x.try_cast("int").isNotNull())
    return F.coalesce(t.rlike(SEMVER_PATTERN) & fits, F.lit(False))


def semver_key(c: Column | str) -> Column:
    """A struct whose order is semantic-version precedence; null for an invalid label.

    ``is_release`` puts every pre-release before its release; an identifier that is a number sorts
    before text, and a shorter list that is a prefix sorts first, as arrays already do.
    """
    t = strip(c)
    part = lambda i: F.regexp_extract(t, r"^([0-9]+)\.([0-9]+)\.([0-9]+)", i).try_cast("int")
    pre = F.regexp_extract(t, r"(?s)^[0-9.]+-(.*)\z", 1)

    def identifier(x: Column) -> Column:
        number = to_int32(x)
        return F.struct(
            number.isNull().alias("is_text"),
            F.coalesce(number, F.lit(0)).alias("num"),
            F.when(number.isNull(), x).otherwise(F.lit("")).alias("text"),
        )

    return F.when(
        semver_valid(t),
        F.struct(
            part(1).alias("major"),
            part(2).alias("minor"),
            part(3).alias("patch"),
            (pre == "").alias("is_release"),
            F.transform(F.split(pre, r"\."), identifier).alias("pre"),
        ),
    )


def json_pointer_escape(c: Column | str) -> Column:
    return F.replace(F.replace(_col(c), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def merge_hashes(pattern: Column | str) -> Column:
    """Runs of ``#`` mean the same as one."""
    return F.regexp_replace(_col(pattern), r"(?<![^.])#(\.#)+(?![^.])", "#")


def topic_regex(pattern: Column | str) -> Column:
    """Topic pattern to a regular expression over ``'.' || routing_key``.

    Runs of ``#`` are merged so that matching cannot backtrack through several adjacent stars.
    """
    merged = merge_hashes(pattern)
    word = lambda w: (
        F.when(w == "#", F.lit(r"(?:\.[^.]*)*"))
        .when(w == "*", F.lit(r"\.[^.]*"))
        .otherwise(F.concat(F.lit(r"\.\Q"), w, F.lit(r"\E")))
    )
    return F.concat(
        F.lit("^"), F.array_join(F.transform(F.split(merged, r"\."), word), ""), F.lit(r"\z")
    )


def has_wildcard_word(key: Column | str) -> Column:
    return _col(key).rlike(r"(?<![^.])[*#](?![^.])")


def topic_matches(pattern: Column | str, key: Column | str) -> Column:
    """Does a topic pattern match a routing key? For one pattern or a few; many are walked as a trie
    (``operators.topics``), which also matches keys that hold a word ``*`` or ``#``, as patterns in their own
    right."""
    dotted = F.concat(F.lit("."), _col(key))
    return F.call_function("rlike", dotted, topic_regex(pattern))


def schema_id(format: Column, canonical: Column, references: Column, wire: Wire = Wire()) -> Column:
    """Content-addressed id: the first 16 bytes of SHA-256 over a length-framed preimage."""

    def framed(label: str, value: Column) -> Column:
        size = F.octet_length(value).cast("string")
        return F.concat(F.lit(label + ":"), size, F.lit(":"), value, F.lit("\n"))

    empty = F.array().cast("array<struct<name:string,subject:string,version:int>>")
    refs = F.array_sort(F.coalesce(references, empty))
    lines = F.transform(
        refs,
        lambda r: F.concat(
            framed("ref-name", r["name"]),
            framed("ref-subject", r["subject"]),
            F.lit("ref-version:"),
            r["version"].cast("string"),
            F.lit("\n"),
        ),
    )
    preimage = F.concat(
        F.lit(wire.preimage + "\nformat:"),
        format,
        F.lit("\n"),
        framed("body", canonical),
        F.lit("refs:"),
        F.size(refs).cast("string"),
        F.lit("\n"),
        F.array_join(lines, ""),
    )
    return F.substring(F.sha2(preimage, 256), 1, 32)


def violation_fingerprint(
    environment: Column, side: Column, route: Column, subject: Column, code: Column
) -> Column:
    """Identity of a violation; side is written as its number, a missing subject as ``-``."""
    number = F.when(side == "PUBLISH", F.lit("1")).when(side == "CONSUME", F.lit("2"))
    return F.concat_ws("|", environment, number, route, F.coalesce(subject, F.lit("-")), code)
