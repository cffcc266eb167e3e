"""Topic patterns as a trie in a table, walked one word a round by joins on (state, word).

A state is the text of the words so far, each after a dot, so the root is the empty text and a pattern's own
text names its end. ``*`` in a move stands for any word. Every state has at most one child a word, and a walk
follows a word and ``*`` only, so a round makes at most a few rows of each, however many patterns there are.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import merge_hashes
from ..session import materialize


class Trie(NamedTuple):
    """``moves`` (scope, state, word, next) and ``starts`` (scope, state) of the patterns of each scope."""

    scope: list[str]
    moves: DataFrame
    starts: DataFrame


def end_state(pattern: Column | str) -> Column:
    return F.concat(F.lit("."), merge_hashes(pattern))


def trie_of(patterns: DataFrame, scope: list[str], pattern: str = "pattern") -> Trie:
    """The trie of ``pattern`` within each ``scope``.

    ``#`` is a state of its own that any word leads back to; whoever arrives before it is in it as well,
    because it may stand for no word at all.
    """
    words = F.split(merge_hashes(pattern), r"\.")
    cut = patterns.where(F.col(pattern).isNotNull()).select(*scope, words.alias("words")).distinct().select(*scope, "words", F.posexplode("words").alias("i", "word"))
    before = F.array_join(F.transform(F.slice("words", F.lit(1), F.col("i")), lambda w: F.concat(F.lit("."), w)), "")
    edges = cut.select(*scope, before.alias("state"), "word").distinct().withColumn("next", F.concat("state", F.lit("."), "word"))
    edges = materialize(edges, "trie")
    hashes = edges.where("word = '#'").select(*scope, F.col("state").alias("next"), F.col("next").alias("hash"))
    plain = edges.where("word <> '#'")
    entered = plain.join(hashes, [*scope, "next"]).select(*scope, "state", "word", F.col("hash").alias("next"))
    loops = hashes.select(*scope, F.col("hash").alias("state"), F.lit("*").alias("word"), F.col("hash").alias("next"))
    moves = materialize(plain.unionByName(entered).unionByName(loops), "moves")
    roots = edges.select(*scope).distinct().withColumn("state", F.lit(""))
    starts = roots.unionByName(hashes.where("next = ''").select(*scope, F.col("hash").alias("state")))
    return Trie(scope, moves, materialize(starts, "starts"))


def walk(keys: DataFrame, trie: Trie, key: str = "routing_key") -> DataFrame:
    """(scope, key, state): the states in which each key of ``keys`` ends; a pattern covers it if its end is one.

    One round a word: a key in a state looks for its next word and for any word.
    """
    scope = trie.scope
    keys = materialize(keys.select(*scope, key).distinct(), "keys")
    words = F.split(key, r"\.")
    longest = keys.agg(F.max(F.size(words))).first()[0] or 0
    front, done = keys.join(trie.starts, scope), []
    for i in range(1, longest + 1):
        looked = front.where(F.size(words) >= i).select(*scope, key, "state", F.explode(F.array_distinct(F.array(F.element_at(words, i), F.lit("*")))).alias("word"))
        front = materialize(looked.join(trie.moves, [*scope, "state", "word"]).select(*scope, key, F.col("next").alias("state")).distinct(), "front")
        done.append(front.where(F.size(words) == i))
    out = keys.withColumn("state", F.lit("")).limit(0)
    for ended in done:
        out = out.unionByName(ended)
    return out


def meetings(left: Trie, right: Trie | None = None) -> DataFrame:
    """(scope, a, b): pairs of states that some common words lead to, so patterns ending there have a common key.

    Without ``right`` a trie is walked against itself, and each pair is listed with a <= b. Rounds go on until
    no pair is new.
    """
    scope, other = left.scope, right or left

    def pair(a: Column, b: Column) -> list[Column]:
        return [a.alias("a"), b.alias("b")] if right else [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    one = left.moves.select(*scope, F.col("state").alias("a"), F.col("word").alias("said"), F.col("next").alias("na"))
    two = other.moves.select(*scope, F.col("state").alias("b"), "word", F.col("next").alias("nb"))
    starts = left.starts.withColumnRenamed("state", "sa").join(other.starts.withColumnRenamed("state", "sb"), scope)
    front = materialize(starts.select(*scope, *pair(F.col("sa"), F.col("sb"))).distinct(), "pairs")
    seen = front
    while not front.isEmpty():
        moved = front.join(one, [*scope, "a"])
        named = moved.where("said <> '*'").select(*scope, "b", "na", F.explode(F.array("said", F.lit("*"))).alias("word")).join(two, [*scope, "b", "word"])
        any_ = moved.where("said = '*'").join(two, [*scope, "b"])
        grown = named.select(*scope, *pair(F.col("na"), F.col("nb"))).unionByName(any_.select(*scope, *pair(F.col("na"), F.col("nb")))).distinct()
        front = materialize(grown.join(seen, [*scope, "a", "b"], "left_anti"), "pairs")
        seen = seen.unionByName(front)
    return seen
