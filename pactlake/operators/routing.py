"""Contracts: which bindings govern a route, and which bindings contradict each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import has_wildcard_word, parse_selector, strip
from ..session import materialize
from .topics import end_state, meetings, trie_of, walk

ROUTE = ["broker_id", "virtual_host", "exchange", "routing_key"]
QUEUE = ["broker_id", "virtual_host", "queue"]


def routes_of(messages: DataFrame, key: list[str] = ROUTE) -> DataFrame:
    """Rewrite route columns to the form bindings are compared in: no nulls, ``/`` for no host."""
    out = messages
    for c in key:
        blank_value = "/" if c == "virtual_host" else ""
        value = F.when(strip(c) == "", None).otherwise(strip(c)) if c == "virtual_host" else F.col(c)
        out = out.withColumn(c, F.coalesce(value, F.lit(blank_value)))
    return out


def selector_text(selector: Column) -> Column:
    """One spelling per selector."""
    return (
        F.when(selector["kind"] == "latest", F.lit("latest"))
        .when(selector["kind"] == "pinned", selector["ordinal"].cast("string"))
        .otherwise(F.concat(F.lit(">="), selector["ordinal"].cast("string")))
    )


def _refs(subjects: Column) -> Column:
    return F.transform(
        subjects,
        lambda r: F.struct(r["subject"].alias("subject"), selector_text(parse_selector(r["selector"])).alias("selector")),
    )


def topic_match_join(routes: DataFrame, bindings: DataFrame) -> DataFrame:
    """Distinct routes x publish bindings that cover them.

    The patterns of a host and exchange are a trie, which the distinct keys walk word by word; a key that
    holds a word ``*`` or ``#`` is a pattern itself, and the tries of both are walked together.
    """
    distinct = materialize(routes_of(routes).select(*ROUTE).distinct(), "routes")
    b = bindings.withColumn("bound_broker", F.col("broker_id")).drop("broker_id").withColumn("state", end_state("pattern"))
    place = ["virtual_host", "exchange"]
    trie = trie_of(bindings, place)
    wild = has_wildcard_word("routing_key")
    covered = walk(distinct.where(~wild), trie)
    odd = distinct.where(wild).select(*place, "routing_key").distinct()
    if not odd.isEmpty():
        met = meetings(trie_of(odd, place, "routing_key"), trie)
        ends = odd.withColumn("a", end_state("routing_key"))
        covered = covered.unionByName(ends.join(met, [*place, "a"]).select(*place, "routing_key", F.col("b").alias("state")))
    scope = F.col("bound_broker").isNull() | (F.col("bound_broker") == F.col("broker_id"))
    found = materialize(covered, "covered").join(b, [*place, "state"]).join(distinct, [*place, "routing_key"]).where(scope)
    return found.select(*ROUTE, *[c for c in b.columns if c not in (*ROUTE, "state")])


def _combine(matched: DataFrame, contracts: DataFrame, key: list[str], rank: Column) -> DataFrame:
    """Per contract the best-ranked binding; per route the contracts in name order, the strictest
    mode and the distinct subjects in that order."""
    best = matched.groupBy(*key, "contract").agg(
        F.min(F.struct(rank.alias("rank"), F.col("seq"), F.col("subjects"))).alias("best")
    )
    named = best.join(contracts.select("contract", "enforcement"), "contract")
    entry = F.struct("contract", "enforcement", _refs(F.col("best.subjects")).alias("refs"))
    combined = named.groupBy(*key).agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    return combined.select(
        *key,
        F.transform("entries", lambda e: e["contract"]).alias("contracts"),
        F.array_max(F.transform("entries", lambda e: e["enforcement"])).alias("enforcement"),
        F.array_distinct(F.flatten(F.transform("entries", lambda e: e["refs"]))).alias("subjects"),
    )


def resolve_publish(routes: DataFrame, contracts: DataFrame, bindings: DataFrame) -> DataFrame:
    """Governed routes: (route, contracts, enforcement, subjects). Other routes are ungoverned."""
    matched = topic_match_join(routes, bindings)
    return _combine(matched, contracts, ROUTE, -F.coalesce("precedence", F.lit(0)))


def resolve_consume(queues: DataFrame, contracts: DataFrame, bindings: DataFrame) -> DataFrame:
    """Governed queues: the first covering binding of each contract, combined as for routes."""
    distinct = routes_of(queues, QUEUE).select(*QUEUE).where("queue <> ''").distinct()
    b = bindings.withColumn("bound_broker", F.col("broker_id")).drop("broker_id")
    covers = F.col("bound_broker").isNull() | (F.col("bound_broker") == F.col("broker_id"))
    matched = distinct.join(b, ["virtual_host", "queue"]).where(covers)
    return _combine(matched, contracts, QUEUE, F.lit(0))


def route_ambiguity(routes: DataFrame, resolved: DataFrame, key: list[str] = ROUTE) -> DataFrame:
    """Counts of governed, ambiguous (several contracts) and ungoverned routes."""
    distinct = routes_of(routes, key).select(*key).distinct()
    n = F.coalesce(F.size("contracts"), F.lit(0))
    return distinct.join(resolved, key, "left").agg(
        F.count("*").alias("routes"),
        F.count_if(n > 0).alias("governed"),
        F.count_if(n > 1).alias("ambiguous"),
        F.count_if(n <= 0).alias("ungoverned"),
    )


def _first_clash(bindings: DataFrame, place: list[str]) -> DataFrame:
    """For each of ``bindings`` (contract, place, seq, broker_id, precedence, subjects, pattern) the earliest
    binding before it in its contract that it contradicts: one row per binding at most.

    Two contradict if their patterns have a common key, their brokers may be the same, their precedences are
    equal or one has none, and their subjects differ. Where a pattern ends, only two bindings matter of each
    broker and precedence: the earliest, and the earliest with other subjects. Whoever meets that end takes the
    one that differs, so bindings are never paired.
    """
    scope = ["contract", *place]
    traits = ["broker_id", "precedence", "subjects"]
    ended = bindings.where("subjects is not null").withColumn("state", end_state("pattern"))
    classes = materialize(ended.groupBy(*scope, "state", *traits).agg(F.min("seq").alias("seq")), "classes")

    def exact(c: str) -> Column:
        return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("none"))

    def wanted(c: str) -> Column:
        return F.when(F.col(c).isNull(), F.array(F.lit("any"))).otherwise(F.array(exact(c), F.lit("none")))

    def keyed(df: DataFrame, broker: Column, precedence: Column) -> DataFrame:
        return df.withColumn("broker", F.explode(broker)).withColumn("level", F.explode(precedence))

    told = keyed(classes, F.array(exact("broker_id"), F.lit("any")), F.array(exact("precedence"), F.lit("any")))
    slot = [*scope, "state", "broker", "level"]
    told = told.groupBy(*slot, "subjects").agg(F.min("seq").alias("seq"))
    order = Window.partitionBy(*slot).orderBy("seq")
    two = told.withColumn("nth", F.row_number().over(order)).where("nth <= 2")
    ends = materialize(two.select(*scope, F.col("state").alias("end"), "broker", "level", F.col("subjects").alias("theirs"), F.col("seq").alias("clash")), "ends")

    met = meetings(trie_of(classes.withColumn("pattern", F.substring("state", 2, 1 << 20)), scope))
    met = met.select(*scope, F.col("a").alias("state"), F.col("b").alias("end")).unionByName(met.where("a <> b").select(*scope, F.col("b").alias("state"), F.col("a").alias("end")))
    met = met.join(ends.select(*scope, "end").distinct(), [*scope, "end"], "left_semi")
    asked = keyed(classes.drop("seq").join(met, [*scope, "state"]), wanted("broker_id"), wanted("precedence"))
    first = asked.join(ends, [*scope, "end", "broker", "level"]).where("theirs <> subjects").groupBy(*scope, "state", *traits).agg(F.min("clash").alias("clash"))
    b, f = ended.alias("b"), materialize(first, "clashes").alias("f")
    same = F.lit(True)
    for c in (*scope, "state", *traits):
        same = same & F.col(f"b.{c}").eqNullSafe(F.col(f"f.{c}"))
    return b.join(f, same & (F.col("f.clash") < F.col("b.seq"))).select("b.contract", *[f"b.{c}" for c in place], "b.seq", "f.clash")


def binding_conflicts(publish: DataFrame, consume: DataFrame) -> DataFrame:
    """Bindings that give other subjects to messages an earlier binding of the contract covers:
    (contract, side, virtual_host, address, seq, clashes_with)."""
    subjects = F.array_sort(_refs(F.col("subjects"))).alias("subjects")
    pub = publish.select("contract", "seq", "virtual_host", "exchange", "broker_id", "pattern", "precedence", subjects)
    # A queue is one address: all its bindings end alike.
    con = consume.select("contract", "seq", "virtual_host", "queue", "broker_id", F.lit("").alias("pattern"), F.lit(None).cast("int").alias("precedence"), subjects)
    shape = lambda df, side, address: df.select(
        "contract", F.lit(side).alias("side"), "virtual_host", F.col(address).alias("address"), "seq",
        F.col("clash").alias("clashes_with"),
    )
    by_pattern, by_queue = _first_clash(pub, ["virtual_host", "exchange"]), _first_clash(con, ["virtual_host", "queue"])
    return shape(by_pattern, "publish", "exchange").unionByName(shape(by_queue, "consume", "queue"))
