"""URL filters: rules on host and path, and block decisions that redirects and canonical links pass on."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlake import materialize

from .components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Where a page names the address that it stands for, or sends the reader to. Group 1 is the address.
CANONICAL = r"""(?i)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
REFRESH = r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
HREF = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""
CONTENT_URL = r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)"""


class Rule(NamedTuple):
    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule whose host is the url's or a parent of it and whose path begins the url's; else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(rule.name)).otherwise(out)
    return out


def address(url: Column) -> Column:
    """One spelling for addresses that differ in scheme, host case or fragment only; null where there is no host."""
    tail = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    host = host_of(url)
    return F.when(host != "", F.concat(host, F.when(tail.startswith("/"), tail).otherwise(F.concat(F.lit("/"), tail))))


def _absolute(target: Column, url: Column) -> Column:
    """A link's address, resolved where it begins with ``//``, ``/`` or a scheme; null for other relative ones."""
    target = F.regexp_replace(target, "&amp;", "&")
    return (
        F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(F.lit("http://"), host_of(url), target))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """(source, target) addresses of every canonical link and redirect of the pages."""
    url, html = F.col("url"), F.col("html")
    links = F.concat(
        F.transform(F.regexp_extract_all(html, F.lit(CANONICAL), 0), lambda t: F.regexp_extract(t, HREF, 1)),
        F.transform(F.regexp_extract_all(html, F.lit(REFRESH), 0), lambda t: F.regexp_extract(t, CONTENT_URL, 1)),
    )
    found = pages.select(url, F.explode(links).alias("target")).where("target <> ''")
    found = found.select(address(url).alias("source"), address(_absolute(F.col("target"), url)).alias("target"))
    return found.where("source is not null and target is not null and source <> target").distinct()


def judge_urls(pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, alias_class.

    A rule that fits the page's own url decides. Every other page takes the decision of its class: pages
    that redirects or canonical links join, in any number of steps. A class is blocked if a url in it is
    blocked by a rule and none is allowed by one (an allowed alias comes first); a class without a rule
    gives ``default``. Link targets count with the rules that fit them even if no page has that url.

    Defined cases: a null url or one without ``://`` has an empty host and path, no rule and no links; a
    null html has no links; repeated rows are judged alike; an empty table gives an empty table; further
    columns are ignored. Only DataFrame expressions are used; pages are read twice, once for their links.
    """
    pages = pages.select("page_id", "url", "html")
    edges = materialize(link_edges(pages), "links")
    ends = edges.select(F.col("source").alias("address")).union(edges.select("target")).distinct()
    # Each address is numbered by its own hash; equal hashes of different addresses are told apart by the text.
    code = lambda c: F.sha2(c, 256)
    members = connected_components(edges.select(code("source").alias("a"), code("target").alias("b")))
    action = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.action)]) if rules else F.lit(None)
    nodes = ends.select(code("address").alias("node"), F.concat(F.lit("http://"), "address").alias("url"))
    ruled = nodes.join(members, "node").withColumn("rule", rule_of(host_of(F.col("url")), path_of(F.col("url")), rules))
    ruled = materialize(ruled.select("node", "component", (action[F.col("rule")] if rules else F.lit(None).cast("string")).alias("action")), "aliases")
    classes = ruled.groupBy("component").agg(F.max((F.col("action") == "block").cast("int")).alias("blocked"), F.max((F.col("action") == "allow").cast("int")).alias("allowed"))
    classes = materialize(classes.select("component", F.when(F.coalesce("allowed", F.lit(0)) == 1, "allow").when(F.coalesce("blocked", F.lit(0)) == 1, "block").otherwise(default).alias("decision")), "classes")
    aliases = materialize(ruled.join(classes, "component").select("node", "component", "decision"), "decisions")
    url = F.col("url")
    judged = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.coalesce(code(address(url)), F.concat(F.lit("#"), F.col("page_id").cast("string"))).alias("node"))
    judged = judged.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).join(aliases, "node", "left")
    verdict = F.coalesce(action[F.col("rule")], "decision", F.lit(default)) if rules else F.coalesce("decision", F.lit(default))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.col("component").alias("alias_class"))
