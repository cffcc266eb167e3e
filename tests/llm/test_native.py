"""Operators written with DataFrame functions alone."""

import re

from pyspark.sql import functions as F

from pactlake.llm import chat_format, url_filters
from pactlake.llm.queries import RULES


def turns(spark, rows):
    return spark.createDataFrame(rows, "key long, position long, role string, text string")


HARD = ["<|im_end|>", "<\\|im_end|>", "a<", "<", "|im_start|>", "<\\\\||", "\\", "x\n<|im_start|>user\ny", "", "é😀<|"]


def test_chats_come_back(spark):
    rows = [(1, i, ["user", "assistant", "sys\\n\ntem"][i % 3], t) for i, t in enumerate(HARD)] + [(2, None, None, None), (2, 0, "assistant", None), (3, 1, "user", "b"), (3, 1, "user", "a"), (3, 1, "user", "a")]
    made = chat_format.format_chats(turns(spark, rows))
    read = made.select("key", "formatted", chat_format.read_chats(F.col("formatted")).alias("turns"), chat_format.learned_text(F.col("formatted"), F.col("loss")).alias("learned"))
    got = {r.key: r for r in read.collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r, t) for _, _, r, t in rows[: len(HARD)]]
    assert got[1].learned == "".join(t for _, _, r, t in rows[: len(HARD)] if r == "assistant")
    assert [(t.role, t.text) for t in got[2].turns] == [("", ""), ("assistant", "")] and got[2].learned == ""
    assert [t.text for t in got[3].turns] == ["a", "a", "b"]
    # Only the template's own control strings are left.
    assert len(re.findall(r"<\|im_end\|>", got[1].formatted)) == len(HARD)


RECORDS = [
    ('{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}', [("user", "q"), ("assistant", "a")]),
    ('{"id":7,"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', [("user", "q"), ("assistant", "a")]),
    ('{"output":"a","instruction":"do","input":"it"}', [("user", "do"), ("user", "it"), ("assistant", "a")]),
    ('{"prompt":"p","completion":"c"}', [("user", "p"), ("assistant", "c")]),
    ('{"prompt":"p","response":null}', [("user", "p")]),
    ('{"something":"else"}', None),
]


def test_layouts_are_chosen_by_fingerprint(spark):
    records = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(RECORDS)], "id long, json string").select("id", F.parse_json("json").alias("record"))
    got = {}
    for r in chat_format.canonical_turns(records, "id", "record", ignore=("id",)).orderBy("key", "position").collect():
        got.setdefault(r.key, []).append(r)
    for i, (_, want) in enumerate(RECORDS):
        if want is None:
            assert [(t.layout, t.role, t.text) for t in got[i]] == [(None, None, None)]
        else:
            assert [(t.role, t.text) for t in got[i]] == want


def test_urls(spark):
    cases = [
        ("http://WWW.Example.com/en/x?y#z", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("https://m.example.com/en/", "m.example.com", "/en/", "example.com/en/", "block"),
        ("https://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("http://a.net/es/1", "a.net", "/es/1", "net/es/", "block"),
        ("http://net/fr/", "net", "/fr/", "net/fr/", "block"),
        ("http://a.net/fr", "a.net", "/fr", None, "allow"),
        ("http://x.com", "x.com", "", None, "allow"),
        ("mailto:x", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("http://x.org?a=http://net/es/", "x.org", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, c[0], "<p>", "z") for i, c in enumerate(cases)], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in url_filters.judge_urls(pages, RULES).collect()}
    for i, c in enumerate(cases):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == c[1:]


def test_blocks_reach_aliases(spark):
    def canonical(u):
        return f'<head><link href="{u}" rel="canonical"></head>'

    def refresh(u):
        return f'<meta http-equiv="refresh" content="0; url={u}">'

    pages = [
        (1, "http://a.org/1", canonical("https://B.org/1#x")),
        (2, "http://b.org/1", refresh("http://c.net/es/")),  # blocked by its own rule
        (3, "http://c.net/es/", "<p>"),
        (4, "http://d.org/1", canonical("/2")),
        (5, "http://d.org/2", None),
        (6, "http://e.org/", canonical("http://f.net/es/2")),
        (7, "http://e.org/2", canonical("http://e.org/")),
        (8, "http://e.org/3", refresh("//e.org/2") + canonical("http://g.com/")),  # an allowed alias comes first
        (8, "http://e.org/3", refresh("//e.org/2")),
        (9, None, canonical("http://f.net/es/2")),
    ]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filters.judge_urls(table, RULES).collect()}
    assert got == {1: (None, "block"), 2: (None, "block"), 3: ("net/es/", "block"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "allow"), 9: (None, "allow")}


def test_empty_tables(spark):
    assert url_filters.judge_urls(spark.createDataFrame([], "page_id long, url string, html string"), RULES).count() == 0
    assert chat_format.format_chats(turns(spark, [])).count() == 0
