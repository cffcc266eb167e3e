"""Operators that judge or rewrite one text at a time."""

import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from pactlake.llm import bpe, extract, packing, quality, toxicity
from pactlake.llm.queries import PIECES, WORD_BPE

ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n\x0b\x0c\r "),
    (4, "One two three.\nOne two three.\nfour five six seven eight nine ten"),
    (4, "One two three.\nOne two three.\nfour five six seven eight nine ten"),
    (None, "no key but words enough to be judged at all, as it seems to me."),
    (5, "x" * 70_000 + " " + "ab cd " * 3000),
    (6, "İΣσς naïve é 漢字 123 it's <|endoftext|> <|startoftext|>!?   \x85 \x1c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "en", i, 0.5, "mine") for i, (k, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, row int, score double, tokens string")


def by_row(df):
    return {r["row"]: r for r in df.collect()}


def test_bpe_equals_the_library(odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    got = by_row(bpe.encode_documents(odd, WORD_BPE))
    assert len(got) == len(ODD)
    for i, (_, text) in enumerate(ODD):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i].tokens == ids
        assert got[i].decoded == library.decode(ids, skip_special_tokens=False)
        assert got[i].lang == "en" and got[i].score == 0.5  # other columns stay; tokens was replaced


def test_bpe_on_random_text():
    from tokenizers import Tokenizer

    library, mine = Tokenizer.from_file(WORD_BPE), bpe.WordBpe(WORD_BPE)
    draw = random.Random(3)
    letters = "aabbceothersnd'sĞİΣσςéñß1２!?.,<|>endoftxsar \t\n\x1c\x85 　é😀漢字한글"
    for _ in range(3000):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 40)))
        found = [mine.encode(w) for w in mine.words(text)]
        ids = np.frombuffer(b"".join(f[0] for f in found), "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert " ".join(f[1] for f in found) == library.decode(ids, skip_special_tokens=False)


def test_automaton_needs_proper_merges():
    with pytest.raises(ValueError):
        bpe.Automaton({"a": 0, "b": 1, "ab": 2, "abb": 3}, [("ab", "b"), ("a", "b")], "")
    a = bpe.Automaton({"a": 0, "aa": 1, "aaa": 2}, [("a", "a"), ("aa", "a")], "")
    assert a.run("aaaaa")[1] == "aa aaa"  # leftmost pairs first, then the second rule


def test_packing_loses_nothing(odd):
    pieces = packing.pack_documents(odd.repartition(3), WORD_BPE, limit=64, block=500).collect()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    want = Counter((k, np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for k, t in ODD)
    docs, run = Counter(), {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        run.setdefault((p.doc_id, p.sequence_id >> 40, p.doc_tokens), []).append(p)
    for (k, _, whole), mine in run.items():
        joined = b"".join(bytes(p.ids) for p in mine)
        for at in range(0, len(joined), 4 * whole):
            docs[k, joined[at : at + 4 * whole]] += 1
        assert [p.start for p in mine] == [s % whole for s in np.cumsum([0, *[p.length for p in mine[:-1]]])]
    assert docs == want
    filled = Counter()
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == filled[p.sequence_id]
        filled[p.sequence_id] += p.length
    assert max(filled.values()) <= 64


def test_packing_cuts_are_the_cheapest():
    draw = random.Random(5)
    for _ in range(200):
        total, limit = draw.randint(1, 60), draw.randint(4, 16)
        penalties = {p: draw.randint(0, 3) for p in range(1, total) if draw.random() < 0.7}
        places = np.array(sorted(penalties), dtype=np.int64)
        gaps = np.diff([0, *places.tolist(), total])
        if gaps.max() > limit:
            continue
        cuts = packing.choose_cuts(places, np.array([penalties[p] for p in places.tolist()], dtype=np.int64), total, limit)
        assert cuts[-1] == total and all(0 < b - a <= limit for a, b in zip([0, *cuts], cuts, strict=False))
        cost = sum(limit - (b - a) + penalties.get(b, 0) for a, b in zip([0, *cuts], cuts, strict=False))
        assert cost == brute.fitting(total, limit, penalties)


def test_packing_pads_little(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    filled = packing.pack_documents(docs, WORD_BPE).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    padding = sum(4096 - r.n for r in filled if r.n & (r.n - 1))
    assert padding < 0.03 * sum(r.n for r in filled)


def test_quality_counts(odd, spark):
    docs = odd.unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", (F.col("doc_id") + 100).cast("int").alias("row")), allowMissingColumns=True)
    got = by_row(quality.judge_quality(docs, PIECES))
    model = quality.Fertility(PIECES).model
    for r in docs.collect():
        text, g = r.text or "", got[r.row]
        w = brute.words(text)
        runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        times = Counter(runs)
        repeated = {i + k for i, x in enumerate(runs) if times[x] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if brute.words(x)]
        assert (g.n_words, g.word_chars, g.n_repeat_words, g.n_dup_lines) == (len(w), sum(map(len, w)), len(repeated), len(lines) - len(set(lines)))
        assert g.n_symbols == sum(text.count(c) for c in "#*$%&|<>")
        assert g.base_failed == (len(w) < 10 or 100 * len(repeated) > 20 * len(w))
        pieces = [i for x in w for i in model.encode(x)]
        share = np.array(list(Counter(pieces).values())) / max(1, len(pieces))
        assert g.n_pieces == len(pieces) and abs(g.entropy + (share * np.log2(share)).sum()) < 1e-9
        assert g.n_byte_pieces == sum(map(model.is_byte, pieces))
        assert not (g.base_failed and g.kept)


def test_quality_keeps_clean_and_rejects_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    judged = quality.judge_quality(docs, PIECES).where("not base_failed").join(labels, "doc_id")
    share = {r.quality: r.kept for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[1] > 0.995 and share[0] < 0.6


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    rows = toxicity.score(docs, model).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).select("score", "toxic").collect()
    yes, no = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    ahead = np.mean([np.mean(y > np.array(no)) + 0.5 * np.mean(y == np.array(no)) for y in yes])
    assert ahead > 0.97
    assert np.mean(np.array(no) >= 0.5) < 0.01
    assert len(model.features) < 5000  # the penalty leaves few weights


def test_toxicity_learns_from_one_row_per_id(spark):
    docs = spark.createDataFrame([(i, f"{'vile' if i % 2 else 'kind'} words number {i}") for i in range(40)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    once = toxicity.train(docs, labels)
    hot = docs.where("doc_id = 3").crossJoin(spark.range(500)).drop("id")
    many = toxicity.train(docs.unionByName(hot), labels.unionByName(labels))
    assert len(once.features) and np.array_equal(once.features, many.features)
    assert np.array_equal(once.weights, many.weights) and once.constant == many.constant


def test_toxicity_odd_rows(odd, spark):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(odd, empty)
    assert {r.score for r in toxicity.score(odd, model).collect()} == {0.5}
    labels = spark.createDataFrame([(4, 1), (4, None), (None, 1), (5, 0), (99, 1), (4, 0)], "doc_id long, toxic int")
    got = by_row(toxicity.score(odd, toxicity.train(odd, labels)))
    assert len(got) == len(ODD) and got[3].score == got[4].score and got[0].score == got[1].score
    assert all(0 <= r.score <= 1 for r in got.values())


PAGES = [
    ("<article><h1>A &amp; B</h1><p>one\n  two&nbsp;three</p><p>x</p></article><footer>f</footer>", "A & B\n\none two three\n\nx"),
    ("<body><nav><a href='/'>menu</a></nav><article><p>To.</p><aside>no</aside><p><b>open<br>line<p>next</article><div class='comments'><p>nice post</p></div>", "To.\n\nopen line\n\nnext"),
    (None, ""),
    ("", ""),
    ("<html><body><script>var a='</p>'</script><style>p{}</style></body></html>", ""),
    ("<main><div class='ad-box'>buy</div><form><p>mail</p></form><p>body</p></main>", "body"),
    ("<div id='menu'>" + "<a href=x>a b c d</a>" * 20 + "</div><div class='content'><h2>Title here</h2><p>" + "word " * 60 + "</p><p>short.</p></div><div class='footer'>(c)</div>", "Title here\n\n" + ("word " * 60).strip() + "\n\nshort."),
    ("<article><header><h1>Head</h1><span>by me</span></header><p>text <!-- c --> more</p><div hidden>x</div></article>", "Head\n\ntext more"),
    ("<article><p>a < b and c > d</p><p title='a > b'>q</p>", "a < b and c > d\n\nq"),
]


def test_extraction(spark):
    pages = spark.createDataFrame([(i, "u", h, -1) for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, n_chars long")
    got = {r.page_id: r for r in extract.extract_pages(pages).collect()}
    for i, (_, want) in enumerate(PAGES):
        assert got[i].text == want and got[i].n_chars == len(want)


def test_surge_and_dive():
    weights = np.array([0, 3, 0, 0, 200, 10, 150, 0, 0, 0, 5, 0])
    assert extract.main_span(weights, 3, 86) == [(2, 7)]
    assert extract.main_span(np.zeros(4, int), 3, 86) == []


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert bpe.encode_documents(docs, WORD_BPE).count() == 0
    assert packing.pack_documents(docs, WORD_BPE).count() == 0
    assert quality.judge_quality(docs, PIECES).count() == 0
    assert toxicity.score(docs, toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0
    assert extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_long_markup_is_read_once():
    """Attributes, quotes and names of a megabyte take time in proportion to their length."""
    import time

    for attributes in ("x" * 1_000_000, " x" * 500_000, "=" * 1_000_000, "'\"" * 400_000, " class" + " " * 1_000_000):
        begun = time.perf_counter()
        texts, _, _ = extract.lines_of(f"<p {attributes}>", 3)
        assert texts == [] and time.perf_counter() - begun < 5
    assert extract._marked(' hidden data-x id="main-menu extra-nav"') and not extract._marked(' data-nav=menu x class = "post"')
    assert extract._marked(" class=nav") and extract._marked(" ID='share'") and extract._marked(" a = b role=' banner '")
