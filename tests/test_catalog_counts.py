"""Catalog counts that must not sort whole documents."""

from pyspark.sql import functions as F

from pactlake.operators import catalog
from pactlake.operators.canonical import catalog_canonical_audit


def _audit(spark):
    rows = [(i, "json", b) for i, b in enumerate(['{"type":"object"}', ' {"type":"object"}', '{"type":"object"}', '{"maximum":1}', "{", None, ""])]
    return catalog_canonical_audit(spark.createDataFrame(rows, "k int, format string, body string"))


def test_documents_and_spellings_of_an_id(spark):
    got = {r.canonical: (r.documents, r.spellings) for r in catalog.dedupe_catalog(_audit(spark)).collect()}
    assert got == {'{"type":"object"}': (3, 2), '{"maximum":1}': (1, 1)}


def test_documents_are_counted_without_being_sorted(spark, capsys):
    """The first aggregate, which meets every document, counts by hash: it holds no text as a value."""
    catalog.dedupe_catalog(_audit(spark).withColumn("more", F.lit(1))).explain()
    counts = [line for line in capsys.readouterr().out.splitlines() if "Aggregate(" in line]
    assert "HashAggregate" in counts[-1] and "count" in counts[-1]
