"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlake import materialize
from pactlake.llm import minhash_dedup, packing, quality, substring_dedup, toxicity
from pactlake.llm.queries import PIECES, WORD_BPE, table


def _aside(docs: DataFrame, *results: str) -> tuple[DataFrame, list]:
    """Documents with columns named like an operator's results set aside, and how to select all as they were."""
    names = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c.lower() in results}
    return docs.withColumnsRenamed(names), [F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents inside their language's bands of tokeniser fertility and the base rules."""
    docs, own = _aside(docs, *quality.RESULTS, "base_failed", "kept")
    return quality.judge_quality(docs, PIECES).where("kept").select(*own)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half by a model fitted on the labelled ones among them."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~toxicity.held_out(F.col("doc_id")))
    model = toxicity.train(docs.select("doc_id", "text"), labels)
    docs, own = _aside(docs, "score")
    return toxicity.score(docs, model).where("score < 0.5").select(*own)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return minhash_dedup.one_of_each(docs, minhash_dedup.near_documents(docs))


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 35 words or more that occur again. A text may come out empty."""
    renamed, own = _aside(docs, "n_words", "n_removed", "removed", "kept_text")
    new = {"text": F.col("kept_text").alias("text"), "n_chars": F.length("kept_text").cast("long").alias("n_chars")}
    return substring_dedup.remove_repeats(renamed).select(*[new.get(c, o) for c, o in zip(docs.columns, own, strict=True)])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, WORD_BPE)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", passage_dedup),
    ("packing", pack),
]

#: No stage but the first two could be written in SQL at all, and those not with their models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over all documents; each one's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
