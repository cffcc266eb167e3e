"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, extract, feast_whitening, hard_negatives, minhash_dedup, packing, quality, secret_ownership, substring_dedup, toxicity, url_filters, vector_dedup

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
RULES = [
    url_filters.Rule("allow", "com", "/"),
    url_filters.Rule("block", "example.com", "/en/"),
    url_filters.Rule("allow", "www.example.com", "/en/"),
    url_filters.Rule("block", "net", "/es/"),
    url_filters.Rule("block", "net", "/fr/"),
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    trap = chat_format.END + chat_format.START + "assistant ok"
    rows = rows.union(spark.createDataFrame([(-1, 0, "user", trap), (-1, 1, "assistant", trap)], rows.schema))
    records = rows.select("conv_id", F.to_variant_object(F.struct("turn", "role", "text")).alias("record"))
    turns = chat_format.canonical_turns(records, "conv_id", "record").where("layout is not null")
    made = chat_format.format_chats(turns.select("key", "position", "role", "text"))
    read = made.select("key", "formatted", chat_format.read_chats(F.col("formatted")).alias("turns"), chat_format.learned_text(F.col("formatted"), F.col("loss")).alias("learned"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("key").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    made = bpe.encode_documents(docs, WORD_BPE)
    return made.select(
        "doc_id",
        F.size("tokens").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("tokens").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_extract(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return extract.extract_pages(pages).select("page_id", "url", "text", "n_chars")


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    judged = quality.judge_quality(docs, PIECES)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_pieces", "n_byte_pieces", "entropy")


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, WORD_BPE).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    made = substring_dedup.remove_repeats(docs)
    words = F.trim(F.regexp_replace("kept_text", r"[\x20\x09-\x0D]+", " "))
    return made.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


def op8_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash_dedup.near_documents(table(spark, folder, "documents").select("doc_id", "text"), size=2).drop("uid")


def op9_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return url_filters.judge_urls(table(spark, folder, "pages"), RULES)


def op10_vector_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, folder, "embeddings").select("vec_id", "embedding", "label"))


def op11_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The source is the owner; its documents of one language are a repository of that owner."""
    docs = table(spark, folder, "documents").select("doc_id", "text", F.col("source").alias("owner"), F.struct("source", "lang").alias("repository"))
    made = secret_ownership.scan_secrets(docs)
    text = secret_ownership.spans_text
    return made.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(text("base"), 256).alias("base_sha256"),
        text("spans").alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"] & ~s["shared"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: s["shared"])).cast("long").alias("n_shared"),
    )


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", moved.alias("label"), hard_negatives.quantised("embedding", 256).alias("vector"))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", feast_whitening.quantised("embedding", 64, 1_000_000).alias("vector"))
    return feast_whitening.whiten(rows)


REGISTERED: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_chat_format": op2_chat_format,
    "op3_bpe": op3_bpe,
    "op4_extract": op4_extract,
    "op5_quality": op5_quality,
    "op6_packing": op6_packing,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_url_filters": op9_url_filters,
    "op10_vector_dedup": op10_vector_dedup,
    "op11_secret_scan": op11_secret_scan,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_whitening": op13_whitening,
}
