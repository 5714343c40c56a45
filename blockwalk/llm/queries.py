"""Registered queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut, work_root
from . import decontam, embed_join, hard_negatives, langid, licenses, mixing, ngram_join, pii, prefix_trie, substring, token_counts, toxicity, warc
from .shipping import ship
from .text import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), preference=mixing.length_class)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = work_root(spark)
    root = root if "://" in root or root.startswith("file:") else f"file://{root}"
    records = warc.revisits(_table(spark, sf_dir, "pages"))
    files = warc.write_archives(records, f"{root}/warc-{uuid.uuid4().hex}")
    return warc.resolved(cut(warc.read_archives(files)))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", F.size("notices").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("notices.license")), ",").alias("licenses"),
        F.coalesce(F.array_max("notices.difference"), F.lit(0.0)).alias("most_different"),
    )


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = {f"n_{k.name}": pii.how_many(F.col("pii"), k.name) for k in pii.KINDS if k.base}
    return found.select(
        "doc_id", *[c.alias(n) for n, c in count.items()],
        F.sha2(pii.listed(pii.base_spans(F.col("pii"))).cast("binary"), 256).alias("base_sha256"), pii.listed(F.col("pii")).alias("spans"),
    )


#: a public byte-level vocabulary of 50,256 pieces
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op6_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    with open(vocabulary, encoding="ascii") as lines:
        automaton = token_counts.build(token_counts.read_vocabulary(lines))
    return token_counts.count_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text"), automaton).select(
        "doc_id", "n_words", "n_tokens"
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_windows(docs, _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    model = toxicity.learn(docs, labels)
    scored = toxicity.score(docs.withColumn("held_out", held_out(F.col("doc_id"))), model)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id")))
    profiles = langid.learn_profiles(docs.filter("not held_out"))
    return langid.identify(docs.select("doc_id", "text", "held_out"), profiles).select("doc_id", "held_out", "lang_pred", "score")


def op10_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_join.near_vectors(_table(spark, sf_dir, "embeddings"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    wide = F.col("embedding").cast("array<double>")
    usable = F.col("embedding").isNotNull() & ~F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = vectors.filter(usable).select("vec_id", label.alias("label"), F.transform(wide, lambda x: F.floor(256 * x)).alias("embedding"))
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)


def rebuilt_conversations(conversations: DataFrame, hot_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(turns, ids): every conversation c starts with turns of conversation c - c % 5."""
    turns = cut(prefix_trie.ordered_turns(conversations, hot_rows=hot_rows))
    heads = F.crc32(F.col("conv").cast("string").cast("binary")) % 9
    return prefix_trie.grafted(turns, F.col("conv") - F.col("conv") % 5, heads, 8, hot_rows), turns.select("conv")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(*rebuilt_conversations(_table(spark, sf_dir, "conversations")))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mixing, op2_warc, op3_ngram_join, op4_licenses, op5_pii, op6_token_counts, op7_decontamination, op8_toxicity, op9_language_id, op10_embedding_join, op11_hard_negatives, op12_prefix_trie, op13_substring_dedup)
}
