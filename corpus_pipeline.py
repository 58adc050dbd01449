"""Corpus pipeline: drop toxic documents, keep one of each group of near copies, cut repeated passages, pack.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; the driver of the pipeline, `run`,
writes each stage's result as Parquet in the shared folder and rereads it, so a lost executor costs one stage at most.
Empty tables pass through all stages; extra columns of documents are kept up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm import jaccard, packing, substring, toxicity
from tracefold.llm.common import every, fresh, scratch, table
from tracefold.session import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the toxicity threshold; the model is fitted on `labels`."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 5-word shingles at a similarity of 0.8, the row of the least id, then of the least hash of the text.

    Rows count by id and text, so different texts under one id are documents of their own, and null ids, which come last,
    are as others. Documents without words are kept. Of rows with one id and text one stays.
    """
    i, h, key = (fresh(docs, x) for x in ("kept_id", "kept_hash", "kept_key"))
    text = F.xxhash64("text")
    row = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), text.alias("hash"))
    kept = jaccard.near_duplicates(docs.select(row.alias(key), "text"), id_col=key, k=5, similarity=Fraction(4, 5))
    kept = kept.where("doc_id = component_id").select(F.col("doc_id.id").alias(i), F.col("doc_id.hash").alias(h)).distinct()
    left = docs.withColumn(key, text).join(kept, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(key) == F.col(h)), "left_semi")
    return left.groupBy("doc_id", key).agg(F.first(F.struct(*every(docs))).alias(i)).select(f"{i}.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 20-word windows that stand earlier; n_chars follows the text."""
    cut = substring.remove_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("packing", pack_sequences),
]
ORACLE_SQL = None  # scores of a fitted model and tokenizer ids have no SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
