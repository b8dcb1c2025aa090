"""A training corpus from ``documents``: quality by importance resampling, near-dedup, substring dedup, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from svloom.llm.common import apart, read_table, release, staged
from svloom.llm.near_dedup import classes_of
from svloom.llm.packing import packed, pieces
from svloom.llm.quality import sampled
from svloom.llm.substring_dedup import deduplicated


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps, whole. Texts without words go; without good labels all stay."""
    rows, back = apart(docs, ["doc_id", "text", "lang"])
    return sampled(rows, read_table(spark, sf_dir, "labels")).where("kept").select(back)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8): that with the smallest doc_id, a null one last, and of its
    rows the first. Rows are numbered, so repeated doc_ids are documents of their own. Texts without words are no copies and stay."""
    rows, back = apart(docs, ["doc_id", "text"])
    rows = staged(rows.withColumn("row #", F.monotonically_increasing_id()), "numbered")
    found = classes_of(rows.select(F.col("`row #`").alias("doc_id"), "text"), 5, 80).select(F.col("doc_id").alias("row #"), "component_id")
    first = F.min_by("row #", F.struct(F.col("doc_id").isNull(), "doc_id", "row #"))
    kept = found.join(rows.select("row #", "doc_id"), "row #").groupBy("component_id").agg(first.alias("row #")).select("row #")
    return rows.join(kept, "row #", "left_semi").select(back)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of repeated windows of 35 words; texts without any stay as they are. n_chars, where there is such a
    column, is that of the new text."""
    release(spark)  # what the stages before have shuffled
    rows, back = apart(docs, ["doc_id", "text", "n_chars"])
    out = deduplicated(rows, 35, texts=True)
    if "n_chars" in rows.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(rows.schema["n_chars"].dataType))
    return out.select(back)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands, in sequences of 1,024 tokens. A null or empty text is a piece of one token."""
    return packed(staged(pieces(docs, public_tokenizers.path("byte_bpe_50k.json")), "pieces"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", packing)]

#: hashes, models and tokenizers have no SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is a table in the shared folder, which the next one reads."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}", free=True)
    return STAGES[-1][1](spark, docs, sf_dir)
