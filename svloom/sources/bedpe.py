"""BEDPE region pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "rchr1 string, s1 long, e1 long, rchr2 string, s2 long, e2 long, name string, score int, strand1 string, strand2 string, type string"


def regions(spark: SparkSession, path: str, contigs: DataFrame | None = None, min_score: int | None = None) -> DataFrame:
    """The eleven columns; wrong types and strands are errors. With contig lengths, an end one short of its contig takes the rest."""
    rows = spark.read.csv(path, sep="\t", schema=SCHEMA, mode="FAILFAST", comment="#")
    fine = F.col("type").isin("BND_PAIR", "INS", "DEL") & F.col("strand1").isin("+", "-", ".") & F.col("strand2").isin("+", "-", ".")
    rows = rows.withColumn("type", F.when(fine, F.col("type")).otherwise(F.raise_error(F.lit("not a known type or strand"))).cast("string"))
    if min_score is not None:
        rows = rows.where(F.col("score") >= min_score)
    if contigs is not None:
        for i in "12":
            ends = F.broadcast(contigs).select(F.col("contig").alias(f"rchr{i}"), F.col("length").alias("__n"))
            rows = rows.join(ends, f"rchr{i}", "left").withColumn(f"e{i}", F.when(F.col(f"e{i}") + 1 == F.col("__n"), F.col(f"e{i}") + 1).otherwise(F.col(f"e{i}"))).drop("__n")
    return rows
