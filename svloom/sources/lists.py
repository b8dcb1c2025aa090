"""Small list files: names, chromosomes, contig lengths, lists of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def names(spark: SparkSession, path: str, column: str = "id") -> DataFrame:
    """One name per line; a line with a space is an error. Empty lines are skipped."""
    lines = spark.read.text(path).where("value <> ''")
    whole = F.when(F.col("value").contains(" "), F.raise_error(F.concat(F.lit("a name has a space: "), "value"))).otherwise(F.col("value"))
    return lines.select(whole.cast("string").alias(column)).distinct()


def contig_lengths(spark: SparkSession, path: str) -> DataFrame:
    """contig, length from two tab-separated fields; other lines, negative lengths and repeated names are errors."""
    f = F.split("value", "\t")
    fine = (F.size(f) == 2) & f[1].rlike(r"^\d+$")
    rows = spark.read.text(path).where("value <> ''").select(F.when(fine, f[0]).otherwise(F.raise_error(F.concat(F.lit("not a contig and its length: "), "value"))).cast("string").alias("contig"), F.when(fine, f[1].cast("long")).alias("length"))
    counted = rows.groupBy("contig").agg(F.max("length").alias("length"), F.count("*").alias("n"))
    return counted.select(F.when(F.col("n") == 1, F.col("contig")).otherwise(F.raise_error(F.concat(F.lit("contig given twice: "), "contig"))).cast("string").alias("contig"), "length")


def paths(spark: SparkSession, path: str, is_list: bool) -> list[str]:
    """The files that a list file names, or the path itself. A list of files is bounded by what one reads at once, so it comes to the driver."""
    if not is_list:
        return [path]
    found = [r["value"].strip("\r") for r in spark.read.text(path).collect() if r["value"]]
    if any(" " in x for x in found):
        raise ValueError("a file name has a space")
    return found
