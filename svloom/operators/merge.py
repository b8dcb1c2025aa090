"""Merging of two breakend call sets: proximity join, best partner, evidence grade, full outer union."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import band_join


def near(a: DataFrame, b: DataFrame, reach: int) -> DataFrame:
    """a(a_id, a_chr1, a_fp1, a_chr2, a_fp2, ...) with the b(b_id, ...) whose both ends are within reach; strands do not count."""
    left = a.withColumns({"chr1": F.col("a_chr1"), "chr2": F.col("a_chr2")})
    right = b.withColumns({"chr1": F.col("b_chr1"), "chr2": F.col("b_chr2")})
    return band_join(left, right, ["chr1", "chr2"], [("a_fp1", "b_fp1", reach), ("a_fp2", "b_fp2", reach)]).drop("chr1", "chr2")


def best_partner(matches: DataFrame, carried: list[str] = ()) -> DataFrame:
    """Per a_id: the b of most split reads (the later one if equal), its numbers, and the confidence of the last b of all."""
    take = ["b_id", "sdp", "sp", "sr", "fr", *carried]
    rows = matches.groupBy("a_id").agg(F.max_by(F.struct(*take), F.struct("sr", "b_idx")).alias("best"), F.max_by("b_failed", "b_idx").alias("last_failed"), F.count("*").alias("n_b"))
    return rows.select("a_id", F.col("best.b_id").alias("topread"), *[F.col(f"best.{c}").alias(c) for c in take[1:]], "last_failed", "n_b")


def merged(a: DataFrame, b: DataFrame, reach: int = 500, carried: list[str] = ()) -> DataFrame:
    """All calls of a with their best b, then the b calls that met none.

    a: a_id, a_chr1, a_fp1, a_chr2, a_fp2, a_failed. b: b_id, b_chr1, b_fp1, b_chr2, b_fp2, b_failed, b_idx, sdp, sp, sr, fr.
    evidence: both sides LOW give MED, else HIGH, and the filter becomes PASS; alone, a failed call is LOW, others MED."""
    matches = near(a, b, reach)
    best = best_partner(matches, carried)
    both = F.col("topread").isNotNull()
    grade = F.when(both & F.col("a_failed") & F.col("last_failed"), "MED").when(both, "HIGH").when(F.col("a_failed"), "LOW").otherwise("MED")
    numbers = ["sdp", "sp", "sr", "fr", *carried]
    left = a.join(best, "a_id", "left").select(F.lit("A").alias("source"), F.col("a_id").alias("id"), F.col("a_chr1").alias("chr1"), F.col("a_fp1").alias("fp1"), F.col("a_chr2").alias("chr2"), F.col("a_fp2").alias("fp2"), F.when(both, "PASS").when(F.col("a_failed"), "FAILED").otherwise(".").alias("filter"), "topread", *numbers, grade.alias("evidence"))
    rest = b.join(matches.select("b_id").distinct(), "b_id", "left_anti")
    right = rest.select(F.lit("B").alias("source"), F.col("b_id").alias("id"), F.col("b_chr1").alias("chr1"), F.col("b_fp1").alias("fp1"), F.col("b_chr2").alias("chr2"), F.col("b_fp2").alias("fp2"), F.when(F.col("b_failed"), "FAILED").otherwise(".").alias("filter"), F.lit(None).cast("string").alias("topread"), *numbers, F.when(F.col("b_failed"), "LOW").otherwise("MED").alias("evidence"))
    return left.unionByName(right.withColumn("topread", F.col("topread").cast(left.schema["topread"].dataType)))


def supported(a: DataFrame, b: DataFrame, reach: int = 500, flag: str = "supported") -> DataFrame:
    """a with a flag: 1 if any b is near, else 0."""
    met = near(a, b, reach).select("a_id").distinct().withColumn(flag, F.lit(1))
    return a.join(met, "a_id", "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(0)))


def reconciled(a: dict[str, int], b: dict[str, int]) -> dict[str, int]:
    """Contig lengths of two headers together; equal names must have equal lengths."""
    wrong = sorted(c for c in a.keys() & b.keys() if a[c] != b[c])
    if wrong:
        raise ValueError(f"contigs of different lengths: {', '.join(wrong)}")
    return a | b
