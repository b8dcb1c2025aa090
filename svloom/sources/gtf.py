"""GTF features, in either attribute dialect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.annotate import gene_name


def attributes(text) -> F.Column:
    """key "value"; or key=value; pairs as a map; the last of a repeated key counts."""
    parts = F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: x != "")
    pairs = F.transform(parts, lambda x: F.struct(F.regexp_extract(x, r"^([^\s=]+)", 1).alias("key"), F.regexp_replace(F.regexp_extract(x, r"^[^\s=]+[\s=]+(.*)$", 1), '"', "").alias("value")))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def features(spark: SparkSession, path: str, feature: str = "transcript", chroms: DataFrame | None = None) -> DataFrame:
    """chrom, f_start, f_end (half-open, from 0), f_strand, name, attribute. Lines of other than nine fields or without a strand are errors;
    so is a first kept line of neither dialect."""
    f = F.split("value", "\t")
    lines = spark.read.text(path).where("value NOT LIKE '#%' AND value <> ''").select(F.when((F.size(f) == 9) & f[6].isin("+", "-"), f).otherwise(F.raise_error(F.lit("not a GTF line"))).cast("array<string>").alias("f"))
    rows = lines.where(F.col("f")[2] == feature)
    first = rows.select(F.col("f")[8].alias("a")).first()
    if first is not None and "gene_name" not in first["a"] and "gene_id" not in first["a"]:
        raise ValueError("unknown attribute dialect")
    out = rows.select(F.col("f")[0].alias("chrom"), (F.col("f")[3].cast("long") - 1).alias("f_start"), F.col("f")[4].cast("long").alias("f_end"), F.col("f")[6].alias("f_strand"), attributes(F.col("f")[8]).alias("attribute"))
    out = out.withColumn("name", gene_name(F.col("attribute")))
    return out if chroms is None else out.join(chroms.distinct(), "chrom", "left_semi")
