"""Two-line BED of integration reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """rec_idx, read, start, end, label, strand, target; lines of other than six fields are errors.

    Consecutive lines pair up, so rec_idx counts all lines of the file: it comes from sorted line starts, not from one task."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where("value <> ''").select(F.monotonically_increasing_id().alias("at"), F.when(F.size(f) == 6, f).otherwise(F.raise_error(F.lit("not six fields"))).cast("array<string>").alias("f"))
    # ids hold the partition in their upper bits: rows before a partition are counted per partition
    part = F.shiftright("at", 33)
    sizes = sorted((r["part"], r["n"]) for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    base, pairs = 0, []
    for p, n in sizes:
        pairs += [F.lit(p), F.lit(base)]
        base += n
    index = (F.create_map(*pairs)[part] if pairs else F.lit(0)) + F.col("at").bitwiseAND((1 << 33) - 1)
    g = F.col("f")
    return rows.select(index.cast("long").alias("rec_idx"), g[0].alias("read"), g[1].cast("long").alias("start"), g[2].cast("long").alias("end"), g[3].alias("label"), g[4].alias("strand"), g[5].alias("target"))
