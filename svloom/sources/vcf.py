"""VCF text as DataFrames. Headers are small and stay with the driver."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bnd

COLUMNS = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info")


def header(spark: SparkSession, path: str) -> list[str]:
    """Header lines in order; those of one file."""
    return [r["value"] for r in spark.read.text(path).where("value LIKE '#%'").collect()]


def sample_of(lines: list[str], path: str) -> str:
    """The header's sample, or the file's stem; more than one sample is an error."""
    last = next((x for x in reversed(lines) if x.startswith("#CHROM")), "#CHROM")
    names = last.split("\t")[9:]
    if len(names) > 1:
        raise ValueError(f"{path} has more than one sample")
    return names[0] if names else re.sub(r"\.[^.]*$", "", path.rstrip("/").rsplit("/", 1)[-1])


def contigs_of(lines: list[str]) -> dict[str, int]:
    out = {}
    for x in lines:
        m = re.match(r"##contig=<.*?ID=([^,>]+).*?length=(\d+)", x)
        if m:
            out[m[1]] = int(m[2])
    return out


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """rec_idx, sample, chrom, pos (from 0), id, ref, alt (array), qual, filter, info (map; flags have an empty value), line.

    rec_idx orders the lines of a file; ``.`` in id, qual and filter is null."""
    files = [path] if isinstance(path, str) else path
    out = None
    for p in files:
        rows = spark.read.text(p).where("value NOT LIKE '#%' AND value <> ''").select(F.monotonically_increasing_id().alias("rec_idx"), F.lit(sample_of(header(spark, p), p)).alias("sample"), F.split("value", "\t").alias("f"), F.col("value").alias("line"))
        out = rows if out is None else out.unionByName(rows)
    # header lines may reach these expressions before they are filtered out, so nothing here fails on short or odd lines
    f = lambda i: F.get("f", F.lit(i))
    dot = lambda i: F.when(f(i) != ".", f(i))
    entries = F.transform(F.filter(F.split(f(7), ";"), lambda x: ~x.isin("", ".")), lambda x: F.struct(F.split(x, "=", 2)[0].alias("key"), F.coalesce(F.get(F.split(x, "=", 2), F.lit(1)), F.lit("")).alias("value")))
    return out.select("rec_idx", "sample", f(0).alias("chrom"), (f(1).try_cast("long") - 1).alias("pos"), dot(2).alias("id"), f(3).alias("ref"), F.split(f(4), ",").alias("alt"), dot(5).try_cast("double").alias("qual"), dot(6).alias("filter"), F.map_from_entries(entries).alias("info"), "line")


def cipos(info) -> F.Column:
    """Absolute values of CIPOS, or null."""
    return F.transform(F.split(info["CIPOS"], ","), lambda x: F.abs(x.cast("long")))


def checked(rows: DataFrame, contigs: DataFrame) -> DataFrame:
    """Fails on positions before a contig's start or beyond its end."""
    out = rows.join(F.broadcast(contigs).withColumnRenamed("contig", "chrom"), "chrom", "left")
    bad = (F.col("pos") < 0) | (F.col("pos") + 1 > F.col("length") + 1) | F.col("length").isNull()
    return out.withColumn("pos", F.when(bad, F.raise_error(F.concat_ws(" ", F.lit("position outside of contig:"), "chrom", (F.col("pos") + 1).cast("string")))).otherwise(F.col("pos")).cast("long"))


def variants(records: DataFrame, contigs: DataFrame | None = None, ignore_direction: bool = False) -> dict[str, DataFrame]:
    """Records routed by SVTYPE: pairs (BND with MATEID, one row per record), singles (BND without) and indels (INS, DEL)."""
    rows = records if contigs is None else checked(records, contigs)
    kind = F.col("info")["SVTYPE"]
    mate = F.col("info")["MATEID"]
    rows = rows.withColumn("x", bnd.parse_alt(F.col("alt")[0]))
    d = (lambda c: F.lit(".")) if ignore_direction else (lambda c: F.col(f"x.{c}"))
    pairs = rows.where((kind == "BND") & mate.isNotNull()).select("rec_idx", "sample", "id", mate.alias("mid"), F.col("chrom").alias("chr1"), F.col("pos").alias("st1"), (F.col("pos") + 1).alias("end1"), d("dir1").alias("f1"), F.col("x.chr").alias("chr2"), F.col("x.pos").alias("st2"), (F.col("x.pos") + 1).alias("end2"), d("dir2").alias("f2"), F.col("info")["GENE_FUSION"].alias("name"))
    singles = rows.where((kind == "BND") & mate.isNull()).select("rec_idx", "sample", "id", F.col("chrom").alias("chr"), F.col("pos").alias("st"), (F.col("pos") + 1).alias("end"), d("dir1").alias("direction"))
    end = F.col("pos") + 1
    if contigs is not None:
        end = F.when(end >= F.col("length"), F.greatest(F.col("length") - 1, F.col("pos"))).otherwise(end)
    indels = rows.where(kind.isin("INS", "DEL")).select("rec_idx", "sample", "id", F.col("chrom").alias("chr"), F.col("pos").alias("st"), end.alias("end"), kind.alias("sv_type"))
    return {"pairs": pairs, "singles": singles, "indels": indels}


def unknown(records: DataFrame) -> int:
    """The number of records that ``variants`` leaves out. Counted by itself: a count observed on the way is lost where adaptive execution
    finds a branch empty and drops it."""
    return records.where(~F.coalesce(F.col("info")["SVTYPE"].isin("BND", "INS", "DEL"), F.lit(False))).count()


def call_set(records: DataFrame, kind: str, simple: bool = False) -> DataFrame:
    """Two-allele breakend records with a mate, as one side of a merge. kind a: without sample, FRAG_ID unless simple; kind b: SP unless simple."""
    info = F.col("info")
    needed = F.lit(True) if simple else info["FRAG_ID" if kind == "a" else "SP"].isNotNull()
    rows = records.where(F.col("id").isNotNull() & info["MATEID"].isNotNull() & (F.size("alt") == 1) & needed).withColumn("x", bnd.parse_alt(F.col("alt")[0]))
    p = kind
    out = [F.col("id").alias(f"{p}_id"), F.col("chrom").alias(f"{p}_chr1"), F.col("pos").alias(f"{p}_fp1"), F.col("x.chr").alias(f"{p}_chr2"), F.col("x.pos").alias(f"{p}_fp2"), F.coalesce(F.col("filter").contains("FAILED"), F.lit(False)).alias(f"{p}_failed")]
    if kind == "b":
        number = lambda k: F.coalesce(info[k].cast("long"), F.lit(0).cast("long"))
        out += [F.col("rec_idx").alias("b_idx"), number("SDP").alias("sdp"), number("SP").alias("sp"), number("SR").alias("sr"), info["FR"].cast("double").alias("fr"), "info"]
    return rows.select(*out)
