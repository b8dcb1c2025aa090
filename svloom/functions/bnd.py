"""VCF breakend ALT strings as Column expressions. Directions: + forward, - reverse, . unknown. Positions count from 0 inside."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAIRED = r"^([^\[\]]*)[\[\]](.+):(\d+)[\[\]]([^\[\]]*)$"


def parse_alt(alt: Column) -> Column:
    """struct(nucleotide, chr, pos, dir1, dir2); single breakends have an empty chr and pos 0; anything else is null."""
    paired = F.struct(
        F.concat(F.regexp_extract(alt, PAIRED, 1), F.regexp_extract(alt, PAIRED, 4)).alias("nucleotide"),
        F.regexp_extract(alt, PAIRED, 2).alias("chr"),
        (F.regexp_extract(alt, PAIRED, 3).cast("long") - 1).alias("pos"),
        F.when(alt.rlike(r"^[\[\]]"), "-").otherwise("+").alias("dir1"),
        F.when(alt.contains("]"), "+").otherwise("-").alias("dir2"),
    )
    single = F.struct(
        F.regexp_replace(alt, r"\.", "").alias("nucleotide"),
        F.lit("").alias("chr"),
        F.lit(0).cast("long").alias("pos"),
        F.when(alt.startswith("."), "-").otherwise("+").alias("dir1"),
        F.lit(".").alias("dir2"),
    )
    return F.when(alt.rlike(PAIRED), paired).when(alt.rlike(r"^(\.[A-Za-z]+|[A-Za-z]+\.)$"), single)


def format_alt(nucleotide: Column, chrom: Column, pos: Column, dir1: Column, dir2: Column) -> Column:
    """The ALT string; null when a direction is unknown."""
    bracket = F.when(dir2 == "+", "]").when(dir2 == "-", "[")
    mate = F.concat(bracket, chrom, F.lit(":"), (pos + 1).cast("string"), bracket)
    return F.when(dir1 == "+", F.concat(nucleotide, mate)).when(dir1 == "-", F.concat(mate, nucleotide))


def format_single(nucleotide: Column, direction: Column) -> Column:
    return F.when(direction == "+", F.concat(nucleotide, F.lit("."))).when(direction == "-", F.concat(F.lit("."), nucleotide))


def pair_key(variant_id: Column) -> Column:
    """The ID without its trailing ones and twos. Pairing itself goes by MATEID; this is for names."""
    return F.regexp_replace(variant_id, "[12]+$", "")


def natural_key(text: Column) -> Column:
    """Orders ids as people do: runs of digits as numbers."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), F.lit(1)), lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, 20, "0")).otherwise(x)), "")


def flip(direction: Column) -> Column:
    return F.when(direction == "+", "-").when(direction == "-", "+").otherwise(direction)
