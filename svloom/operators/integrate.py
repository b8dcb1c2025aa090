"""Integration sites of foreign DNA, junction sequences, reads that link two genes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cigar as cg
from ..functions.sequence import reverse_complement, stitched
from .evidence import MATE_UNMAPPED, has
from .intervals import interval_join

TARGET = r"^(.*)@(\d+)-(\d+)$"


def integration_sites(lines: DataFrame, host: str, foreign: str, overlap: int = 10) -> DataFrame:
    """lines(rec_idx, read, start, end, label, strand, target), two consecutive ones per read: read, ref_*, alien_*, site, direction.

    host and foreign are regular expressions for labels. Pairs that overlap too much, have several targets or no strand give no row;
    a pair that is not one host and one foreign part of the same read is an error."""
    row = F.struct("read", "start", "end", "label", "strand", "target")
    pairs = lines.groupBy(F.floor(F.col("rec_idx") / 2).alias("n")).agg(F.min_by(row, "rec_idx").alias("x"), F.max_by(row, "rec_idx").alias("y"), F.count("*").alias("k"))
    x_first = F.col("y.start") + overlap >= F.col("x.end")
    y_first = F.col("x.start") + overlap >= F.col("y.end")
    rows = pairs.withColumn("first", F.when(x_first, F.col("x")).when(y_first, F.col("y"))).withColumn("second", F.when(x_first, F.col("y")).when(y_first, F.col("x")))
    fine = (F.col("k") == 2) & (F.col("x.read") == F.col("y.read"))
    rows = rows.where(F.when(fine, F.col("first").isNotNull()).otherwise(F.raise_error(F.lit("lines do not pair up"))))
    host_first = F.col("first.label").rlike(host) & F.col("second.label").rlike(foreign)
    host_second = F.col("second.label").rlike(host) & F.col("first.label").rlike(foreign)
    rows = rows.withColumn("host_first", F.when(host_first, True).when(host_second, False).otherwise(F.raise_error(F.lit("labels are not one host and one foreign part"))).cast("boolean"))
    rows = rows.withColumn("ref", F.when(F.col("host_first"), F.col("first")).otherwise(F.col("second"))).withColumn("alien", F.when(F.col("host_first"), F.col("second")).otherwise(F.col("first")))
    rows = rows.where(F.col("ref.target").rlike(r"^[^,]*@\d+-\d+$") & F.col("ref.strand").isin("+", "-"))
    g_start, g_end = (F.regexp_extract("ref.target", TARGET, i).cast("long") for i in (2, 3))
    at_end = F.col("host_first") == (F.col("ref.strand") == "+")
    return rows.select(F.col("ref.read").alias("read"), F.regexp_extract("ref.target", TARGET, 1).alias("chrom"), F.when(at_end, g_end).otherwise(g_start).alias("site"), F.when(at_end, "+").otherwise("-").alias("direction"), F.col("ref.start").alias("ref_start"), F.col("ref.end").alias("ref_end"), F.col("alien.start").alias("alien_start"), F.col("alien.end").alias("alien_end"))


def fetched(spans: DataFrame, reference: DataFrame, bin_size: int = 4096) -> DataFrame:
    """spans(span, contig, s, e) with their sequence, from reference pieces(contig, offset, offset_end, seq); ends beyond a contig are cut."""
    near = interval_join(spans, reference, ["contig"], ("s", "e"), ("offset", "offset_end"), bin_size)
    parts = near.groupBy("span", "s", "e").agg(F.array_sort(F.collect_list(F.struct("offset", "seq"))).alias("p"))
    return parts.select("span", stitched(F.col("p.seq"), F.col("p")[0]["offset"], F.col("s"), F.col("e")).alias("seq"))


def junction_sequences(pairs: DataFrame, reference: DataFrame, reach: int = 500) -> DataFrame:
    """pairs(id1, id2, chr1, p1, d1, chr2, p2, d2): id1, id2, sequence; first part upper case, second lower.

    Directions are those of the genes: a forward first part ends at its position, a forward second part begins there.
    A start that falls before the contig is set to 0 before its shift by one, so such a part begins at the second base."""
    zero = F.lit(0).cast("long")

    def span(first: bool) -> DataFrame:
        p, d, c = (F.col(x + ("1" if first else "2")) for x in ("p", "d", "chr"))
        back = (d == "+") if first else (d == "-")
        start = F.when(back, F.greatest(p - reach, zero) + 1).otherwise(p)
        end = F.when(back, p + 1).otherwise(p + reach)
        got = fetched(pairs.select(F.col("id1").alias("span"), c.alias("contig"), start.alias("s"), end.alias("e")), reference)
        return got.select(F.col("span").alias("id1"), F.col("seq").alias("seq1" if first else "seq2"))

    out = pairs.join(span(True), "id1").join(span(False), "id1")
    turned = lambda s, d: F.when(F.col(d) == "+", F.col(s)).otherwise(reverse_complement(F.col(s)))
    return out.select("id1", "id2", F.concat(F.upper(turned("seq1", "d1")), F.lower(turned("seq2", "d2"))).alias("sequence"))


def gene_of_transcript(name: Column) -> Column:
    """The gene part of a transcript name with a numbered suffix; null for other names."""
    got = F.regexp_extract(name, r"^(CHS\.[0-9]+)\.[0-9]+", 1)
    return F.when(got != "", got)


def linking_reads(alignments: DataFrame, min_similarity: float = 98.0) -> DataFrame:
    """Names of reads whose first good enough supplementary alignment, or else whose mate, is on another gene. Sorted."""
    gene = gene_of_transcript(F.col("rname"))
    elements = F.transform(
        cg.supplementary(F.coalesce(F.col("sa"), F.lit(""))),
        lambda x: F.struct(gene_of_transcript(x["chrom"]).alias("gene"), cg.evaluate(cg.repair(x["cigar"]), x["nm"], x["start"], x["strand"])["similarity"].alias("similarity")),
    )
    good = F.filter(elements, lambda x: x["similarity"] >= F.lit(float(min_similarity)).cast("float"))
    by_sa = F.when(F.size(good) > 0, good[0]["gene"] != gene).otherwise(False)
    by_mate = ~has(F.col("flag"), MATE_UNMAPPED) & (gene_of_transcript(F.col("mate_rname")) != gene)
    return alignments.where(F.coalesce(by_sa, F.lit(False)) | F.coalesce(by_mate, F.lit(False))).select("qname").distinct().orderBy("qname")
