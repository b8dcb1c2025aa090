"""The programs: readers, operators and writers put together, one function each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bnd
from ..operators import annotate, cluster, evidence, integrate, merge, subset, support
from ..sinks import text
from ..sources import alignments as al
from ..sources import bed, bedpe, fasta, gtf, lists, vcf


def read_alignments(spark: SparkSession, path: str, **options) -> DataFrame:
    """Alignments of a BAM or SAM file; the options are those of the BAM source."""
    return al.bam(spark, path, **options) if path.endswith(".bam") else al.sam(spark, path)


def fragment_calls(spark: SparkSession, reads: str | DataFrame, features: str | None = None, similarity: float = 98.0, multi: bool = False, blacklist: str | None = None, max_distance: int = 10_000, stranded: bool = False, ratio: float | None = 0.1, keep_all: bool = False, feature: str = "transcript") -> DataFrame:
    """Fusion calls per read or contig."""
    rows = reads if isinstance(reads, DataFrame) else read_alignments(spark, reads, require_sa=True, skip_flags=evidence.SECONDARY | evidence.PAIRED | evidence.UNMAPPED)
    rows = evidence.passing(rows, "fragment", multi, lists.names(spark, blacklist) if blacklist else None)
    found = evidence.pruned(evidence.oriented_evidence(evidence.split_pairs(rows, similarity, ratio or None)), keep_all)
    calls = evidence.fragment_calls(found, max_distance, features is not None)
    if features is None:
        return calls.withColumn("fusion_genes", F.array("genes"))
    calls = calls.withColumn("call", F.monotonically_increasing_id())  # staged with the calls
    return annotate.annotated(calls, annotate.used_features(gtf.features(spark, features, feature), calls), stranded).drop("call")


def paired_calls(spark: SparkSession, reads: str | DataFrame, features: str | None = None, similarity: float = 98.0, multi: bool = False, max_distance: int = 10_000, stranded: bool = False, sr_range: int = 5, sp_range: int = 500, feature: str = "transcript") -> DataFrame:
    """Fusion calls per position, from read pairs."""
    rows = reads if isinstance(reads, DataFrame) else read_alignments(spark, reads)
    good = evidence.passing(rows, "paired", multi)
    found = evidence.pruned(evidence.oriented_evidence(evidence.split_pairs(good, similarity, None)))
    positions = support.with_support(support.collapsed(found, sr_range, stranded), al.with_ends(rows.where(~evidence.has(F.col("flag"), evidence.UNMAPPED))), sp_range)
    calls = evidence.position_calls(positions, max_distance, features is not None)
    if features is None:
        return calls.withColumn("fusion_genes", F.array("genes"))
    calls = calls.withColumn("call", F.monotonically_increasing_id())  # staged with the calls
    return annotate.annotated(calls, annotate.used_features(gtf.features(spark, features, feature), calls), stranded).drop("call")


def linking_reads(spark: SparkSession, reads: str, similarity: float = 98.0) -> DataFrame:
    """Sorted distinct names of reads on two genes, from alignments to transcripts."""
    return integrate.linking_reads(evidence.passing(read_alignments(spark, reads), "transcript"), similarity)


def cluster_calls(spark: SparkSession, path: str, contigs: str, distance: int = 500, is_list: bool = False, multi_only: bool = False, purge: bool = False, unidirectional: bool = False) -> DataFrame:
    """BEDPE rows of clusters over one or many call files."""
    found = vcf.variants(vcf.records(spark, lists.paths(spark, path, is_list)), lists.contig_lengths(spark, contigs), unidirectional)
    pairs = found["pairs"]
    # the files hold both records of each pair; each gives its own oriented row
    clusters = cluster.summarised(cluster.refine(cluster.cluster_pairs(pairs.drop("rec_idx", "name"), distance), distance), purge=purge, multi_only=multi_only)
    return cluster.bedpe_pairs(cluster.collapse(clusters)).unionByName(cluster.bedpe_indels(cluster.indel_clusters(found["indels"], distance, purge, multi_only)))


def mated(records: DataFrame) -> DataFrame:
    """Records with their mates by MATEID, one row per pair (the smaller id first): x, y."""
    rows = records.withColumn("mate_id", F.col("info")["MATEID"])
    a, b = (rows.select(F.struct(*rows.columns).alias(n)) for n in ("x", "y"))
    return a.join(b, (F.col("x.id") == F.col("y.mate_id")) & (F.col("y.id") == F.col("x.mate_id")) & (F.col("x.id") < F.col("y.id")))


def adjacent(records: DataFrame) -> DataFrame:
    """Records with their mates, one row per pair, the first in the file as x: x, y. Every record must name a mate that names it, and every
    id be there once; anything else is an error. One exchange by the pair of ids, no self-join."""
    rows = records.withColumn("mate_id", F.col("info")["MATEID"])
    named = F.col("id").isNotNull() & (F.coalesce("mate_id", F.lit("")) != "") & (F.col("id") != F.col("mate_id"))
    id_ = F.when(named, F.col("id")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("record without id or mate:"), "line"))).cast("string")
    rows = rows.withColumn("id", id_)
    pair = [F.least("id", "mate_id").alias("lo"), F.greatest("id", "mate_id").alias("hi")]
    row = F.struct(*rows.columns)
    both = rows.groupBy(*pair).agg(F.min_by(row, "rec_idx").alias("x"), F.max_by(row, "rec_idx").alias("y"), F.count("*").alias("n"))
    fine = (F.col("n") == 2) & (F.col("x.id") == F.col("y.mate_id")) & (F.col("y.id") == F.col("x.mate_id"))
    return both.where(F.when(fine, True).otherwise(F.raise_error(F.concat_ws(" ", F.lit("records are not mates of each other:"), "lo", "hi")).cast("boolean"))).select("x", "y")


def subset_calls(spark: SparkSession, path: str, regions: str, contigs: str | None = None, min_score: int | None = None, inverse: bool = False) -> DataFrame:
    """Original lines of the breakend pairs that match region pairs, in the natural order of their ids: id, line."""
    p = mated(vcf.records(spark, path)).withColumns({"a1": bnd.parse_alt(F.col("x.alt")[0]), "a2": bnd.parse_alt(F.col("y.alt")[0])})
    pairs = p.select(F.col("x.id").alias("id"), F.col("y.id").alias("id2"), F.col("x.chrom").alias("chr1"), F.col("x.pos").alias("pos1"), F.col("a1.dir1").alias("f1"), F.col("y.chrom").alias("chr2"), F.col("y.pos").alias("pos2"), F.col("a2.dir1").alias("f2"), F.col("x.line").alias("line1"), F.col("y.line").alias("line2"))
    areas = bedpe.regions(spark, regions, lists.contig_lengths(spark, contigs) if contigs else None, min_score).where("type = 'BND_PAIR'")
    kept = subset.by_region_pairs(pairs, areas, inverse)
    rows = kept.select(F.explode(F.array(F.struct("id", F.col("line1").alias("line")), F.struct(F.col("id2").alias("id"), F.col("line2").alias("line")))).alias("r")).select("r.*")
    return rows.orderBy(bnd.natural_key(F.col("id")))


def merge_calls(spark: SparkSession, path_a: str, path_b: str, reach: int = 500, fields: list[str] = (), simple: bool = False) -> DataFrame:
    """All calls of A with the best of B, then the rest of B."""
    merge.reconciled(vcf.contigs_of(vcf.header(spark, path_a)), vcf.contigs_of(vcf.header(spark, path_b)))
    a, b = vcf.call_set(vcf.records(spark, path_a), "a", simple), vcf.call_set(vcf.records(spark, path_b), "b", simple)
    if simple:
        return merge.supported(a, b, reach)
    b = b.select("*", *[F.col("info")[f].alias(f) for f in fields]).drop("info")
    return merge.merged(a, b, reach, list(fields))


def merged_lines(spark: SparkSession, path_a: str, path_b: str, reach: int = 500, fields: list[str] = (), flag: str | None = None) -> tuple[list[str], DataFrame]:
    """(header, lines(value) in order) of the merged call file: the lines of A in their order, with what the best B says appended to INFO, then
    the rest of B by id. A call of both that had failed passes; other filters stay. With a ``flag`` only A's lines, the flag 0 or 1."""
    head_a, head_b = vcf.header(spark, path_a), vcf.header(spark, path_b)
    merge.reconciled(vcf.contigs_of(head_a), vcf.contigs_of(head_b))
    out = merge_calls(spark, path_a, path_b, reach, fields, flag is not None)
    if flag:
        out = out.select(F.lit("A").alias("source"), F.col("a_id").alias("id"), F.lit(False).alias("passes"), text.info_text(**{flag: F.col("supported")}).alias("more"))
    else:
        numbers = {"TOPREAD": "topread"} | {k.upper(): k for k in ("sdp", "sp", "sr", "fr")} | {f: f for f in fields}
        best = F.col("topread").isNotNull()
        out = out.select("source", "id", best.alias("passes"), text.info_text(**{k: F.when(best, F.col(c)) for k, c in numbers.items()}, EVI=F.col("evidence")).alias("more"))
    rows = None
    for source, path in (("A", path_a), ("B", path_b)):
        one = vcf.records(spark, path).select(F.lit(source).alias("source"), "id", "rec_idx", F.split("line", "\t").alias("f"), F.coalesce(F.col("filter").contains("FAILED"), F.lit(False)).alias("failed"))
        rows = one if rows is None else rows.unionByName(one)
    rows = rows.join(out, ["source", "id"])
    state = F.when(F.col("passes") & F.col("failed"), "PASS").otherwise(F.col("f")[6])
    info = F.when(F.col("f")[7] == ".", F.col("more")).otherwise(F.concat_ws(";", F.col("f")[7], "more"))
    line = F.array_join(F.concat(F.slice("f", 1, 6), F.array(state, info), F.slice("f", 9, F.size("f"))), "\t")
    lines = rows.orderBy("source", F.when(F.col("source") == "A", F.col("rec_idx")), "id").select(line.alias("value"))
    known = "\n".join(head_a)
    listed = vcf.contigs_of(head_a)
    added = [f"##contig=<ID={c},length={n}>" for c, n in vcf.contigs_of(head_b).items() if c not in listed]
    wanted = [] if flag else ["TOPREAD", "SDP", "SP", "SR", "FR", "EVI"]
    added += [text.info_line(k) for k in wanted if f"##INFO=<ID={k}," not in known]
    added += [f'##INFO=<ID={f},Number=1,Type=Integer,Description="none">' for f in fields if not flag and f"##INFO=<ID={f}," not in known]
    added += [f'##INFO=<ID={flag},Number=1,Type=Integer,Description="Support by the other call set">'] * bool(flag)
    return [*head_a[:-1], *added, *head_a[-1:]], lines


def junctions(spark: SparkSession, path: str, reference: str, reach: int = 500) -> DataFrame:
    """id1, id2, sequence of each breakend pair, the first in the file as id1. Records that are not mates of each other are an error."""
    p = adjacent(vcf.records(spark, path)).withColumns({"a1": bnd.parse_alt(F.col("x.alt")[0]), "a2": bnd.parse_alt(F.col("y.alt")[0])})
    pairs = p.select(F.col("x.id").alias("id1"), F.col("y.id").alias("id2"), F.col("x.chrom").alias("chr1"), F.col("x.pos").alias("p1"), F.col("a1.dir1").alias("d1"), F.col("y.chrom").alias("chr2"), F.col("y.pos").alias("p2"), F.col("a2.dir1").alias("d2"))
    wanted = None
    for c, p in (("chr1", "p1"), ("chr2", "p2")):
        near = pairs.select(F.col(c).alias("contig"), (F.col(p) - reach).alias("s"), (F.col(p) + reach + 1).alias("e"))
        wanted = near if wanted is None else wanted.unionByName(near)
    return integrate.junction_sequences(pairs, fasta.reference(spark, reference, wanted=wanted), reach)


def chromosome_calls(spark: SparkSession, path: str, chroms: str, remove: bool = False) -> DataFrame:
    """Original lines of the records on (or off) the listed chromosomes, mates included, in order."""
    rows = vcf.records(spark, path)
    keep = subset.by_chromosome(rows.select("id", "chrom", F.col("info")["MATEID"].alias("mate_id"), "rec_idx", "line"), lists.names(spark, chroms, "chrom"), remove)
    return keep.orderBy("rec_idx").select("id", "line")


def integration_calls(spark: SparkSession, path: str, reference: str | None = None, host: str = "human", foreign: str = "muERV", overlap: int = 10, kind: str = "INTEGRATION_ID") -> DataFrame:
    """VCF rows of integration sites."""
    sites = integrate.integration_sites(bed.lines(spark, path), host, foreign, overlap)
    wanted = sites.select(F.col("chrom").alias("contig"), F.col("site").alias("s"), (F.col("site") + 1).alias("e"))
    return text.site_rows(sites, kind, fasta.reference(spark, reference, wanted=wanted) if reference else None)


def corrected_mates(records: DataFrame) -> DataFrame:
    """records(id, mate_id, alt, ...) with the mate's direction in ALT taken from the mate's own record."""
    own = records.withColumn("x", bnd.parse_alt(F.col("alt")))
    mates = own.select(F.col("id").alias("mate_id"), F.col("x.dir1").alias("mate_dir"))
    fixed = own.join(mates, "mate_id", "left")
    alt = bnd.format_alt(F.col("x.nucleotide"), F.col("x.chr"), F.col("x.pos"), F.col("x.dir1"), F.coalesce("mate_dir", "x.dir2"))
    return fixed.withColumn("alt", F.when(F.col("mate_dir").isNotNull(), alt).otherwise(F.col("alt"))).select(records.columns)


def corrected_calls(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a call file with repaired mate directions, in order."""
    rows = vcf.records(spark, path).select("rec_idx", "id", F.col("info")["MATEID"].alias("mate_id"), F.col("alt")[0].alias("alt"), "line")
    fields = F.split("line", "\t")
    line = F.array_join(F.concat(F.slice(fields, 1, 4), F.array("alt"), F.slice(fields, 6, 1000)), "\t")
    return corrected_mates(rows).orderBy("rec_idx").select("id", line.alias("line"))
