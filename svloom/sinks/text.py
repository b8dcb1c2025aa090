"""Text sinks: VCF, BEDPE, TSV and FASTA lines with their headers.

A result is a folder of parts in order, the header's first, so that the parts one after the other are the file; ``single`` makes one part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bnd
from ..operators.evidence import quality_flag


def write_lines(lines: DataFrame, path: str, header: list[str] = (), single: bool = False) -> None:
    """lines(value) to a folder."""
    out = lines.select("value")
    if header:
        out = lines.sparkSession.createDataFrame([("\n".join(header),)], "value string").coalesce(1).union(out)
    (out.coalesce(1) if single else out).write.mode("overwrite").text(path)


def tab(*columns: Column) -> Column:
    """Fields with tabs between; null is NA."""
    return F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit("NA")) for c in columns])


def bedpe_lines(rows: DataFrame) -> DataFrame:
    return rows.select(tab(*[F.col(c) for c in ("chr1", "s1", "e1", "chr2", "s2", "e2", "name", "score", "strand1", "strand2", "type")]).alias("value"))


def sign(strand: Column) -> Column:
    return F.when(strand == "+", "1").when(strand == "-", "-1").otherwise(".")


def side(s: str) -> list[Column]:
    """Chromosome, start, end, breakpoint (from 1) and strand of a call's side."""
    return [F.col(f"{s}_chrom"), F.col(f"{s}_start") + 1, F.col(f"{s}_end") + 1, F.col(f"{s}_fp") + 1, sign(F.col(f"{s}_strand"))]


FRAGMENT_TSV = ["query_name", "length", "fusion_point", "fusion_genes", "fp_fuzzy", *[f"{s}_{c}" for s in "ab" for c in ("chrom", "start", "end", "fp", "strand")]]
PAIRED_TSV = ["fusion_genes", "fp_fuzzy", "fusion_distance", "sr_support", "sp_support", "sp_ratio", *[f"{s}_{c}" for s in "ab" for c in ("chrom", "start", "end", "fp", "strand")]]


def genes_text(df: DataFrame) -> Column:
    return F.array_join("fusion_genes", ";") if "fusion_genes" in df.columns else F.col("genes")


def fragment_lines(calls: DataFrame) -> DataFrame:
    return calls.select(tab(F.col("query_name"), F.col("length"), F.col("fusion_point") + 1, genes_text(calls), F.col("fp_fuzzy"), *side("a"), *side("b")).alias("value"))


def paired_lines(calls: DataFrame) -> DataFrame:
    return calls.select(tab(genes_text(calls), F.col("fp_fuzzy"), F.col("fusion_distance"), F.col("support_sr"), F.col("support_sp"), F.format_string("%.3f", "sp_ratio"), *side("a"), *side("b")).alias("value"))


def tsv_header(columns: list[str], command: str = "", version: str = "1") -> list[str]:
    """Four lines of facts, then the column names."""
    from email.utils import localtime, format_datetime

    return [f"##version={version}", f"##command={command}", f"##date={format_datetime(localtime())}", "##coordinates=1-based", "#" + "\t".join(columns)]


# INFO fields of the VCF outputs and what they say.
INFO = {
    "SVTYPE": ("1", "String", "Type of structural variant"),
    "CIPOS": ("2", "Integer", "Confidence interval around POS"),
    "GENE_FUSION": (".", "String", "Pairs of genes that the call joins"),
    "FRAG_ID": ("1", "String", "Name of the fragment"),
    "FRAG_POS": ("1", "Integer", "Position of the breakpoint in the fragment"),
    "MATEID": (".", "String", "ID of the mate breakend"),
    "SDP": ("1", "Integer", "Split reads and split pairs together"),
    "SP": ("1", "Integer", "Split pairs"),
    "SR": ("1", "Integer", "Split reads"),
    "FR": ("1", "Float", "Support by depth"),
    "EVI": ("1", "String", "Grade of the evidence"),
    "TOPREAD": ("1", "String", "ID of the best matching call"),
    "Contig_ID": ("1", "String", "Name of the contig"),
    "ReadFragRef": ("2", "Integer", "Part of the read on the host"),
    "ReadFragAlien": ("2", "Integer", "Part of the read on the foreign sequence"),
}


def info_line(field: str) -> str:
    number, kind, what = INFO[field]
    return f'##INFO=<ID={field},Number={number},Type={kind},Description="{what}">'


def vcf_header(contigs: dict[str, int], fields: list[str], command: str = "", more: list[str] = ()) -> list[str]:
    out = ["##fileformat=VCFv4.2", *more]
    out += [f"##contig=<ID={c},length={n}>" for c, n in contigs.items()]
    out += [info_line(k) for k in fields if k in INFO]
    out += ['##FILTER=<ID=FAILED,Description="Imprecise or poorly supported">'] + [f"##command={command}"] * bool(command)
    return [*out, "#" + "\t".join(["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"])]


def info_text(**fields: Column) -> Column:
    """key=value fields; null ones are left out."""
    return F.concat_ws(";", *[F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), v.cast("string"))) for k, v in fields.items()])


def vcf_lines(rows: DataFrame) -> DataFrame:
    """rows(chrom, pos from 0, id, ref, alt, filter, info) as lines; null is a point."""
    fields = [F.col("chrom"), (F.col("pos") + 1).cast("string"), *[F.col(c) for c in ("id", "ref", "alt")], F.lit("."), F.col("filter"), F.col("info")]
    return rows.select(F.concat_ws("\t", *[F.coalesce(c, F.lit(".")) for c in fields]).alias("value"))


def breakend_rows(calls: DataFrame, prefix: str, contigs: DataFrame, reference: DataFrame | None, paired: bool) -> DataFrame:
    """Two records for each call, numbered by position. A breakpoint beyond its contig moves to the last base, and CIPOS grows by that.

    REF is the base at the position, N without a reference."""
    from pyspark.sql import Window

    from ..operators.integrate import fetched

    order = [f"{s}_{c}" for s in "ab" for c in ("chrom", "fp", "start", "end", "strand")]
    # numbers in the order of the calls: counts per range partition, not one window over all rows
    ranged = calls.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()).withColumn("__p", F.shiftright("__m", 33))
    counts = ranged.groupBy("__p").agg(F.count("*").alias("__n"))
    base = counts.withColumn("__base", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__p", "__base")
    numbered = ranged.join(F.broadcast(base), "__p").withColumn("n", F.col("__base") + F.col("__m").bitwiseAND((1 << 33) - 1) + 1).drop("__m", "__p", "__base")
    fuzzy = F.coalesce(F.col("fp_fuzzy"), F.lit(0))
    out = None
    for me, you, k in (("a", "b", 1), ("b", "a", 2)):
        rows = numbered
        for s in (me, you):
            rows = rows.join(F.broadcast(contigs).select(F.col("contig").alias(f"{s}_chrom"), F.col("length").alias(f"{s}_len")), f"{s}_chrom", "left")
            over = F.greatest(F.col(f"{s}_fp") - F.col(f"{s}_len") + 1, F.lit(0))
            rows = rows.withColumn(f"{s}_over", F.coalesce(over, F.lit(0))).withColumn(f"{s}_at", F.col(f"{s}_fp") - F.col(f"{s}_over"))
        cipos = F.concat_ws(",", (-(fuzzy + F.col(f"{me}_over"))).cast("string"), (fuzzy + F.col(f"{me}_over")).cast("string"))
        fields = {"SVTYPE": F.lit("BND"), "CIPOS": cipos, "GENE_FUSION": F.regexp_replace(genes_text(calls), ";", ","), "MATEID": F.concat(F.lit(f"{prefix}."), "n", F.lit(f".{3 - k}"))}
        if paired:
            fields |= {"SDP": F.col("support_sr") + F.col("support_sp"), "SP": F.col("support_sp"), "SR": F.col("support_sr"), "FR": F.round("sp_ratio", 6)}
            flag = quality_flag(F.col("fp_fuzzy"), F.col("support_sr") + F.col("support_sp"), F.col("sp_ratio"))
        else:
            fields |= {"FRAG_ID": F.col("query_name"), "FRAG_POS": F.col("fusion_point") + 1}
            flag = quality_flag(F.col("fp_fuzzy"))
        one = rows.select(F.col(f"{me}_chrom").alias("chrom"), F.col(f"{me}_at").alias("pos"), F.concat(F.lit(f"{prefix}."), "n", F.lit(f".{k}")).alias("id"), F.col(f"{you}_chrom").alias("m_chrom"), F.col(f"{you}_at").alias("m_pos"), F.col(f"{me}_strand").alias("d1"), F.col(f"{you}_strand").alias("d2"), flag.alias("filter"), info_text(**fields).alias("info"))
        out = one if out is None else out.unionByName(one)
    if reference is None:
        out = out.withColumn("ref", F.lit("N"))
    else:
        bases = fetched(out.select(F.col("id").alias("span"), F.col("chrom").alias("contig"), F.col("pos").alias("s"), (F.col("pos") + 1).alias("e")), reference)
        out = out.join(bases.select(F.col("span").alias("id"), F.upper("seq").alias("ref")), "id", "left").withColumn("ref", F.coalesce("ref", F.lit("N")))
    return out.withColumn("alt", bnd.format_alt(F.col("ref"), F.col("m_chrom"), F.col("m_pos"), F.col("d1"), F.col("d2")))


def site_rows(sites: DataFrame, kind: str, reference: DataFrame | None) -> DataFrame:
    """Integration sites as single breakends, with the base at the site."""
    from ..operators.integrate import fetched

    rows = sites.withColumn("id", F.concat(F.lit(f"{kind}_"), "read"))
    if reference is None:
        rows = rows.withColumn("ref", F.lit("N"))
    else:
        bases = fetched(rows.select(F.col("id").alias("span"), F.col("chrom").alias("contig"), F.col("site").alias("s"), (F.col("site") + 1).alias("e")), reference)
        rows = rows.join(bases.select(F.col("span").alias("id"), F.upper("seq").alias("ref")), "id", "left").withColumn("ref", F.coalesce("ref", F.lit("N")))
    info = info_text(SVTYPE=F.lit("BND"), Contig_ID=F.col("read"), ReadFragRef=F.concat_ws(",", F.col("ref_start").cast("string"), F.col("ref_end").cast("string")), ReadFragAlien=F.concat_ws(",", F.col("alien_start").cast("string"), F.col("alien_end").cast("string")))
    return rows.select("chrom", F.col("site").alias("pos"), "id", "ref", bnd.format_single(F.col("ref"), F.col("direction")).alias("alt"), F.lit(".").alias("filter"), info.alias("info"))


def fasta_lines(sequences: DataFrame, simple_ids: bool = False, prefix: str = "InSilico") -> DataFrame:
    """id1, id2, sequence (and description, if there) as two lines each."""
    name = F.concat(F.lit(f"{prefix}_"), "id1") if simple_ids else F.concat_ws("--", "id1", "id2")
    more = F.concat(F.lit(" "), "description") if "description" in sequences.columns else F.lit("")
    return sequences.select(F.concat(F.lit(">"), name, more, F.lit("\n"), "sequence").alias("value"))
