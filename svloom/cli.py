"""Command line: one sub-command per program. Results are folders of text parts, the header's part first."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from .plans import programs
from .sinks import text
from .sources import alignments, fasta, lists, vcf


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="svloom")
    subs = top.add_subparsers(dest="program", required=True)

    def add(name: str, help_: str, *options: tuple) -> None:
        p = subs.add_parser(name, help=help_)
        p.add_argument("-o", "--out", required=True, help="output folder")
        for flags, kind, default in options:
            if kind is bool:
                p.add_argument(*flags, action="store_true")
            else:
                p.add_argument(*flags, type=kind, default=default, required=default is ...)

    reads = [(("-b", "--bam"), str, ...), (("-g", "--gtf"), str, None), (("-m", "--feature"), str, "transcript"), (("-u", "--multi"), bool, False), (("-i", "--similarity"), float, 98.0), (("-w", "--max-distance"), int, 10_000), (("-s", "--stranded"), bool, False), (("-r", "--reference"), str, None), (("-f", "--vcf"), bool, False)]
    add("fragment", "fusion calls per read", *reads, (("-l", "--blacklist"), str, None), (("-d", "--ratio"), float, 0.1), (("-k", "--keep-all"), bool, False))
    add("paired", "fusion calls per position", *reads, (("-p", "--sr-range"), int, 5), (("-z", "--sp-range"), int, 500))
    add("fusion-reads", "names of reads on two genes", (("-b", "--bam"), str, ...), (("-i", "--similarity"), float, 98.0))
    add("cluster", "clusters over call files", (("-v", "--calls"), str, ...), (("-c", "--contigs"), str, ...), (("-f", "--is-list"), bool, False), (("-r", "--range"), int, 500), (("-m", "--multi-only"), bool, False), (("-p", "--purge"), bool, False), (("-u", "--unidirectional"), bool, False))
    add("subset", "calls in region pairs", (("-a", "--calls"), str, ...), (("-b", "--bedpe"), str, ...), (("-c", "--contigs"), str, None), (("-s", "--min-score"), int, None), (("-i", "--inverse"), bool, False))
    add("merge", "two call sets together", (("-a", "--first"), str, ...), (("-b", "--second"), str, ...), (("-c", "--range"), int, 500), (("-d", "--fields"), str, "SR"), (("-s", "--simple"), bool, False), (("-n", "--flag"), str, "SUPPORTED"))
    add("junctions", "junction sequences", (("-i", "--calls"), str, ...), (("-r", "--reference"), str, ...), (("-s", "--simple-id"), bool, False), (("-e", "--range"), int, 500), (("-p", "--prefix"), str, "InSilico"))
    add("chromosomes", "calls on or off chromosomes", (("-a", "--calls"), str, ...), (("-c", "--chroms"), str, ...), (("-i", "--remove"), bool, False))
    add("integration", "integration sites", (("-i", "--bed"), str, ...), (("-r", "--reference"), str, None), (("-m", "--host"), str, "human"), (("-n", "--foreign"), str, "muERV"), (("-w", "--overlap"), int, 10))
    add("correct", "repaired mate directions", (("-i", "--calls"), str, ...))
    return top


def run(spark: SparkSession, argv: list[str]) -> None:
    a = parser().parse_args(argv)
    command = " ".join(argv)
    if a.program in ("fragment", "paired"):
        common = dict(features=a.gtf, similarity=a.similarity, multi=a.multi, max_distance=a.max_distance, stranded=a.stranded, feature=a.feature)
        if a.program == "fragment":
            calls = programs.fragment_calls(spark, a.bam, blacklist=a.blacklist, ratio=a.ratio or None, keep_all=a.keep_all, **common)
            lines, columns = text.fragment_lines(calls), text.FRAGMENT_TSV
        else:
            calls = programs.paired_calls(spark, a.bam, sr_range=a.sr_range, sp_range=a.sp_range, **common)
            lines, columns = text.paired_lines(calls), text.PAIRED_TSV
        text.write_lines(lines, f"{a.out}/tsv", text.tsv_header(columns, command))
        if a.vcf and a.reference:
            paired = a.program == "paired"
            wanted = calls.select(F.explode(F.array(*[F.struct(F.col(f"{s}_chrom").alias("contig"), F.col(f"{s}_fp").alias("fp")) for s in "ab"])).alias("x")).select("x.*")
            contigs = fasta.contig_lengths(spark, a.reference)
            # a breakpoint beyond its contig moves to the last base
            at = F.least(F.col("fp"), F.col("length") - 1)
            wanted = wanted.join(F.broadcast(contigs), "contig").select("contig", at.alias("s"), (at + 1).alias("e"))
            ref = fasta.reference(spark, a.reference, wanted=wanted)
            listed = alignments.bam_contigs(a.bam) if a.bam.endswith(".bam") else {r["contig"]: r["length"] for r in contigs.collect()}
            rows = text.breakend_rows(calls, "FUSION_PID" if paired else "FUSION_FID", contigs, ref, paired)
            fields = ["SVTYPE", "CIPOS", "GENE_FUSION", "MATEID", *(["SDP", "SP", "SR", "FR"] if paired else ["FRAG_ID", "FRAG_POS"])]
            text.write_lines(text.vcf_lines(rows), f"{a.out}/vcf", text.vcf_header(listed, fields, command))
    elif a.program == "fusion-reads":
        text.write_lines(programs.linking_reads(spark, a.bam, a.similarity).select(F.col("qname").alias("value")), a.out)
    elif a.program == "cluster":
        text.write_lines(text.bedpe_lines(programs.cluster_calls(spark, a.calls, a.contigs, a.range, a.is_list, a.multi_only, a.purge, a.unidirectional)), a.out)
        if unknown := vcf.unknown(vcf.records(spark, lists.paths(spark, a.calls, a.is_list))):
            print(f"{unknown} records are no paired breakend, insertion or deletion and were left out", file=sys.stderr)
    elif a.program in ("subset", "chromosomes", "correct"):
        if a.program == "subset":
            rows = programs.subset_calls(spark, a.calls, a.bedpe, a.contigs, a.min_score, a.inverse)
        elif a.program == "chromosomes":
            rows = programs.chromosome_calls(spark, a.calls, a.chroms, a.remove)
        else:
            rows = programs.corrected_calls(spark, a.calls)
        head = vcf.header(spark, a.calls)
        kept = Observation("lines")
        lines = rows.observe(kept, F.count("*").alias("kept")).select(F.col("line").alias("value"))
        text.write_lines(lines, a.out, [*head[:-1], f"##command={command}", *head[-1:]])
        total = vcf.records(spark, a.calls).count()
        print(f"{kept.get['kept']} records kept, {total - kept.get['kept']} removed", file=sys.stderr)
    elif a.program == "merge":
        fields = [x for x in a.fields.split(",") if x and x not in ("SDP", "SP", "SR", "FR")]
        head, lines = programs.merged_lines(spark, a.first, a.second, a.range, fields, a.flag if a.simple else None)
        text.write_lines(lines, a.out, [*head[:-1], f"##command={command}", *head[-1:]])
    elif a.program == "junctions":
        text.write_lines(text.fasta_lines(programs.junctions(spark, a.calls, a.reference, a.range), a.simple_id, a.prefix), a.out)
    elif a.program == "integration":
        rows = programs.integration_calls(spark, a.bed, a.reference, a.host, a.foreign, a.overlap)
        contigs = {r["contig"]: r["length"] for r in fasta.contig_lengths(spark, a.reference).collect()} if a.reference else {}
        text.write_lines(text.vcf_lines(rows), a.out, text.vcf_header(contigs, ["SVTYPE", "Contig_ID", "ReadFragRef", "ReadFragAlien"], command))


if __name__ == "__main__":
    run(SparkSession.builder.appName("svloom").getOrCreate(), sys.argv[1:])
