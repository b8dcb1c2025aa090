"""Exact lines of the writers, and the merge program from files to file."""

import glob

import pytest

from svloom import cli
from svloom.sinks import text

CALL = "query_name string, length long, fusion_point long, fusion_genes array<string>, fp_fuzzy long, fusion_distance long, support_sr long, support_sp long, sp_ratio double, a_chrom string, a_start long, a_end long, a_fp long, a_strand string, b_chrom string, b_start long, b_end long, b_fp long, b_strand string"


@pytest.fixture(scope="module")
def calls(spark):
    return spark.createDataFrame([("r1", 150, 70, ["A--B", "A--C"], 3, None, 4, 2, 0.5, "c1", 100, 169, 169, "+", "c2", 500, 580, 500, "+"), ("r2", 90, 40, ["NA--NA"], None, 20000, 1, 0, 0.0, "c1", 10, 60, 10, "-", "c1", 20060, 20100, 99999, ".")], CALL)


def values(df):
    return [r["value"] for r in df.collect()]


def test_tables(calls):
    sides = "c1\t101\t170\t170\t1\tc2\t501\t581\t501\t1"
    assert values(text.fragment_lines(calls))[0] == f"r1\t150\t71\tA--B;A--C\t3\t{sides}"
    assert values(text.paired_lines(calls))[0] == f"A--B;A--C\t3\tNA\t4\t2\t0.500\t{sides}"
    assert values(text.fragment_lines(calls))[1].split("\t")[4:] == ["NA", "c1", "11", "61", "11", "-1", "c1", "20061", "20101", "100000", "."]
    assert text.tsv_header(["a", "b"], "x")[-1] == "#a\tb"


def test_breakends(spark, calls):
    contigs = spark.createDataFrame([("c1", 50_000), ("c2", 1000)], "contig string, length long")
    got = sorted(values(text.vcf_lines(text.breakend_rows(calls, "P", contigs, None, True))))
    assert len(got) == 4
    first = next(x for x in got if "\tP.2.1\t" in x).split("\t")
    assert first[:5] == ["c1", "170", "P.2.1", "N", "N]c2:501]"] and first[6] == "."
    assert first[7] == "SVTYPE=BND;CIPOS=-3,3;GENE_FUSION=A--B,A--C;MATEID=P.2.2;SDP=6;SP=2;SR=4;FR=0.5"
    beyond = next(x for x in got if "\tP.1.2\t" in x).split("\t")  # moved to its contig's last base
    assert beyond[1] == "50000" and "CIPOS=-50000,50000" in beyond[7] and beyond[6] == "FAILED"


def test_fasta_and_bedpe(spark):
    df = spark.createDataFrame([("a", "b", "ACgt")], "id1 string, id2 string, sequence string")
    assert values(text.fasta_lines(df)) == [">a--b\nACgt"] and values(text.fasta_lines(df, True, "X")) == [">X_a\nACgt"]
    row = spark.createDataFrame([("c1", 1, 2, ".", -1, -1, "m;", 1, ".", ".", "DEL")], "chr1 string, s1 long, e1 long, chr2 string, s2 long, e2 long, name string, score long, strand1 string, strand2 string, type string")
    assert values(text.bedpe_lines(row)) == ["c1\t1\t2\t.\t-1\t-1\tm;\t1\t.\t.\tDEL"]


HEAD = ["##fileformat=VCFv4.2", "##contig=<ID=c1,length=9000>", "##contig=<ID=c2,length=9000>"]
CHROM = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"


def record(chrom, pos, id_, alt, state, info):
    return f"{chrom}\t{pos}\t{id_}\tN\t{alt}\t.\t{state}\t{info}"


A = [record("c1", 100, "a1.1", "N]c2:200]", "FAILED", "SVTYPE=BND;MATEID=a1.2;FRAG_ID=r"), record("c1", 5000, "a2.1", "N]c2:6000]", ".", "SVTYPE=BND;MATEID=a2.2;FRAG_ID=q"), record("c1", 7000, "a3.1", "N]c2:8000]", "FAILED", "SVTYPE=BND;MATEID=a3.2;FRAG_ID=z")]
B = [record("c1", 120, "b9.1", "N]c2:210]", ".", "SVTYPE=BND;MATEID=b9.2;SDP=5;SP=2;SR=3;FR=0.25;DP=8"), record("c1", 90, "b1.1", "N]c2:190]", "FAILED", "SVTYPE=BND;MATEID=b1.2;SDP=9;SP=1;SR=8;FR=0.5;DP=7"), record("c1", 3000, "b8.1", "N]c2:10]", ".", "SVTYPE=BND;MATEID=b8.2;SDP=1;SP=0;SR=1;FR=0.0;DP=1"), record("c1", 4000, "b3.1", "N]c2:10]", "FAILED", "SVTYPE=BND;MATEID=b3.2;SDP=1;SP=0;SR=1;FR=0.0;DP=1")]


def lines_of(folder):
    return [x for f in sorted(glob.glob(f"{folder}/part-*")) for x in open(f).read().splitlines()]


def test_merged_file(spark, tmp_path):
    for name, rows, more in (("a", A, []), ("b", B, ["##contig=<ID=c3,length=5>"])):
        (tmp_path / f"{name}.vcf").write_text("\n".join([*HEAD, *more, CHROM, *rows]) + "\n")
    paths = ["-a", str(tmp_path / "a.vcf"), "-b", str(tmp_path / "b.vcf")]
    cli.run(spark, ["merge", *paths, "-d", "SR,DP", "-o", str(tmp_path / "out")])
    got = lines_of(tmp_path / "out")
    head, rows = [x for x in got if x.startswith("#")], [x for x in got if not x.startswith("#")]
    assert head[:3] == HEAD and "##contig=<ID=c3,length=5>" in head and head[-1] == CHROM
    assert sum(x.startswith("##INFO=<ID=") for x in head) == 7  # TOPREAD, SDP, SP, SR, FR, EVI, DP
    assert rows == [
        record("c1", 100, "a1.1", "N]c2:200]", "PASS", "SVTYPE=BND;MATEID=a1.2;FRAG_ID=r;TOPREAD=b1.1;SDP=9;SP=1;SR=8;FR=0.5;DP=7;EVI=MED"),
        A[1] + ";EVI=MED",
        A[2] + ";EVI=LOW",
        B[3] + ";EVI=LOW",
        B[2] + ";EVI=MED",
    ]
    cli.run(spark, ["merge", *paths, "-s", "-n", "SEEN", "-o", str(tmp_path / "simple")])
    assert [x.rsplit(";", 1)[1] for x in lines_of(tmp_path / "simple") if not x.startswith("#")] == ["SEEN=1", "SEEN=0", "SEEN=0"]
