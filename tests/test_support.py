"""Split pairs against a brute force over all reads, with namesakes that are many and without."""

import random

import pytest

from svloom.operators.support import both_windows, split_pair_support

POSITION = "pos long, chrom_pr string, chrom_sa string, target_break_pr long, target_break_sa long, strand_pr string, strand_sa string, up_pr boolean, up_sa boolean"
READ = "qname string, flag int, chrom string, aln_start long, aln_end long, mate_rname string"


def rows():
    rng = random.Random(3)
    chrom = lambda: rng.choice("12")
    positions = [(i, chrom(), chrom(), rng.randrange(3000), rng.randrange(3000), rng.choice("+-"), rng.choice("+-"), rng.random() < 0.5, rng.random() < 0.5) for i in range(80)]
    positions.append((80, "1", "1", 0, 40, "+", "+", True, True))
    reads = []
    for i in range(700):
        name = None if i % 50 == 0 else "hot" if i % 3 == 0 else f"q{rng.randrange(60)}"
        start = rng.randrange(3000)
        reads.append((name, 8 if i % 11 == 0 else 0, chrom(), start, start + rng.randrange(300), None if i % 37 == 0 else chrom()))
    return positions, reads


def brute(both, reads):
    out = {}
    for p in both:
        names = []
        for side, other in (("pr", "sa"), ("sa", "pr")):
            a, b = p[f"{side}_start"], p[f"{side}_end"]
            names.append({n for n, f, c, s, e, m in reads if n and m and not f & 8 and c == p[f"chrom_{side}"] and m == p[f"chrom_{other}"] and a < b and a < e and s < b})
        if n := len(names[0] & names[1]):
            out[p["pos"]] = n
    return out


@pytest.mark.parametrize("many", [0, 32, 10**6])
def test_split_pairs(spark, many):
    positions, reads = rows()
    spots, alignments = spark.createDataFrame(positions, POSITION), spark.createDataFrame(reads, READ)
    expected = brute(both_windows(spots).collect(), reads)
    got = split_pair_support(spots, alignments, many=many).collect()
    assert len(got) == len(expected) > 40
    assert {r["pos"]: r["support_sp"] for r in got} == expected


def test_no_rows(spark):
    positions, reads = rows()
    spots, alignments = spark.createDataFrame(positions, POSITION), spark.createDataFrame(reads, READ)
    assert split_pair_support(spots.limit(0), alignments).count() == 0
    assert split_pair_support(spots, alignments.limit(0)).count() == 0
