"""Column functions against known values."""

import pytest
from pyspark.sql import functions as F

from svloom.functions import bnd, sequence, stats
from svloom.functions import cigar as cg
from svloom.operators import cluster, evidence, integrate, intervals, subset

EVALUATED = [
    ("18M3D2M2D2M1I22M", 1, 1, "+", None),
    ("2172H7M73I19407N116M2836N102M2789N131M2751N101M9693N300M", 0, 68346459, "-", (2172, 0, 3002, 757, 38233, 91.314835, 68346459, 829, 68384691)),
    ("1539M2583N129M831S", 0, 117824209, "+", (0, 831, 2499, 1668, 4251, 100.0, 117828459, 1667, 117828459)),
    ("102S120M", 0, 46288851, "-", (102, 0, 222, 120, 120, 100.0, 46288851, 119, 46288970)),
    ("119H103M", 0, 132018176, "+", (119, 0, 222, 103, 103, 100.0, 132018176, 119, 132018278)),
    ("1066H624M", 0, 134086443, "+", (1066, 0, 1690, 624, 624, 100.0, 134086443, 1066, 134087066)),
    ("50M25S", 0, 0, "+", (0, 25, 75, 50, 50, 100.0, 49, 49, 49)),
    ("50S25M", 0, 49, "-", (50, 0, 75, 25, 25, 100.0, 49, 24, 73)),
    ("*", 0, 49, "-", None),
]


def test_cigar(spark):
    df = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(EVALUATED)], "i int, cigar string, nm long, start long, strand string")
    args = [F.col(c) for c in ("cigar", "nm", "start", "strand")]
    both = cg.evaluated(df, "a", *args).withColumn("b", cg.evaluate(*args)).orderBy("i").collect()
    for r, (*_, expected) in zip(both, EVALUATED, strict=True):
        assert r["a"] == r["b"]
        if expected is None:
            assert r["a"] is None
            continue
        got = [r["a"][c] for c in ("upstream", "downstream", "seq_length", "match_length", "match_length_s", "similarity", "fp_target", "fp_query", "aln_end")]
        assert got == pytest.approx(expected, rel=1e-6)


def test_similarity_and_repair(spark):
    df = spark.createDataFrame([("18M3D2M2D2M1I22M", 44, 1, 0, None), ("544S692M1190N1796M", 2488, 0, 3032, "544S692M1190N1796M"), ("545M245D2487S", 1, 0, 3277, "545M2732S"), ("2172S830M37403D", 1, 0, 3002, "2172S830M")], "c string, m long, x long, n long, fixed string")
    rows = df.select("*", cg.similarity(F.col("c"), F.col("m"), F.col("x")).alias("s"), cg.repair(F.col("c"), F.col("n")).alias("f")).collect()
    assert rows[0]["s"] == pytest.approx(91.489365) and rows[1]["s"] == 100
    assert all(r["fixed"] in (None, r["f"]) for r in rows)


@pytest.mark.parametrize(("args", "expected"), [
    ((7554, 2850, 3000, 5050, 7554, ".", None), None),
    ((92, 0, 150, 58, 0, "-", None), (57, 0, 0, 57)),
    ((0, 25, 75, 50, 0, "+", None), (49, 49, 0, 49)),
    ((50, 5, 75, 25, 49, "-", None), (24, 49, 49, 73)),
    ((50, 5, 75, 25, 49, "-", 0.9), (24, 49, 49, 73)),
    ((50, 5, 75, 25, 49, "-", 0.05), None),
])
def test_geometry(spark, args, expected):
    got = spark.range(1).select(cg.geometry(*[F.lit(x) for x in args[:6]], args[6]).alias("g")).first()["g"]
    assert (None if got is None else tuple(got)) == expected


def test_alt(spark):
    truths = [("G]chr16:18804692]", "G", "chr16", 18804691, "+", "+"), ("[chr19:50193168[A", "A", "chr19", 50193167, "-", "-"), ("G[chr16:18804692[", "G", "chr16", 18804691, "+", "-"), ("]chr19:50193168]A", "A", "chr19", 50193167, "-", "+"), ("A.", "A", "", 0, "+", "."), (".C", "C", "", 0, "-", ".")]
    df = spark.createDataFrame([(t[0],) for t in truths], "alt string").select("alt", bnd.parse_alt(F.col("alt")).alias("x"))
    for r, t in zip(df.collect(), truths, strict=True):
        assert tuple(r["x"]) == t[1:]
    back = df.where("x.chr <> ''").select("alt", bnd.format_alt(*[F.col(f"x.{c}") for c in ("nucleotide", "chr", "pos", "dir1", "dir2")]).alias("again")).collect()
    assert all(r["alt"] == r["again"] for r in back)
    assert spark.range(1).select(bnd.parse_alt(F.lit("<DEL>")).alias("x")).first()["x"] is None


def test_mates(spark):
    from svloom.plans.programs import corrected_mates

    rows = [("a1", "a2", "G]chr13:21176536]"), ("a2", "a1", "[chr19:3053319[C"), ("b1", "b2", "G]chr7:137513870]"), ("b2", "b1", "G]chr21:31668501]")]
    got = {r["id"]: r["alt"] for r in corrected_mates(spark.createDataFrame(rows, "id string, mate_id string, alt string")).collect()}
    assert got == {"a1": "G[chr13:21176536[", "a2": "]chr19:3053319]C", "b1": "G]chr7:137513870]", "b2": "G]chr21:31668501]"}


def test_sequence(spark):
    s = F.lit("GTAGGCTGAAAACCCC")
    row = spark.range(1).select(sequence.piece(s, F.lit(10), F.lit(0)).alias("a"), sequence.piece(s, F.lit(0), F.lit(20)).alias("b"), sequence.oriented(sequence.piece(s, F.lit(0), F.lit(20)), "fwd_complement").alias("c"), sequence.oriented(sequence.piece(s, F.lit(0), F.lit(10)), "rev").alias("d"), sequence.oriented(sequence.piece(s, F.lit(0), F.lit(10)), "rev_complement").alias("e")).first()
    assert tuple(row) == ("GTAGGCTGAA", "GTAGGCTGAAAACCCC", "CATCCGACTTTTGGGG", "AAGTCGGATG", "TTCAGCCTAC")


def test_stats(spark):
    df = spark.createDataFrame([(x,) for x in (5, 6, 10, 20, 3)], "x long")
    assert df.agg(stats.upper_median("x").alias("m")).first()["m"] == 6
    assert df.where("x < 20").agg(stats.upper_median("x").alias("m")).first()["m"] == 6
    score = lambda *a: tuple(spark.range(1).select(*[c.alias(str(i)) for i, c in enumerate(stats.overlap_score(*[F.lit(x) for x in a], True))]).first())
    assert score(500, 1000, "+", 750, 1250, "+") == (250, 16)
    assert score(0, 5958, "-", 0, 12793, "-") == (5958, 25)
    assert score(0, 5, "-", 5, 9, "-") == (0, 0)


def side(text):
    chrom, fp, up, down, ml, fq, start, end, strand = text.split()
    return dict(fp_target=int(fp), upstream=int(up), downstream=int(down), match_length=int(ml), fp_query=int(fq), aln_start=int(start), aln_end=int(end), strand=strand)


@pytest.mark.parametrize(("pr", "sa", "expected"), [
    ("chr7 55200409 7 580 397 403 55191795 55200409 +", "chr7 55796094 177 404 403 404 55795692 55796094 -", (55200409, 55796094, 403, 404, True, False)),
    ("chr1 156874907 409 177 398 409 156874907 156876417 +", "chr1 156130774 7 575 402 408 156115031 156130774 +", (156874907, 156130774, 409, 408, False, True)),
    ("chr10 59906121 577 7 303 309 59906121 59906423 -", "chr10 43116583 310 177 400 310 43116583 43119673 +", (59906121, 43116583, 309, 310, True, False)),
    ("chr21 38445409 177 82 403 484 38445409 38584947 -", "chr21 41508083 580 7 75 81 41508083 41508157 -", (38584947, 41508083, 484, 81, False, True)),
])
def test_orientation(spark, pr, sa, expected):
    kind = "struct<" + ",".join(f"{k}:{'string' if k == 'strand' else 'bigint'}" for k in side(pr)) + ">"
    row = evidence.oriented_evidence(spark.createDataFrame([(side(pr), side(sa))], f"pr {kind}, sa {kind}")).first()
    assert tuple(row[c] for c in ("target_break_pr", "target_break_sa", "query_break_pr", "query_break_sa", "up_pr", "up_sa")) == expected


def test_islands(spark):
    import random

    rng = random.Random(0)
    rows = [(rng.choice("ab"), s := rng.randint(0, 3000), s + rng.randint(1, 30)) for _ in range(400)]
    expected = {}
    for key in "ab":
        group = None
        for s, e in sorted((s, e) for k, s, e in rows if k == key):
            if group is None or s - group[1] > 5:
                group = [s, e]
            group[1] = max(group[1], e)
            expected.setdefault((key, s, e), group)
    df = spark.createDataFrame(rows, "k string, s long, e long")
    wide = intervals.islands(df, ["k"], "s", "e", 5, bin_size=64).collect()
    plain = intervals.islands_within(df, ["k"], "s", "e", 5, ("island_start", "island_end")).collect()
    for got in (wide, plain):
        assert len(got) == len(rows)
        assert all([r["island_start"], r["island_end"]] == expected[r["k"], r["s"], r["e"]] for r in got)


def test_cluster_model(spark):
    model = [("S1", "1", 1000, 1300, "+", 10050, 12500, "+"), ("S2", "2", 900, 1200, "+", 10000, 10100, "+"), ("S3", "3", 1000, 1100, "+", 10000, 10400, "+"), ("S4", "5", 1400, 1600, "+", 100, 300, "+"), ("S5", "6", 1500, 1600, "+", 100, 300, "+"), ("S6", "7", 1500, 1700, "+", 100, 300, "+"), ("S7", "8", 5000, 5500, "+", 100, 300, "+"), ("S2", "9", 1000, 1250, "+", 120, 500, "+"), ("S3", "10", 4800, 6000, "-", 10000, 10400, "+")]
    pairs = spark.createDataFrame([(s, f"ID.{n}.1", f"ID.{n}.2", "chr1", a, b, d, "chr7", x, y, e) for s, n, a, b, d, x, y, e in model], "sample string, id string, mid string, chr1 string, st1 long, end1 long, f1 string, chr2 string, st2 long, end2 long, f2 string")
    got = {(r["s1"], r["e1"], r["s2"], r["e2"], r["score"], r["strand1"]) for r in cluster.clustered_calls(pairs, None, 50).collect()}
    assert {(900, 1300, 10000, 12500, 3, "+"), (5000, 5500, 100, 300, 1, "+")} <= got
    assert sum(x[4] for x in got) == 9


def test_region_pairs(spark):
    pairs = spark.createDataFrame([("p1", "chr2", 504886, "+", "chr6", 492562, "+"), ("p2", "chr2", 497711, "-", "chr6", 467452, "-")], "id string, chr1 string, pos1 long, f1 string, chr2 string, pos2 long, f2 string")
    area = "rchr1 string, s1 long, e1 long, strand1 string, rchr2 string, s2 long, e2 long, strand2 string, score int"
    wide = spark.createDataFrame([("chr2", 416889, 504888, ".", "chr6", 467452, 544761, ".", 8)], area)
    ff = spark.createDataFrame([("chr2", 504886, 504888, "+", "chr6", 492562, 492564, "+", 1)], area)
    ids = lambda df: {r["id"] for r in df.collect()}
    assert ids(subset.by_region_pairs(pairs, wide)) == {"p1", "p2"}
    assert ids(subset.by_region_pairs(pairs, ff)) == {"p1"}
    assert ids(subset.by_region_pairs(pairs, ff, inverse=True)) == {"p2"}
    assert ids(subset.by_region_pairs(pairs, wide, min_score=9)) == set()


def test_integration(spark):
    cases = [((1275, 8961, "-", "chr9@132857445-132865123"), (0, 1250), False, 1, (132865123, "+")), ((0, 3205, "-", "chr2@236659019-236662225"), (3205, 8087), True, 1, (236659019, "-")), ((37, 7201, "+", "chr11@8837266-8844392"), (7202, 7904), True, 1, (8844392, "+")), ((3646, 8956, "+", "chr15@44444731-44450034"), (0, 3644), False, 1, (44444731, "-")), ((0, 4057, "+", "chr15@48988687-48992741"), (4054, 12097), True, 1, None), ((0, 4057, "+", "chr15@48988687-48992741"), (4054, 12097), True, 10, (48992741, "+"))]
    for (s, e, strand, target), (a, b), first, overlap, expected in cases:
        host, alien = ("r", s, e, "human", strand, target), ("r", a, b, "muERV", "+", ".")
        rows = [(i, *x) for i, x in enumerate((host, alien) if first else (alien, host))]
        got = integrate.integration_sites(spark.createDataFrame(rows, "rec_idx long, read string, start long, end long, label string, strand string, target string"), "human", "muERV", overlap).collect()
        assert [(r["site"], r["direction"]) for r in got] == ([expected] if expected else [])


def test_precision_at_halves(spark):
    whole = [([6, 8, 22, 44, 49, 57, 77, 80, 92], 32), ([12, 30, 44, 46, 70, 71, 79, 86, 87], 27), ([0, 21, 25, 32, 49, 55, 59, 86, 93], 31), ([1, 2, 4], 2), ([5, 5, 5], 0), ([1, 2], None), ([], None), (None, None)]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(whole)], "i int, x array<long>")
    assert [r["p"] for r in df.select("i", stats.precision(F.col("x")).alias("p")).orderBy("i").collect()] == [p for _, p in whole]
