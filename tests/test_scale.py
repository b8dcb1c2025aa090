"""Operators on dense overlaps, against brute force: few rows whose pairs are many, and no plan that makes the pairs."""

import random

import pytest
from pyspark.sql import functions as F

from svloom.operators import annotate, subset


def made(df, *nodes: str) -> int:
    """The most rows that a join of the executed plan made; df has been run."""
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(plan.executedPlan())
        elif "QueryStage" in name:
            todo.append(plan.plan())
        children = plan.children()
        todo += [children.apply(i) for i in range(children.size())]
        if "Join" in name and plan.metrics().contains("numOutputRows"):
            most = max(most, plan.metrics().apply("numOutputRows").value())
    return most


PAIR = "id long, chr1 string, pos1 long, f1 string, chr2 string, pos2 long, f2 string"
AREA = "rchr1 string, s1 long, e1 long, strand1 string, rchr2 string, s2 long, e2 long, strand2 string, score int"


def in_areas(p, areas):
    fit = lambda d, s: s == "." or s is not None and d == s
    _, c1, x, f1, c2, y, f2 = p
    for a, s, e, u, b, t, g, v, _ in areas:
        if None in (s, e, t, g, x, y) or not ((fit(f1, u) and fit(f2, v)) or (fit(f1, v) and fit(f2, u))):
            continue
        if (c1, c2) == (a, b) and s <= x < e and t <= y < g or (c1, c2) == (b, a) and t <= x < g and s <= y < e:
            return True
    return False


@pytest.mark.parametrize("wide", [3, 300, 40000])
def test_region_pairs_brute(spark, wide):
    rng = random.Random(wide)
    reach = min(1000, wide * 6)
    end = lambda: (rng.choice("12"), rng.randrange(reach), rng.choice(["+", "-", "+", "-", ".", None]))
    pairs = [(i, *end(), *end()) for i in range(600)] + [(600, "1", None, "+", "2", 3, "+"), (601, None, 3, "+", "2", 3, "+")]
    def side():  # noqa: E306
        s = rng.randrange(-5, reach)
        return rng.choice("12"), s, s + rng.randrange(-1, wide), rng.choice(["+", "-", ".", ".", None])
    areas = [(*side(), *side(), rng.randrange(9)) for _ in range(80 if wide == 3 else 8)] + [("1", None, 9, ".", "2", 0, 9, ".", 3)]
    expected = {p[0] for p in pairs if in_areas(p, areas)}
    assert 0 < len(expected) < len(pairs)
    p, a = spark.createDataFrame(pairs, PAIR), spark.createDataFrame(areas, AREA)
    assert {r["id"] for r in subset.by_region_pairs(p, a).collect()} == expected
    assert {r["id"] for r in subset.by_region_pairs(p, a, inverse=True).collect()} == {x[0] for x in pairs} - expected
    assert subset.by_region_pairs(p, a.limit(0)).count() == 0


def test_region_pairs_make_no_pairs(spark):
    pairs = spark.range(3000).select("id", F.lit("1").alias("chr1"), (F.col("id") * 7 % 5000 + 30000).alias("pos1"), F.lit("+").alias("f1"), F.lit("2").alias("chr2"), (F.col("id") * 11 % 5000 + 30000).alias("pos2"), F.lit("-").alias("f2"))
    areas = spark.range(3000).selectExpr("'1' rchr1", "id s1", "id + 60000 e1", "'.' strand1", "'2' rchr2", "id * 3 s2", "id * 3 + 50000 e2", "'-' strand2", "1 score")
    kept = subset.by_region_pairs(pairs, areas)
    assert len(kept.collect()) == 3000
    assert made(kept) <= 6000
    others = subset.by_region_pairs(pairs, areas, inverse=True)
    assert others.collect() == []
    assert made(others) <= 6000
    none = subset.by_region_pairs(pairs, areas.unionByName(areas.withColumn("score", F.lit(0))), inverse=True, min_score=1)
    assert none.collect() == []
    assert made(none) <= 6000


SPAN = "span long, chrom string, s long, e long, strand string"
FEATURE = "chrom string, f_start long, f_end long, f_strand string, name string"


def annotation(seed, n, reach, wide):
    """Spans and features, some of no length or turned, some with nulls, some spans under one number."""
    rng = random.Random(seed)
    def place():  # noqa: E306
        s = rng.randrange(-9, reach)
        return rng.choice("1112"), s, s + rng.choice([0, -2, *[rng.randrange(1, wide) for _ in range(18)]]), rng.choice(["+", "-", "+", "-", None])
    spans = [(rng.randrange(n * 3), *place()) for _ in range(n)] + [(-1, None, 1, 5, "+"), (-2, "1", None, 5, "+"), (-3, "1", 1, None, "+")]
    features = [(*place(), rng.choice("abcdef")) for _ in range(n)] + [(None, 1, 5, "+", "a"), ("1", None, 5, "+", "a"), ("1", 1, None, "+", "b")]
    return spans, features


def scored(spans, features, stranded):
    for i, c, s, e, d in spans:
        for f, t, u, g, name in features:
            if c is not None and c == f and None not in (s, e, t, u) and s < u and t < e:
                yield i, c, name, min(e, u) - max(s, t), 10 * bool(stranded and d and d == g) + (10 if s == t else 1) + (10 if e == u else 5 if e < u else 1)


@pytest.mark.parametrize("stranded", [True, False])
def test_overlap_totals(spark, stranded):
    spans, features = annotation(5, 150, 200000 if stranded else 90, 30000 if stranded else 20)
    expected = {}
    for _, c, name, *more in scored(spans, features, stranded):
        expected[c, name] = [x + y for x, y in zip(expected.get((c, name), [0, 0, 0]), (1, *more), strict=True)]
    got = annotate.overlap_totals(spark.createDataFrame(spans, SPAN), spark.createDataFrame(features, FEATURE), stranded)
    assert {(r["chrom"], r["name"]): [r["n"], r["match_length"], r["score"]] for r in got.collect()} == expected
    dense = spark.range(2000).selectExpr("id span", "'1' chrom", "id s", "id + 5000 e", "'+' strand"), spark.range(2000).selectExpr("'1' chrom", "id f_start", "id + 5000 f_end", "'+' f_strand", "'a' name")
    many = annotate.overlap_totals(*dense, stranded)
    assert [r["n"] for r in many.collect()] == [2000 * 2000]
    assert made(many) <= 20000


@pytest.mark.parametrize(("stranded", "reach", "wide"), [(True, 60, 20), (False, 60, 20), (True, 100000, 9000)])
def test_best_features(spark, stranded, reach, wide):
    spans, features = annotation(reach + stranded, 150, reach, wide)
    best = {}
    for i, _, name, _, score in scored(spans, features, stranded):
        best.setdefault(i, {}).setdefault(score, set()).add(name)
    got = annotate.best_features(spark.createDataFrame(spans, SPAN), spark.createDataFrame(features, FEATURE), stranded).collect()
    assert {r["span"]: r["names"] for r in got} == {i: sorted(x[max(x)]) for i, x in best.items()}
    assert len(got) == len(best) > 40


def test_best_features_make_no_pairs(spark):
    spans = spark.range(2000).selectExpr("id span", "'1' chrom", "id + 3000 s", "id + 3500 e", "'+' strand")
    features = spark.range(2000).selectExpr("'1' chrom", "id f_start", "id + 9000 f_end", "'+' f_strand", "concat('g', id % 5) name")
    kept = annotate.best_features(spans, features, True)
    assert {tuple(r["names"]) for r in kept.collect()} == {("g0", "g1", "g2", "g3", "g4")}
    assert kept.count() == 2000 and made(kept) <= 20000
