"""Registered queries against brute force, on the driver's smallest tables."""

from collections import defaultdict

import numpy as np

from svloom.plans.table_queries import QUERIES

DATA = "/root/testdata/sf0.001"


def supported(orders, reads):
    """(sp_support, coverage_median, sp_ratio) of every order, window by window over all reads."""
    by = defaultdict(list)
    for r in reads:
        start = (r["l_partkey"] * 9973 + r["l_orderkey"] * 31) % 400000
        by[str(r["l_suppkey"] % 3)].append((start, start + int(r["l_quantity"]) * 4, r["l_orderkey"], r["l_linenumber"] % 6 != 0, (r["l_suppkey"] + 1 + r["l_linenumber"] % 2) % 3))
    by = {k: np.array(v, np.int64) for k, v in by.items()}
    support, depth, ratio = {}, {}, {}
    for o in orders:
        key, cust = o["o_orderkey"], o["o_custkey"]
        pos, up = key * 2, key % 2 == 0
        sides = {"pr": (cust % 3, (cust + 1) % 3, (cust * 37 + key % 11) % 200000 * 2, o["o_orderstatus"] != "F", up), "sa": ((cust + 1) % 3, cust % 3, (cust * 53 + key % 7) % 200000 * 2, not o["o_orderpriority"] < "3", not up)}
        names = []
        for side, (chrom, other, at, plus, up_) in sides.items():
            a, b = (max(at - 500, 0), at) if up_ == plus else (at, at + 500)
            x = by[str(chrom)]
            x = x[(x[:, 0] < b) & (x[:, 1] > a)] if a < b else x[:0]
            names.append(set(x[(x[:, 3] == 1) & (x[:, 4] == other), 2].tolist()))
            cover = np.zeros(b - a, np.int64)
            for s, e in x[:, :2]:
                cover[max(s - a, 0) : e - a] += 1
            cover = np.sort(cover[cover > 0])
            if len(cover):
                depth[pos, side] = int(cover[len(cover) // 2])
        n = len(names[0] & names[1])
        if n:
            support[pos] = n
        ratio[pos] = (n, round(min(n / depth[pos, s] if (pos, s) in depth else 0.0 for s in ("pr", "sa")), 6))
    return support, depth, ratio


def test_support_of_every_order(spark):
    orders, reads = (spark.read.parquet(f"{DATA}/{t}.parquet").collect() for t in ("orders", "lineitem"))
    support, depth, ratio = supported(orders, reads)
    run = lambda name: QUERIES[name][0](spark, DATA).collect()
    assert len(ratio) == len(orders)
    assert {r["pos"]: r["support_sp"] for r in run("sp_support")} == support
    assert {(r["pos"], r["side"]): r["depth"] for r in run("coverage_median")} == depth
    got = run("sp_ratio")
    assert len(got) == len(orders)
    assert {r["pos"]: (r["support_sp"], r["sp_ratio"]) for r in got} == ratio


def test_revcomp_of_whole_texts(spark):
    partner = dict(zip("ACGTacgt", "TGCAtgca", strict=True))
    letters = {r["doc_id"]: [c for c in r["text"] or "" if c.isascii() and c.isalpha()] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r["doc_id"]: r["seq"] for r in QUERIES["revcomp"][0](spark, DATA).collect()}
    assert max(map(len, letters.values())) > 60
    assert got == {i: "".join(partner.get(c, c) for c in reversed(x)) for i, x in letters.items()}
