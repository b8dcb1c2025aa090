"""Subsets of call sets: by region pairs, by chromosome, by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import islands_within
from .staging import staged

SCRUBBED = ("full_length_coverage", "length", "NpolyAremoved", "FL")


def scrub_info(info: Column, names=SCRUBBED) -> Column:
    """The INFO map without the named keys."""
    return F.map_filter(info, lambda k, v: ~k.isin(*names))


def cell(position: Column, width: Column) -> Column:
    return F.floor(position / width)


def by_region_pairs(pairs: DataFrame, regions: DataFrame, inverse: bool = False, min_score: int | None = None, cells: int = 32) -> DataFrame:
    """Pairs (id, chr1, pos1, f1, chr2, pos2, f2) whose ends lie in a region pair (rchr1, s1, e1, strand1, rchr2, s2, e2, strand2, score).

    Either end may be in either region; directions match in either order; a region strand ``.`` fits all. Inverse: the others.

    A region pair is a rectangle, cut by a grid of at most ``cells`` + 1 cells a side; the grids' widths are powers of four. A point in a cell that
    some rectangle fills needs no comparison, however many rectangles lie there; elsewhere it meets the rectangles' parts in its cell, merged."""
    if min_score is not None:
        regions = regions.where(F.col("score") >= min_score)
    turn = {"rchr1": "rchr2", "s1": "s2", "e1": "e2", "strand1": "strand2"}
    turn |= {v: k for k, v in turn.items()}
    both = regions.select(*turn).unionByName(regions.select(*[F.col(v).alias(k) for k, v in turn.items()])).where("s1 < e1 AND s2 < e2").distinct()
    fits = lambda d, s: (F.col(s) == ".") | (F.col(d) == F.col(s))
    directions = (fits("f1", "strand1") & fits("f2", "strand2")) | (fits("f1", "strand2") & fits("f2", "strand1"))
    fitting = both.select("strand1", "strand2").distinct().join(pairs.select("f1", "f2").distinct(), directions)
    areas = both.join(fitting, ["strand1", "strand2"]).drop("strand1", "strand2").distinct()
    width = lambda s, e: F.pow(F.lit(4.0), F.greatest(F.lit(0), F.ceil(F.log(4.0, (F.col(e) - F.col(s)) / cells)))).cast("long")
    areas = staged(areas.withColumns({"w1": width("s1", "e1"), "w2": width("s2", "e2")}))
    cut = areas
    for i in "12":
        w, s, e = (F.col(f"{x}{i}") for x in "wse")
        cut = cut.withColumn(f"c{i}", F.explode(F.sequence(cell(s, w), cell(e - 1, w))))
        cut = cut.withColumns({f"s{i}": F.greatest(s, F.col(f"c{i}") * w), f"e{i}": F.least(e, (F.col(f"c{i}") + 1) * w)})
    key = ["rchr1", "rchr2", "f1", "f2", "w1", "w2", "c1", "c2"]
    whole = (F.col("e1") - F.col("s1") == F.col("w1")) & (F.col("e2") - F.col("s2") == F.col("w2"))
    full = staged(cut.where(whole).select(*key).distinct())
    same = lambda x, y: (F.col(f"{x}.f1").eqNullSafe(F.col(f"{y}.f1"))) & (F.col(f"{x}.f2").eqNullSafe(F.col(f"{y}.f2")))
    there = [k for k in key if k not in ("f1", "f2")]
    on = lambda x, y: [F.col(f"{x}.{k}") == F.col(f"{y}.{k}") for k in there] + [same(x, y)]
    parts = cut.where(~whole).distinct().alias("x").join(full.alias("y"), on("x", "y"), "left_anti")
    for x, y in ("12", "21"):
        to = (f"m{x}", f"n{x}")
        parts = islands_within(parts, [*key, f"s{y}", f"e{y}"], f"s{x}", f"e{x}", 0, to).select(*key, f"s{y}", f"e{y}", *[F.col(c).alias(d) for c, d in zip(to, (f"s{x}", f"e{x}"), strict=True)]).distinct()
    spots = pairs.select("id", F.col("chr1").alias("rchr1"), F.col("chr2").alias("rchr2"), "f1", "f2", "pos1", "pos2").crossJoin(F.broadcast(areas.select("w1", "w2").distinct()))
    spots = spots.withColumns({"c1": cell(F.col("pos1"), F.col("w1")), "c2": cell(F.col("pos2"), F.col("w2"))})
    match = " AND ".join([f"p.{k} = r.{k}" for k in there] + ["p.f1 <=> r.f1", "p.f2 <=> r.f2"])
    inside = "p.pos1 >= r.s1 AND p.pos1 < r.e1 AND p.pos2 >= r.s2 AND p.pos2 < r.e2"
    text = f"SELECT DISTINCT p.id FROM {{spots}} p WHERE EXISTS (SELECT 1 FROM {{full}} r WHERE {match}) OR EXISTS (SELECT 1 FROM {{parts}} r WHERE {match} AND {inside})"
    hits = pairs.sparkSession.sql(text, spots=spots, full=full, parts=staged(parts))
    return pairs.join(hits, "id", "left_anti" if inverse else "left_semi")


def by_chromosome(records: DataFrame, chroms: DataFrame, remove: bool = False) -> DataFrame:
    """Records (id, chrom, mate_id) on the listed chromosomes (chrom), or, with remove, those that are not, without mates of removed ones.

    Keeping treats records of other chromosomes the same way: they and their mates go."""
    unwanted = records.join(chroms.select("chrom").distinct(), "chrom", "left_semi" if remove else "left_anti")
    gone = unwanted.select("id").unionByName(unwanted.where("mate_id IS NOT NULL").select(F.col("mate_id").alias("id"))).distinct()
    return records.join(gone, "id", "left_anti")


def without_ids(rows: DataFrame, column: str, blacklist: DataFrame) -> DataFrame:
    """Rows whose column is not among the blacklist's ids."""
    return rows.join(blacklist.select(F.col("id").alias(column)).distinct(), column, "left_anti")
