"""Support of fusion positions: collapse of read evidence, split pairs, coverage ratio."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.stats import upper_median_of
from .evidence import MATE_UNMAPPED, has
from .intervals import bins_of, interval_join, islands, islands_within
from .staging import staged

STATE = ["strand_pr", "strand_sa", "up_pr", "up_sa"]
POSITION = "chrom_pr string, chrom_sa string, target_break_pr long, target_break_sa long, strand_pr string, strand_sa string, up_pr boolean, up_sa boolean, breaks_pr array<long>, breaks_sa array<long>, starts_pr array<long>, starts_sa array<long>, support_sr long, cipos long"


class Positions:
    """The positions that one group has so far, by the stretch of ``reach`` bases that their primary median is in."""

    def __init__(self, reach: int, stranded: bool):
        self.reach, self.stranded = reach, stranded
        self.found: list[dict] = []
        self.at: dict[int, set[int]] = {}

    def add(self, r: dict) -> None:
        """A row joins every position whose two running upper medians are nearer than reach, else it makes a new one. Strands and sides must
        be equal; if not stranded, all opposite will do too."""
        state = tuple(r[c] for c in STATE)
        pr, sa = r["target_break_pr"], r["target_break_sa"]
        bin_ = pr // self.reach
        joined = False
        for i in sorted(i for k in (bin_ - 1, bin_, bin_ + 1) for i in self.at.get(k, ())):
            x = self.found[i]
            same = sum(a == b for a, b in zip(x["state"], state, strict=True))
            if (same == 4 or not self.stranded and same == 0) and abs(pr - x["pr"]) < self.reach and abs(sa - x["sa"]) < self.reach:
                bisect.insort(x["breaks_pr"], pr)
                bisect.insort(x["breaks_sa"], sa)
                x["starts_pr"].append(r["aln_start_pr"])
                x["starts_sa"].append(r["aln_start_sa"])
                before = x["pr"] // self.reach
                x["pr"], x["sa"] = (x[f"breaks_{s}"][len(x["breaks_pr"]) // 2] for s in ("pr", "sa"))
                if x["pr"] // self.reach != before:
                    self.at[before].discard(i)
                    self.at.setdefault(x["pr"] // self.reach, set()).add(i)
                joined = True
        if not joined:
            self.at.setdefault(bin_, set()).add(len(self.found))
            self.found.append({"state": state, "pr": pr, "sa": sa, "breaks_pr": [pr], "breaks_sa": [sa], "starts_pr": [r["aln_start_pr"]], "starts_sa": [r["aln_start_sa"]], "cipos": r["precision"]})

    def rows(self, chroms: tuple) -> list[dict]:
        return [dict(zip(["chrom_pr", "chrom_sa", "target_break_pr", "target_break_sa", *STATE], (*chroms, x["pr"], x["sa"], *x["state"]), strict=True)) | {k: x[k] for k in ("breaks_pr", "breaks_sa", "starts_pr", "starts_sa", "cipos")} | {"support_sr": len(x["breaks_pr"])} for x in self.found]


def collapsed(evidence: DataFrame, reach: int = 5, stranded: bool = False) -> DataFrame:
    """Read evidence as positions: a greedy collapse in the order of rec_idx. Rows that a gap of ``reach`` separates never meet, so each
    chromosome pair is cut at the gaps of both breaks first: groups are as small as the data's own clusters. Sorted partitions stream
    through Arrow, one group in memory at a time."""
    keys = ["chrom_pr", "chrom_sa"]
    cut = evidence.withColumns({"__p": F.col("target_break_pr") + 1, "__s": F.col("target_break_sa") + 1})
    cut = islands(cut, keys, "target_break_pr", "__p", reach, ("__i", "__ie"))
    cut = islands_within(cut, [*keys, "__i"], "target_break_sa", "__s", reach, ("__j", "__je"))
    group = [*keys, "__i", "__j"]
    order = ["rec_idx", "sa_idx", "target_break_pr", "target_break_sa"]
    rows = cut.select(*group, *order, *STATE, "aln_start_pr", "aln_start_sa", "precision").repartition(*group).sortWithinPartitions(*group, *order)
    schema = to_arrow_schema(rows.sparkSession.createDataFrame([], POSITION).schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                key = tuple(r[c] for c in group)
                if key != now:
                    if state:
                        done += state.rows(now[:2])
                    now, state = key, Positions(reach, stranded)
                state.add(r)
            yield pa.RecordBatch.from_pylist(done, schema)
        if state:
            yield pa.RecordBatch.from_pylist(state.rows(now[:2]), schema)

    return rows.mapInArrow(walk, POSITION)


def both_windows(positions: DataFrame, reach: int = 500) -> DataFrame:
    """The stretch beside each break where supporting reads align, both of a position in one row: pos, and chrom, start and end of either
    side. An empty stretch has no reads."""
    out = [F.col("pos")]
    for side in ("pr", "sa"):
        at = F.col(f"target_break_{side}")
        before = F.col(f"up_{side}") == (F.col(f"strand_{side}") == "+")
        start, end = F.when(before, F.greatest(at - reach, F.lit(0))).otherwise(at), F.when(before, at).otherwise(at + reach)
        out += [F.col(f"chrom_{side}"), start.alias(f"{side}_start"), end.alias(f"{side}_end")]
    return positions.select(*out)


def windows(positions: DataFrame, reach: int = 500) -> DataFrame:
    """The same with a row for each stretch that is not empty: pos, side, chrom, other, w_start, w_end."""
    both = both_windows(positions, reach)
    one = [both.select("pos", F.lit(side).alias("side"), F.col(f"chrom_{side}").alias("chrom"), F.col(f"chrom_{other}").alias("other"), F.col(f"{side}_start").alias("w_start"), F.col(f"{side}_end").alias("w_end")) for side, other in (("pr", "sa"), ("sa", "pr"))]
    return one[0].unionByName(one[1]).where("w_start < w_end")


def overlapping(wins: DataFrame, leads: DataFrame, bin_size: int = 1024) -> DataFrame:
    """Windows with the reads that overlap them and have the mate on the chromosome of the position's other side."""
    return interval_join(wins, leads.withColumnRenamed("mate_rname", "other"), ["chrom", "other"], ("w_start", "w_end"), ("aln_start", "aln_end"), bin_size)


def split_pair_support(positions: DataFrame, alignments: DataFrame, reach: int = 500, bin_size: int = 1024, many: int = 32) -> DataFrame:
    """pos, support_sp: names that are in both windows with the mate on the other's chromosome. Alignments need chrom, aln_start, aln_end,
    qname, flag and mate_rname; reads without a name or a mate support nothing.

    Windows are far more often covered than supported, so reads meet their namesakes first, and those pairs the positions, by the bins of
    both ends at once. Names of over ``many`` reads are too many pairs of their own: these meet the windows read by read, with the same
    result."""
    leads = alignments.where(~has(F.col("flag"), MATE_UNMAPPED) & F.col("mate_rname").isNotNull()).select("chrom", "aln_start", "aln_end", "qname", "mate_rname").dropna(subset=["qname"])
    common = leads.groupBy("qname").agg(F.count("*").alias("n")).where(F.col("n") > many).select("qname")

    ends = leads.join(common, "qname", "left_anti")
    read = lambda side: [F.col(c).alias(f"{side}_{c}") for c in ("aln_start", "aln_end")]
    first = ends.select("qname", F.col("chrom").alias("chrom_pr"), F.col("mate_rname").alias("chrom_sa"), *read("pr"))
    second = ends.select("qname", F.col("chrom").alias("chrom_sa"), F.col("mate_rname").alias("chrom_pr"), *read("sa"))
    pairs = first.join(second, ["qname", "chrom_pr", "chrom_sa"])
    spots = both_windows(positions, reach).where("pr_start < pr_end AND sa_start < sa_end")
    for side in ("pr", "sa"):
        spots = spots.withColumn(f"__{side}", F.explode(bins_of(F.col(f"{side}_start"), F.col(f"{side}_end"), bin_size)))
        pairs = pairs.withColumn(f"__{side}", F.explode(bins_of(F.col(f"{side}_aln_start"), F.col(f"{side}_aln_end"), bin_size)))
    met = spots.join(pairs, ["chrom_pr", "chrom_sa", "__pr", "__sa"])
    for side in ("pr", "sa"):
        met = met.where(f"{side}_start < {side}_aln_end AND {side}_aln_start < {side}_end")

    rest = overlapping(windows(positions, reach), leads.join(common, "qname", "left_semi"), bin_size)
    rest = rest.groupBy("pos", "qname").agg(F.bit_or(F.when(F.col("side") == "pr", 1).otherwise(2)).alias("sides")).where("sides = 3")
    return met.select("pos", "qname").distinct().unionByName(rest.select("pos", "qname")).groupBy("pos").agg(F.count("*").alias("support_sp"))


def median_depth(wins: DataFrame, alignments: DataFrame, reach: int = 500, bin_size: int = 1024) -> DataFrame:
    """pos, side, depth: upper median of the coverage over the window's covered positions.

    A base is as deep in one window as in another, so coverage is swept once, in bins that reach far enough beyond their end to hold every
    window (``reach`` bases at most) that starts in them; windows then cut their part out of their bin's depths."""
    key = ["chrom", "__bin"]
    start = F.col("__bin") * bin_size
    dealt = alignments.withColumn("__bin", F.explode(F.sequence(F.greatest(F.floor((F.col("aln_start") - reach) / bin_size), F.lit(0)), F.floor((F.col("aln_end") - 1) / bin_size))))
    step = lambda at, d: F.struct(at.alias("at"), F.lit(d).alias("d"))
    end = start + bin_size + reach
    edges = dealt.select(*key, F.explode(F.array(step(start, 0), step(F.greatest(F.col("aln_start"), start), 1), step(F.least(F.col("aln_end"), end), -1), step(end, 0))).alias("e"))
    steps = edges.groupBy(*key, "e.at").agg(F.sum("e.d").alias("d"))
    # depths are never null, and typed so: sorts and searches of such arrays are those of plain ints
    order = Window.partitionBy(*key).orderBy("at")
    runs = steps.select(*key, "at", F.coalesce(F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"), F.lit(0)).alias("depth"), F.lead("at").over(order).alias("to")).where("to IS NOT NULL")
    sweeps = runs.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("at", "to", "depth"))).alias("runs"))
    depths = sweeps.select(*key, F.flatten(F.transform("runs", lambda x: F.array_repeat(x["depth"], (x["to"] - x["at"]).cast("int")))).alias("depths"))
    spots = wins.withColumn("__bin", F.floor(F.col("w_start") / bin_size)).join(depths, key)
    cut = F.slice("depths", (F.col("w_start") - start + 1).cast("int"), (F.col("w_end") - F.col("w_start")).cast("int"))
    # a generator's output is computed once, however often it is read
    covered = spots.select("pos", "side", F.explode(F.array(F.array_remove(cut, F.lit(0)))).alias("covered")).where(F.size("covered") > 0)
    return covered.select("pos", "side", upper_median_of(F.col("covered")).cast("long").alias("depth"))


def with_support(positions: DataFrame, alignments: DataFrame, reach: int = 500) -> DataFrame:
    """positions with support_sp and sp_ratio, the smaller of both sides' support by median depth; 0 without reads."""
    # a position's number is part of the staged table, so it is the same wherever it is read
    numbered = staged(positions if "pos" in positions.columns else positions.withColumn("pos", F.monotonically_increasing_id()))
    wins = windows(numbered, reach)
    depth = median_depth(wins, alignments, reach).groupBy("pos").pivot("side", ["pr", "sa"]).agg(F.first("depth"))
    out = numbered.join(split_pair_support(numbered, alignments, reach), "pos", "left").join(depth, "pos", "left")
    sp = F.coalesce(F.col("support_sp"), F.lit(0).cast("long"))
    ratio = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) > 0, sp / F.col(c)).otherwise(0.0)
    return out.withColumns({"sp_ratio": F.least(ratio("pr"), ratio("sa")), "support_sp": sp}).drop("pr", "sa")
