"""MinHash near-dedup with SetSketch registers: exponentially spaced truncated minima, mergeable and locality-sensitive.

1. Every document gets its set of word shingles, the set's digest and a sketch of REGISTERS two-byte registers: register i is the truncated
   logarithm, to base BASE, of the smallest of the set's exponential variates, so the sketch of a union is the maximum of sketches. With a
   base this close to 1, sets without a common shingle hardly ever share a register: bands of unrelated documents stay apart at any size.
2. Equal digests are one class (equal sets), numbered as a node; a class has a text under its smallest doc_id.
3. Bands of ROWS registers: classes with an equal band are compared by their sketches, with the similarity estimated jointly by maximum
   likelihood from how many registers are larger, equal and smaller. A band's members are dealt as pairs of blocks of BAND_BLOCK members over
   an explicit number of partitions. Each task sends a forest of the pairs that may link; connected, they give candidate clusters.
4. Within clusters, pairs that may link by the same estimate are verified on the full sets. A cluster of one block compares it with itself.
   In a larger one all blocks first meet block 0 only. Members that this does not connect to the cluster's largest component then
   meet all others, by sketches; only the sets of those with a possible link outside of their component are read again and verified.
   Pairs within one component need no test, as components are asked for.
5. Links are connected; a component's number is its smallest doc_id.

A pair at the similarity limit shares no band with probability (1 - 0.8^ROWS)^BANDS: 5e-8.

Edge cases: null and empty texts have an empty set and link with nothing; shorter texts than a shingle are one shingle as a whole;
rows with a null doc_id get a null component and are kept; repeated rows are equal documents; a doc_id with several texts is a row for each,
with the component of its own text; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop_staged, encoded, ragged, read_table, release, shuffle_partitions, slices, staged
from .substring_dedup import mixed, rolling, word_hashes

REGISTERS, ROWS, BASE = 128, 4, 1.001
BANDS = REGISTERS // ROWS
#: Members of a block of a band, whose sketches are compared.
BAND_BLOCK = 1024
#: Members and shingles of a block of a cluster, whose sets are compared.
BLOCK_MEMBERS, BLOCK_SHINGLES = 512, 1 << 18
#: Members and shingles of a block in the second comparison, where few sets are read.
REST_MEMBERS, REST_SHINGLES = 4096, 1 << 21
#: Comparisons of sketches, and bytes of sets, that one partition takes.
PARTITION_PAIRS, PARTITION_BYTES = 1 << 23, 16 << 20
#: Up to so many cluster members, their ids (some 16 bytes each) are broadcast to pick their texts; beyond it, a shuffle join does.
BROADCAST_MEMBERS = 1 << 20
#: Parts that a hot cluster's or component's rows are dealt into where they meet a fact about all of it.
SALTS = 64
#: Estimates this far below the limit are let go: over six standard deviations of an estimate from REGISTERS registers.
MARGIN = 0.22
_rng = np.random.default_rng(8)
_MUL = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the distinct shingles of each text in ascending order, one text after the other."""
    rows = [t.lower().split() for t in texts]  # bytes.lower() knows A-Z only
    n = np.fromiter(map(len, rows), np.int64, len(rows))
    h = word_hashes([w for r in rows for w in r])
    ends = np.cumsum(n)
    rolled = rolling(h, size)
    out = []
    for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True):
        if b - a >= size:
            s = np.sort(rolled[a : b - size + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif b > a:
            out.append(mixed(rolling(h[a:b], b - a) + np.uint64(b - a)))  # the whole sequence, apart from longer shingles
        else:
            out.append(h[:0])
    counts = np.fromiter(map(len, out), np.int64, len(out))
    return (np.concatenate(out) if out else h[:0]), counts


def sketches(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Registers of each set; zeros for an empty one. Minima first, then their truncated logarithm."""
    out = np.zeros((len(counts), REGISTERS), np.uint16)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    starts = (np.cumsum(counts) - counts)[some]
    least = np.empty((REGISTERS, len(some)), np.uint64)
    step = 1 << 15  # sets in cache-sized pieces; a large set is a piece of its own
    ends = starts + counts[some]
    a = 0
    while a < len(some):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + step, side="right")))
        piece, at = hashes[starts[a] : ends[b - 1]], starts[a:b] - starts[a]
        buffer = np.empty_like(piece)
        for i in range(REGISTERS):
            np.multiply(piece, _MUL[i], out=buffer)
            np.add(buffer, _ADD[i], out=buffer)
            np.minimum.reduceat(buffer, at, out=least[i, a:b])
        a = b
    # the smallest of n uniform variates, as the smallest of n exponential ones
    u = np.minimum((least.astype(np.float64) + 0.5) / 2.0**64, 1 - 2.0**-53)
    out[some] = np.clip(np.floor(4000 - np.log(-np.log1p(-u)) / np.log(BASE)), 0, 65535).T
    return out


def likely(larger: np.ndarray, smaller: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, at: float) -> np.ndarray:
    """Whether the Jaccard similarity of largest likelihood is ``at`` at least, from the counts of registers where a's is larger and where
    b's is. The log likelihood is concave, so its slope there decides."""
    share = n_a / (n_a + n_b)
    p = lambda x: -np.log1p(-np.maximum(x, 1e-12) * (BASE - 1) / BASE) / np.log(BASE)

    def value(j: float) -> np.ndarray:
        up, down = p(share - (1 - share) * j), p((1 - share) - share * j)
        return larger * np.log(up) + smaller * np.log(down) + (REGISTERS - larger - smaller) * np.log(np.maximum(1 - up - down, 1e-12))

    return value(at + 1e-4) >= value(at - 1e-4)


def near(sketch: np.ndarray, n: int, sketches: np.ndarray, counts: np.ndarray, limit: int) -> np.ndarray:
    """Which of the sets with these sketches and sizes may link with one set: the sizes allow it, and so does the estimate."""
    out = np.flatnonzero(100 * np.minimum(n, counts) >= limit * np.maximum(n, counts))
    if len(out):
        # about as many registers are equal as the similarity says; far fewer need no estimate
        out = out[(sketches[out] == sketch).sum(1) >= REGISTERS * (limit / 100 - MARGIN - 0.1)]
    if len(out):
        larger, smaller = (sketch > sketches[out]).sum(1), (sketch < sketches[out]).sum(1)
        out = out[likely(larger, smaller, np.float64(n), counts[out].astype(np.float64), limit / 100 - MARGIN)]
    return out


class Side:
    """Sets to compare: node numbers, labels (sets with an equal one need no test), sizes, sketches, and the sets one after the other."""

    def __init__(self, t: pa.Table, at: np.ndarray):
        t = t.take(pa.array(at))
        self.ids = t.column("node").to_numpy()
        self.label = t.column("label").to_numpy().copy()
        self.n = t.column("n").to_numpy()
        self.sketch = registers(t.column("sketch"))
        if "shingles" in t.column_names:
            self.flat = np.frombuffer(b"".join(t.column("shingles").to_pylist()), np.uint64)
            self.start = np.cumsum(self.n) - self.n

    def shared(self, mine: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of a set with some of these."""
        other = self.flat[ragged(self.start[which], self.n[which])]
        hit = mine[np.minimum(np.searchsorted(mine, other), len(mine) - 1)] == other
        return np.add.reduceat(hit, np.cumsum(self.n[which]) - self.n[which])


def registers(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def forest(a: Side, b: Side | None, limit: int, verify: bool) -> pa.Table:
    """Edges that connect all pairs of a and b (of a, without b) that may link or, with ``verify``, do: intersections of ``limit`` percent
    of the union at least."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    sides = (a,) if b is None else (a, b)
    other = sides[-1]
    for r in range(len(a.ids)):
        rest = np.flatnonzero(other.label != a.label[r])
        if b is None:
            rest = rest[np.searchsorted(rest, r) :]
        if not len(rest):
            continue
        rest = rest[near(a.sketch[r], int(a.n[r]), other.sketch[rest], other.n[rest], limit)]
        if verify and len(rest):
            both = other.shared(a.flat[a.start[r] : a.start[r] + a.n[r]], rest)
            rest = rest[100 * both >= limit * (a.n[r] + other.n[rest] - both)]
        if len(rest):
            labels, first = np.unique(other.label[rest], return_index=True)
            out.append((np.full(len(first), a.ids[r]), other.ids[rest[first]]))
            for side in sides:
                side.label[np.isin(side.label, labels)] = a.label[r]
    ends = [np.concatenate(x) if out else np.zeros(0, np.int64) for x in zip(*out, strict=True)] or [np.zeros(0, np.int64)] * 2
    return pa.table([pa.array(x, pa.int64()) for x in ends], ["a", "b"])


def compared(rows: DataFrame, keys: list[str], limit: int, verify: bool, partitions: int) -> DataFrame:
    """Edges within each group of rows(keys, side, node, label, n, sketch, shingles if verified): between sides 0 and 1, or within side 2,
    which also stands for side 0."""

    def compare(key: tuple, t: pa.Table) -> pa.Table:
        side, nodes = t.column("side").to_numpy(), t.column("node").to_numpy()
        _, first = np.unique(np.stack([nodes, side]), axis=1, return_index=True)
        left, right = (np.sort(first[side[first] == k]) for k in (0, 1))
        both = np.sort(first[side[first] == 2])
        if len(both):
            return forest(Side(t, both), None, limit, verify)
        return forest(Side(t, left), Side(t, right), limit, verify)

    return rows.repartition(partitions, *keys).groupBy(*keys).applyInArrow(compare, "a long, b long")


def described(documents: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, sketch."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, counts = shingle_sets(encoded(part.column("text")), size)
                ends = np.cumsum(counts)
                digests = [xxhash.xxh3_128_digest(hashes[a:b].tobytes()) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                rows = sketches(hashes, counts)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts), pa.array(digests, pa.binary()), pa.array([x.tobytes() for x in rows], pa.binary())], ["doc_id", "n_shingles", "digest", "sketch"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(describe, "doc_id long, n_shingles long, digest binary, sketch binary")


def candidates(classes: DataFrame, limit: int) -> DataFrame:
    """(a, b): edges that connect all classes(node, n, sketch) that may link, through bands that they share. Bands with the same members
    count once. A band of two is a pair; a larger one meets itself in pairs of blocks."""
    width = 2 * ROWS
    bands = F.array(*[F.xxhash64(F.lit(i), F.substring("sketch", width * i + 1, width)) for i in range(BANDS)])
    rows = classes.select("node", F.explode(bands).alias("band"))
    buckets = rows.groupBy("band").agg(F.min("node").alias("b"), F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("members")).where("size > 1")
    buckets = buckets.groupBy("members", "size", "b").agg(F.min("band").alias("band")).select("band", "b", "size")
    kept = staged(rows.join(buckets, "band"), "buckets")
    facts = classes.select("node", "sketch", "n")

    def pair_filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s, o = registers(batch.column("sketch_a")), registers(batch.column("sketch_b"))
                n, m = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
                good = (100 * np.minimum(n, m) >= limit * np.maximum(n, m)) & likely((s > o).sum(1), (s < o).sum(1), n.astype(np.float64), m.astype(np.float64), limit / 100 - MARGIN)
                yield batch.select(["a", "b"]).filter(pa.array(good))

    pairs = kept.where("size = 2 AND node <> b").select(F.col("node").alias("a"), "b").distinct()
    for side in "ab":
        pairs = pairs.join(facts.select(F.col("node").alias(side), F.col("sketch").alias(f"sketch_{side}"), F.col("n").alias(f"n_{side}")), side)
    pairs = pairs.mapInArrow(pair_filter, "a long, b long")

    more = kept.where("size > 2").withColumn("blocks", F.ceil(F.col("size") / BAND_BLOCK).cast("int"))
    work = more.agg(F.sum(F.col("size").cast("double"))).first()[0] or 0  # every member meets all others
    partitions = max(shuffle_partitions(kept.sparkSession), -int(-work // PARTITION_PAIRS))
    block = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    dealt = more.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("band", "node", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"))
    dealt = dealt.join(facts, "node").withColumn("label", F.col("node"))
    out = staged(pairs.unionByName(compared(dealt, ["band", "x", "y"], limit, False, partitions)), "candidates")
    drop_staged(kept)
    return out


def with_sets(documents: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """members(node, rep, digest, n, sketch, cluster, block, blocks) with their sets, from the documents' texts."""
    texts = documents.select(F.col("doc_id").cast("long").alias("rep"), "text")
    if members.count() <= BROADCAST_MEMBERS:
        texts = texts.join(F.broadcast(members.select("rep").distinct()), "rep", "left_semi")
    texts = texts.join(members, "rep")
    names = ["node", "n", "sketch", "cluster", "block", "blocks"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, counts = shingle_sets(encoded(part.column("text")), size)
                ends = np.cumsum(counts)
                sets = [hashes[a:b].tobytes() for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                same = [xxhash.xxh3_128_digest(s) == d for s, d in zip(sets, part.column("digest").to_pylist(), strict=True)]
                out = pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(sets, pa.binary())], [*names, "shingles"])
                yield out.filter(pa.array(same))  # a repeated doc_id may have other texts

    return texts.mapInArrow(read, "node long, n long, sketch binary, cluster long, block int, blocks int, shingles binary")


def with_fact(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """rows with the columns of facts(key, ...), null where there is none; a hot key's rows are dealt into SALTS parts."""
    salted = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salted, [key, "salt"], "left").drop("salt")


def blocks_of(rows: DataFrame, key: str, members: int, shingles: int) -> DataFrame:
    """(key, blocks) of each key whose rows(key, n) need more than one block."""
    blocks = F.greatest(F.ceil(F.count("*") / members), F.ceil(F.sum("n") / shingles)).cast("int")
    return rows.groupBy(key).agg(blocks.alias("blocks"))


def again(large: DataFrame, linked: DataFrame, sets: DataFrame, limit: int) -> DataFrame | None:
    """Links that block 0 does not show: of members(cluster, node, n, sketch) of large clusters that are not in their cluster's largest
    component, with all others."""
    labels = large.join(linked.withColumnRenamed("component", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    labels = staged(labels, "labels")
    main = labels.groupBy("cluster", "label").agg(F.count("*").alias("k")).groupBy("cluster").agg(F.max_by("label", F.struct("k", "label")).alias("main"))
    rest = staged(with_fact(labels, main, "cluster").where("label <> main").drop("main"), "rest")
    if not rest.limit(1).count():
        drop_staged(labels, rest)
        return None
    n_parts = blocks_of(rest, "cluster", REST_MEMBERS, REST_SHINGLES).withColumnRenamed("blocks", "parts")
    n_blocks = blocks_of(labels.join(n_parts.select("cluster"), "cluster", "left_semi"), "cluster", REST_MEMBERS, REST_SHINGLES)
    shape = staged(n_parts.join(n_blocks, "cluster"), "shape")
    work = shape.agg(F.sum(F.col("parts").cast("double") * F.col("blocks"))).first()[0]
    partitions = max(shuffle_partitions(large.sparkSession), int(work))
    part, block = (F.pmod(F.xxhash64(F.lit(k), "node"), c).cast("int") for k, c in ((1, "parts"), (2, "blocks")))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    columns = ["cluster", "x", "y", "side", "node", "label", "n", "sketch"]
    left = with_fact(rest, shape, "cluster").withColumn("x", part).withColumn("y", every("blocks")).withColumn("side", F.lit(0)).select(columns)
    right = with_fact(labels, shape, "cluster").where("parts IS NOT NULL").withColumn("y", block).withColumn("x", every("parts")).withColumn("side", F.lit(1)).select(columns)

    def pick(key: tuple, t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        at = [np.flatnonzero(side == k) for k in (0, 1)]
        a, b = (Side(t, x) for x in at)
        wanted = np.zeros(len(side), bool)
        for r in range(len(a.ids)):
            other = np.flatnonzero(b.label != a.label[r])
            if len(other):
                other = other[near(a.sketch[r], int(a.n[r]), b.sketch[other], b.n[other], limit)]
                wanted[at[0][r]] = len(other) > 0
                wanted[at[1][other]] = True
        return t.filter(pa.array(wanted)).select(columns)

    schema = "cluster long, x int, y int, side int, node long, label long, n long, sketch binary"
    wanted = left.unionByName(right).repartition(partitions, "cluster", "x", "y").groupBy("cluster", "x", "y").applyInArrow(pick, schema)
    wanted = staged(wanted, "wanted")
    rows = wanted.join(sets.select("node", "shingles"), "node")
    out = staged(compared(rows, ["cluster", "x", "y"], limit, True, partitions), "links")
    drop_staged(labels, rest, shape, wanted)
    return out


def classes_of(documents: DataFrame, size: int = 4, limit: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of documents(doc_id, text)."""
    spark = documents.sparkSession
    facts = staged(described(documents, size), "sketches")
    classes = facts.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n"))
    classes = staged(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    close = candidates(classes, limit)
    release(spark)
    clusters = components(close, "clusters")
    release(spark)
    members = classes.join(clusters.withColumnRenamed("component", "cluster"), "node")
    blocks = blocks_of(members, "cluster", BLOCK_MEMBERS, BLOCK_SHINGLES).where("blocks > 1")
    members = with_fact(members, blocks, "cluster").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    members = staged(members.select("node", "rep", "digest", "n", "sketch", "cluster", "block", "blocks"), "members")
    sets = staged(with_sets(documents, members, size), "sets")
    volume = members.agg(F.sum("n")).first()[0] or 0
    partitions = max(shuffle_partitions(spark), -(-8 * volume // PARTITION_BYTES))
    release(spark)

    # first all blocks with block 0
    zero = F.lit(0)
    rows = sets.withColumn("label", F.col("node"))
    columns = ["cluster", "y", "side", "node", "label", "n", "sketch", "shingles"]
    left = rows.where("block = 0 AND blocks > 1").withColumn("y", F.explode(F.sequence(F.lit(1), F.col("blocks") - 1))).withColumn("side", zero)
    right = rows.withColumn("y", F.col("block")).withColumn("side", F.when(F.col("block") == 0, 2).otherwise(1))
    found = staged(compared(left.select(columns).unionByName(right.select(columns)), ["cluster", "y"], limit, True, partitions), "links")
    linked = components(found, "linked")
    release(spark)

    # then what is left of large clusters, with all of them
    large = members.where("blocks > 1").select("cluster", "node", "n", "sketch")
    if large.limit(1).count():
        more = again(large, linked, sets, limit)
        if more is not None:
            drop_staged(linked)
            linked = components(found.unionByName(more), "linked")
            drop_staged(more)
    drop_staged(sets, members, close, clusters, found)
    release(spark)

    # a component's number: the smallest doc_id of its classes
    reps = linked.join(classes.select("node", "rep"), "node")
    lowest = reps.groupBy("component").agg(F.min("rep").alias("component_id"))
    ids = with_fact(linked, lowest, "component").select("node", "component_id")
    known = classes.select("digest", "node", "rep").join(ids, "node", "left").select("digest", F.coalesce("component_id", "rep").alias("component_id"))
    some = facts.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "n_shingles", "digest")
    alone = facts.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return some.join(known, "digest").select("doc_id", "n_shingles", "component_id").unionByName(alone)


def op8_setsketch_dedup(spark, sf_dir: str) -> DataFrame:
    out = classes_of(read_table(spark, sf_dir, "documents"), 4, 80)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
