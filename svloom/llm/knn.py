"""Exact top-k search by a Voronoi kNN join.

1. PIVOTS vectors divide the data into cells by the nearest pivot. Equal vectors are one entry that keeps its k + 1 smallest ids:
   no result can need more of them.
2. Each cell is summarised by its size, radius, and the k + 1 smallest distances to its pivot.
3. For query q, pivot p and v in p's cell, the inner product q.v lies between q.p - |q| |v - p| and q.p + |q| |v - p|. The summaries'
   smallest distances give a lower bound of the k-th best score; cells whose upper bound is below it are skipped.
4. Queries go to the cells that they need, packed; cells are split into blocks of bounded size, whatever their number of vectors.
   Each block is solved locally and the blocks' best k are merged.

There is a quarter of the square root of the number of vectors in pivots, so pruning keeps pace with the data; pivots and summaries, k + 1
numbers and a vector each, are on the driver (a thousand million vectors: 8,000 pivots).

Edge cases: vectors that are null, empty or hold null or non-finite components take no part, as queries or as candidates; ids that are
null take no part; vectors of another length than most (the smallest of the most frequent) take no part either; ties go to the smaller id;
a query with fewer than k candidates gets all; repeated ids are rows of their own, of which a query excludes those with its own id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read_table, staged

BLOCK = 8192
#: Numbers that a task holds at once while it routes queries or finds the nearest pivots.
CELLS = 1 << 22
SCALE = 64


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the components times ``scale`` rounded down, of the vectors that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    fine &= ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def matrix(column, size: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, distance) of each row; of equally near pivots the first."""
    cell = np.empty(len(x), np.int64)
    square, step = (pivots * pivots).sum(1)[None, :], max(1, CELLS // len(pivots))
    for a in range(0, len(x), step):
        cell[a : a + step] = (square - 2 * x[a : a + step] @ pivots.T).argmin(1)
    return cell, np.sqrt(((x - pivots[cell]) ** 2).sum(1))


def top(scores: np.ndarray, owners: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k largest scores of each row, ties to the smaller owner; owners ascending."""
    if scores.shape[1] <= k:
        return np.argsort(-scores, axis=1, kind="stable")
    floor = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
    out = np.empty((len(scores), k), np.int64)
    for r, s in enumerate(scores):
        at = np.flatnonzero(s >= floor[r])
        out[r] = at[np.argsort(-s[at], kind="stable")[:k]]
    return out


def joined(vectors: DataFrame, is_query, k: int = 20, pivots: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``is_query`` picks, the k best inner products with other rows."""
    spark = vectors.sparkSession
    rows = quantized(vectors)
    shape = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    if shape is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    size, total = shape["size"], shape["n"]
    rows = staged(rows.where(F.size("v") == size), "vectors")
    n_pivots = pivots or max(1, int(total**0.5 / 4))
    chosen = rows.select("v", F.xxhash64("v").alias("h")).distinct().orderBy("h", "v").limit(n_pivots).collect()
    P = np.array([r["v"] for r in chosen], dtype=np.float64)

    # equal vectors: their k + 1 smallest ids
    same = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).drop("n")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, distance = nearest(matrix(batch.column("v"), size), P)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cell.astype(np.int32)), pa.array(distance)], ["vec_id", "v", "cell", "distance"])

    data = staged(few.mapInArrow(assign, "vec_id long, v array<long>, cell int, distance double"), "cells")
    low = Window.partitionBy("cell").orderBy("distance")
    near = data.select("cell", "distance").withColumn("n", F.row_number().over(low)).where(F.col("n") <= k + 1).groupBy("cell").agg(F.sort_array(F.collect_list("distance")).alias("near"))
    cells = data.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).join(near, "cell").collect()
    cells = sorted(cells, key=lambda c: c["cell"])
    number = np.array([c["cell"] for c in cells])
    radius = np.array([c["radius"] for c in cells]) + 1e-6
    blocks = [int(-(-c["n"] // BLOCK)) for c in cells]
    split = [(c["cell"], b) for c, b in zip(cells, blocks, strict=True) if b > 1]
    close = np.full((len(cells), k + 1), np.inf)
    for i, c in enumerate(cells):
        close[i, : len(c["near"])] = np.array(c["near"]) + 1e-6

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, CELLS // close.size)
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                q = matrix(part.column("v"), size)
                norm = np.sqrt((q * q).sum(1))[:, None]
                middle = q @ P[number].T
                # k + 1 candidates at least are this good: one of them may be the query itself
                sure = np.sort((middle[:, :, None] - norm[:, :, None] * close[None]).reshape(len(q), -1), axis=1)
                bound = sure[:, -min(k + 1, sure.shape[1])]
                bound = np.where(np.isfinite(bound), bound, -np.inf)
                need = middle + norm * radius[None] >= bound[:, None] - 1e-6
                ids = part.column("vec_id").to_numpy()
                out = [(int(number[c]), b, ids[at].tobytes(), q[at].tobytes()) for c in range(len(number)) if len(at := np.flatnonzero(need[:, c])) for b in range(blocks[c])]
                columns = list(zip(*out, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["cell", "block", "ids", "queries"])

    def solve(key: tuple, d: pa.Table, q: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not d.num_rows or not q.num_rows:
            return schema.empty_table()
        d = d.sort_by("vec_id")
        owners, x = d.column("vec_id").to_numpy(), matrix(d.column("v"), size)
        ids = np.frombuffer(b"".join(q.column("ids").to_pylist()), np.int64)
        queries = np.frombuffer(b"".join(q.column("queries").to_pylist())).reshape(-1, size)
        exact = np.abs(x).max() * np.abs(queries).max() * size < 2**53
        out = []
        for a in range(0, len(ids), 256):
            if exact:
                s = queries[a : a + 256] @ x.T
            else:  # beyond what a double holds exactly
                s = (queries[a : a + 256].astype(np.int64)[:, None, :] * x.astype(np.int64)[None]).sum(2)
            own = ids[a : a + 256, None] == owners[None]
            s = np.where(own, -np.inf, s.astype(np.float64)) if exact else np.where(own, np.iinfo(np.int64).min + 1, s)
            best = top(s, owners, k)
            row = np.repeat(np.arange(len(best)), best.shape[1])
            flat = best.ravel()
            keep = ~own[row, flat]
            row, flat = row[keep], flat[keep]
            out.append((ids[a + row], owners[flat], s[row, flat].astype(np.int64)))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=schema)

    spread = F.broadcast(spark.createDataFrame(split, "cell int, blocks int"))  # cells of several blocks: fewer than pivots
    data = data.join(spread, "cell", "left").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.coalesce("blocks", F.lit(1))).cast("int")).select("cell", "block", "vec_id", "v")
    routed = rows.where(is_query).mapInArrow(route, "cell int, block int, ids binary, queries binary")
    best = data.groupBy("cell", "block").cogroup(routed.groupBy("cell", "block")).applyInArrow(solve, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_voronoi_knn(spark, sf_dir: str) -> DataFrame:
    return joined(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(CAST(q.c AS DOUBLE[]), CAST(d.c AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""
