"""Shared pieces: the shared folder, staged tables, byte-bounded slices of Arrow batches, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker works on at once.
SLICE_BYTES = 4 << 20
#: Edges that a Python worker connects at once.
SLICE_EDGES = 1 << 20
#: Whether Spark deletes a query's shuffle files at its end.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary one serves a local master, whose executors are
    this machine; any other master is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="svloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read again: later steps see one fixed state of it and survive the loss of executors. With
    ``free`` the shuffle files of the write go as soon as it ends, not when Spark next collects garbage."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    # rows can hold some MB each: the writer then looks at its memory after a few rows, not after a hundred
    writer = df.write.option("compression", "zstd").option("parquet.block.size.row.check.min", "8").option("parquet.page.size.row.check.min", "8")
    before = spark.conf.get(FREE, "false")
    try:
        spark.conf.set(FREE, "true" if free else before)
        writer.parquet(path)
    finally:
        spark.conf.set(FREE, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._svloom_path = path
    return out


def release(spark: SparkSession) -> None:
    """Frees the shuffle files of finished steps: Spark deletes them once nothing on the driver refers to them, but only when it collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def drop_staged(*tables: DataFrame) -> None:
    """Deletes staged tables that no later step reads."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._svloom_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def apart(df: DataFrame, used: list[str]) -> tuple[DataFrame, list[Column]]:
    """df with all columns but the used ones renamed to names that no operator has, and the columns that give its own back, in order."""
    names = [next((u for u in used if u.lower() == c.lower()), f"column {i}") for i, c in enumerate(df.columns)]
    return df.toDF(*names), [F.col(f"`{n}`").alias(c) for n, c in zip(names, df.columns, strict=True)]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_hash(rows: DataFrame, column: str, n: int) -> DataFrame:
    """The n rows with the smallest hash of a column. Rows are filtered by the hash first, so that tasks do not each pass on n of them; a
    fifth more than n are left by that, or all rows of a small table."""
    total = rows.count()
    spread = F.pmod(F.xxhash64(column), F.lit(1 << 52))
    return rows.where(spread <= int((1 << 52) * min(1.0, 1.2 * n / max(total, 1)))).orderBy(spread, column).limit(n)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def byte_lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each string or binary value; 0 for null."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batch with at most ``most`` bytes in the column (or, of a column of numbers, with at most that sum), one row at least."""
    if not batch.num_rows:
        return
    sizes = batch.column(column)
    at = np.cumsum(sizes.to_numpy(zero_copy_only=False) if pa.types.is_integer(sizes.type) else byte_lengths(sizes))
    start, done = 0, 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(at, done + most, side="right")))
        yield batch.slice(start, end - start)
        start, done = end, int(at[end - 1])


def encoded(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; empty for null."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    out = np.ones(total, dtype=np.int64)
    out[0] = starts[0]
    at = np.cumsum(lengths)[:-1]
    out[at] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(out, out=out)


def connected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (a, b) of some batches as stars (a larger, b the smallest node that a reaches by them): smallest labels travel along edges,
    and labels point on to their own labels. Each SLICE_EDGES edges are one graph, so a task's memory has a bound."""
    parts, n = [], 0

    def stars() -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
        a, b = at.reshape(2, -1)
        label = np.arange(len(nodes))
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            for end in (a, b):
                np.minimum.at(new, end, low)
                np.minimum.at(new, label[end], low)
            while (new[new] != new).any():
                new = new[new]
            if (new == label).all():
                break
            label = new
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], ["a", "b"])

    for batch in batches:
        if batch.num_rows:
            parts.append(np.stack([batch.column("a").to_numpy(), batch.column("b").to_numpy()]))
            n += batch.num_rows
        if n >= SLICE_EDGES:
            yield stars()
            parts, n = [], 0
    if parts:
        yield stars()


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (a, b): the smallest node that it can reach. Null or equal ends are ignored.

    Every task first turns its own edges into stars. Then alternating large-star and small-star rounds run, whose states are staged in the
    shared folder, until all edges together are stars. A hub's edges are never gathered: a node's smallest neighbour comes from an aggregate
    with map-side combine and joins back."""
    now = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = staged(now.mapInArrow(connected, "a long, b long"), name)
    for _ in range(rounds):
        # done when every node either has one edge, to a smaller node, or only edges from larger ones
        degrees = now.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("out")), F.struct(F.col("b").alias("node"), F.lit(0).alias("out")))).alias("e")).select("e.*")
        degrees = degrees.groupBy("node").agg(F.sum("out").alias("out"), F.count("*").alias("n"))
        if not degrees.where("out > 1 OR out = 1 AND n > 1").limit(1).count():
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # now all edges run from a node to a smaller one; small star over a and its smaller neighbours
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b")
        after = staged(small.distinct(), name)
        drop_staged(now)
        now = after
    else:
        raise RuntimeError("components did not settle")
    out = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = out.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    out._svloom_path = now._svloom_path
    return out
