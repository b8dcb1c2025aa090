"""FASTA references as pieces of bounded size. With a .fai index beside the file, tasks read byte ranges of any contig, and only wanted ones."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import bins_of
from .alignments import opened

PIECE = 4096
SCHEMA = "contig string, offset long, offset_end long, seq string"
#: Pieces nearer than this are read at once, up to a bound for one read.
NEAR, MOST = 1 << 16, 8 << 20
#: Bases of one contig that one group of an indexed read holds.
CHUNK = 1 << 24


def index(spark: SparkSession, path: str) -> DataFrame | None:
    """The .fai index (contig, length, start, bases, width), or None where there is none."""
    try:
        opened(f"{path}.fai").close()
    except FileNotFoundError:
        return None
    return spark.read.csv(f"{path}.fai", sep="\t", schema="contig string, length long, start long, bases long, width long")


def indexed(known: DataFrame, path: str, piece: int = PIECE, wanted: DataFrame | None = None) -> DataFrame:
    """The pieces that overlap wanted(contig, s, e), or all, by byte ranges from the index; pieces are dealt by contig and stretch, so neither
    a long contig nor a small part of it costs a whole read. Spans may reach beyond a contig; those of no length want the piece they are in."""
    pieces = known.where("length > 0").withColumn("offset", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(piece).cast("long"))))
    if wanted is not None:
        low = F.greatest(F.col("s"), F.lit(0))
        bins = wanted.where("contig IS NOT NULL").select("contig", F.explode(bins_of(low, F.greatest(F.col("e"), low + 1), piece)).alias("bin")).distinct()
        pieces = pieces.join(bins.select("contig", (F.col("bin") * piece).alias("offset")), ["contig", "offset"], "left_semi")
    end = F.least(F.col("offset") + piece, F.col("length"))
    byte = lambda p: F.col("start") + F.floor(p / F.col("bases")) * F.col("width") + p % F.col("bases")
    rows = pieces.select("contig", "offset", end.alias("offset_end"), byte(F.col("offset")).alias("a"), (byte(end - 1) + 1).alias("b"))
    rows = rows.repartition("contig", F.floor(F.col("offset") / CHUNK)).sortWithinPartitions("a")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = None
        for batch in batches:
            file = file or opened(path)
            a, b = (batch.column(c).to_pylist() for c in "ab")
            first, seqs = 0, []
            for i in range(1, len(a) + 1):
                if i == len(a) or a[i] - b[i - 1] > NEAR or b[i] - a[first] > MOST:
                    raw = file.read_at(b[i - 1] - a[first], a[first])
                    seqs += [b"".join(raw[x - a[first] : y - a[first]].split()).decode() for x, y in zip(a[first:i], b[first:i], strict=True)]
                    first = i
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("contig", "offset", "offset_end")], pa.array(seqs, pa.string())], ["contig", "offset", "offset_end", "seq"])

    return rows.mapInArrow(read, SCHEMA)


def reference(spark: SparkSession, path: str, piece: int = PIECE, wanted: DataFrame | None = None) -> DataFrame:
    """contig, offset, offset_end, seq in pieces of at most ``piece`` bases: with an index those that overlap wanted(contig, s, e), all if
    that is not given. Without an index all: a contig is a record of the text source, cut at ``>``."""
    known = index(spark, path)
    if known is not None:
        return indexed(known, path, piece, wanted)
    # the separator is a line end before >, or the file's first >
    raw = spark.read.option("lineSep", "\n>").text(path).where("trim(value) <> ''")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("value").to_pylist():
                head, _, body = text.lstrip(">").partition("\n")
                seq = "".join(body.split())
                at = list(range(0, len(seq), piece))
                yield pa.RecordBatch.from_arrays([pa.array([head.split()[0]] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array([min(a + piece, len(seq)) for a in at], pa.int64()), pa.array([seq[a : a + piece] for a in at], pa.string())], ["contig", "offset", "offset_end", "seq"])

    return raw.mapInArrow(cut, SCHEMA)


def lengths(reference: DataFrame) -> DataFrame:
    return reference.groupBy("contig").agg(F.max("offset_end").alias("length"))


def contig_lengths(spark: SparkSession, path: str) -> DataFrame:
    """contig, length: from the index where there is one, else from a whole read."""
    known = index(spark, path)
    return lengths(reference(spark, path)) if known is None else known.select("contig", "length")
