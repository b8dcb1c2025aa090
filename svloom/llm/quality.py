"""Quality by importance resampling: each text's weight is the ratio of two hashed n-gram models, target over raw; Gumbel top-k samples by it.

The raw model counts the n-grams (pairs of words, triples of bytes) of all documents; the target model those of labelled good ones, out
of at most SAMPLE labelled rows, taken by the hash of doc_id. Both are kept for each stratum by itself (the hash of the language, STRATA at
most), so that a language which is rarer among the labels than in the corpus is not what is sampled against. The target model is mixed with
the raw one in equal parts, so an n-gram that no labelled text has costs log 2 and no more. A text's log weight is the sum of its
n-grams' log ratios.

Gumbel top-k: key = log weight + Gumbel noise from the doc_id's hash; the k largest keys are kept. k defaults to the share of good ones
among the labelled rows, of all documents. The k-th key is found by counting keys in ever finer ranges, without a global sort.

Edge cases: null, empty and blank texts have no n-grams; their weight is EMPTY, far below all others; equal keys at the k-th place (repeated
rows) stay together; a null language is a stratum like any other; a doc_id with different labels counts as unlabelled, one with several
texts is labelled by its smallest; without any good labels all texts weigh the same and are kept; an empty table gives no rows; columns of
documents named log_weight, key or kept are replaced."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_hash, drop_staged, encoded, read_table, slices, staged
from .substring_dedup import rolling, word_hashes

BITS, SLICES, SAMPLE, STRATA, SEED = 16, 32, 20_000, 16, 4
SIZE = 2 << BITS  # pairs of words, then triples of bytes
EMPTY = -1e9
#: Tasks whose counts are added up in one group, before the groups' sums are.
TASKS = 512
OWN = ("log_weight", "key", "kept")


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every n-gram, text that it is in, words per text)."""
    rows = [t.split() for t in texts]
    n = np.fromiter(map(len, rows), np.int64, len(rows))
    words = word_hashes([w for r in rows for w in r])
    owner = np.repeat(np.arange(len(texts)), n)
    pairs = (rolling(words, 2) >> np.uint64(64 - BITS)).astype(np.int64)
    inside = owner[: len(pairs)] == owner[1 : len(pairs) + 1]
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    of = np.repeat(np.arange(len(texts)), sizes)
    if len(data) > 2:
        triples = (data[:-2] << np.uint64(16) | data[1:-1] << np.uint64(8) | data[2:]) * np.uint64(0x9E3779B97F4A7C15)
        triples = (triples >> np.uint64(64 - BITS)).astype(np.int64) + (1 << BITS)
        whole = of[:-2] == of[2:]
    else:
        triples, whole = np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate([pairs[inside], triples[whole]]), np.concatenate([owner[: len(pairs)][inside], of[:-2][whole] if len(data) > 2 else of[:0]]), n


def with_stratum(documents: DataFrame) -> DataFrame:
    """documents with ``stratum #``: the language's, 0 where there is no such column."""
    named = any(c.lower() == "lang" for c in documents.columns)
    return documents.withColumn("stratum #", F.pmod(F.xxhash64(F.col("lang").cast("string")), F.lit(STRATA)).cast("int") if named else F.lit(0))


def counted(documents: DataFrame) -> np.ndarray:
    """[stratum, bucket]: how often each bucket occurs in all texts of documents(stratum #, text).

    Tasks send their counts in slices, which are added up in two steps, so that no group grows with the number of tasks; what reaches the
    driver has one size."""
    schema = "stratum int, slice int, part int, counts binary"

    def packed(totals: dict[int, np.ndarray], part: int) -> pa.RecordBatch:
        rows = [(s, i, part, x.tobytes()) for s, t in totals.items() for i, x in enumerate(np.split(t, SLICES)) if x.any()]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 4, kinds, strict=True)], ["stratum", "slice", "part", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                bucket, owner, _ = grams(encoded(part.column("text")))
                of = part.column("stratum #").to_numpy()
                for s in np.unique(of).tolist():
                    mine = bucket[of[owner] == s]
                    totals[s] = totals.get(s, 0) + np.bincount(mine, minlength=SIZE)
        yield packed(totals, TaskContext.get().partitionId() // TASKS)

    def add(key: tuple, t: pa.Table) -> pa.Table:
        total = np.zeros(SIZE // SLICES, np.int64)
        for x in t.column("counts").to_pylist():
            total += np.frombuffer(x, np.int64)
        one = t.slice(0, 1)
        return pa.table([one.column("stratum"), one.column("slice"), pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["stratum", "slice", "part", "counts"])

    sums = documents.select("stratum #", "text").mapInArrow(count, schema)
    for keys in (["stratum", "slice", "part"], ["stratum", "slice"]):
        sums = sums.groupBy(*keys).applyInArrow(add, schema)
    out = np.zeros((STRATA, SLICES, SIZE // SLICES), np.int64)
    for r in sums.collect():  # at most STRATA * SLICES rows
        out[r["stratum"], r["slice"]] = np.frombuffer(r["counts"], np.int64)
    return out.reshape(STRATA, SIZE)


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """[stratum, bucket]: log ratio of the models' probabilities, each stratum and family of n-grams by itself. Raw counts are one more than
    seen; the target's are mixed with as many of the raw model's shape. A stratum without labels has ratio 1."""
    out = np.zeros(raw.shape)
    for s in range(len(raw)):
        for family in np.split(np.arange(SIZE), 2):
            t, r = target[s, family], raw[s, family] + 1
            if t.any():
                p = r / r.sum()
                out[s, family] = np.log((t / t.sum() + p) / 2) - np.log(p)
    return out


def weighed(texts: list[bytes], strata: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Log weight of each text: the sum of its n-grams' log ratios in its stratum."""
    bucket, owner, n = grams(texts)
    return np.where(n > 0, np.bincount(owner, ratio[strata[owner], bucket], len(texts)), EMPTY)


def fitted(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """(log ratios, share of good ones among the labelled rows); the share is 1 without any."""
    clear = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"), F.max("quality").alias("most")).where("quality = most")
    rows = by_hash(clear.select("doc_id", "quality"), "doc_id", sample)
    texts = with_stratum(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "stratum #", "text")
    some = texts.join(F.broadcast(rows), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct("text", "stratum #")).alias("x"))
    some = staged(some.select("quality", "x.*"), "labelled")
    total, good = some.agg(F.count("*"), F.count_if(F.col("quality") == 1)).first()
    target = counted(some.where("quality = 1"))
    drop_staged(some)
    if not target.any():
        return np.zeros((STRATA, SIZE)), 1.0
    return log_ratio(target, counted(with_stratum(documents))), good / total


def scored(documents: DataFrame, ratio: np.ndarray, seed: int = SEED) -> DataFrame:
    """All columns of documents, with log_weight and key."""
    documents = documents.drop(*OWN)
    names = documents.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema) + ", log_weight double"
    model = documents.sparkSession.sparkContext.broadcast(ratio.astype(np.float32))  # STRATA * SIZE * 4 bytes, whatever the data's size

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = weighed(encoded(part.column("text")), part.column("stratum #").to_numpy(), model.value)
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array(w)], [*names, "log_weight"])

    noise = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    return with_stratum(documents).mapInArrow(score, schema).withColumn("key", F.col("log_weight") - F.log(-F.log(noise)))


def kth(keys: DataFrame, k: int) -> float:
    """The k-th largest key: counts in 1,000 ranges, then in the one that holds it, until its keys are equal."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    while low < high:
        step = (high - low) / 1000
        if low + step == low or step == 0:
            break
        part = F.least(F.floor((F.col("key") - low) / step), F.lit(999))
        counts = keys.where(F.col("key").between(low, high)).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        for r in sorted(counts, key=lambda r: -r["part"]):
            if r["n"] >= k:
                low, high = r["low"], r["high"]
                break
            k -= r["n"]
    return low


def sampled(documents: DataFrame, labels: DataFrame, k: int | None = None, texts: bool = True) -> DataFrame:
    """All columns of documents, or doc_id alone, with log_weight, key and kept. With texts, they are weighed a second time rather than staged."""
    ratio, share = fitted(documents, labels)
    table = scored(documents, ratio)
    keys = staged(table.select("doc_id", "log_weight", "key"), "keys")
    total = keys.count()
    k = min(ceil(share * total) if k is None else k, total)
    limit = kth(keys, k) if k else None
    return (table if texts else keys).withColumn("kept", F.col("key") >= F.lit(limit) if k else F.lit(False))


def op4_importance_resampling(spark, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return sampled(documents, read_table(spark, sf_dir, "labels"), texts=False).select(F.col("doc_id").cast("long").alias("doc_id"), "log_weight", "kept")
