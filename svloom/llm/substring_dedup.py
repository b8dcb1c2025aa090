"""Substring dedup: Rabin-Karp hashes of every window of ``width`` words, counted in Spark; words under a repeated window go.

1. Documents are staged with a chunk number (some MB of text each), so that later passes see the same chunks.
2. Each chunk hashes all its windows and sends its distinct hashes, sorted and cut by their leading bits, one packed row per range.
   A hash that repeats within a chunk is known there; across chunks a hash travels once per chunk, however hot it is.
3. Each range marks the hashes that more than one chunk has sent, and answers every chunk with one bit per hash. There are as many ranges
   as RANGE_BYTES of text ask for, so none grows with the corpus.
4. Chunk and answers meet again; windows that repeat merge into maximal removal intervals.

What moves is 12 bytes per distinct window and chunk, and one bit back. A hash has 96 bits: 64 of one polynomial over one hash of the words,
32 of another over another. Among 10^13 windows, the expected number of false equals is 10^26 / 2^96, about 0.001.

Columns of documents named n_words, n_removed or removed are replaced by the operator's.

Edge cases: null and empty texts have no words; shorter texts than the window lose nothing; exact copies lose all their words if they
have a window at all; rows with null or repeated doc_id are separate documents; an empty table gives no rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_lengths, encoded, read_table, release, shuffle_partitions, slices, staged

WIDTH = 35
#: Text whose windows make up a range, and text that is finished in one partition.
RANGE_BYTES, PARTITION_BYTES = 16 << 20, 64 << 20
OWN = ("n_words", "n_removed", "removed")
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        if len(_powers.get(b, ())) < n:
            x = np.full(1 << (n - 1).bit_length(), b, np.uint64)
            x[0] = 1
            _powers[b] = np.cumprod(x)
        out.append(_powers[b][:n])
    return tuple(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the hash's bits, so that ranges of its leading bits are even."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def both_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each word: the halves of one of 128 bits."""
    halves = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2)
    return np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1])


def rolling(words: np.ndarray, width: int, base: int = _BASES[0]) -> np.ndarray:
    """Rabin-Karp hash of the windows that start at each word and end within the array."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    up, down = powers(len(words) + 1, base)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * down[: len(words) - width + 1])


def ordered(hashes: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): the order of 96-bit hashes, and at which of them in that order a new one begins."""
    order = np.argsort(hashes, kind="stable")
    h, m = hashes[order], more[order]
    same = h[1:] == h[:-1]
    if (same & (m[1:] != m[:-1])).any():  # equal in 64 bits only
        order = np.lexsort((more, hashes))
        h, m = hashes[order], more[order]
        same = h[1:] == h[:-1]
    new = np.ones(len(h), bool)
    new[1:] = ~(same & (m[1:] == m[:-1]))
    return order, new


class Chunk:
    """Words and window hashes of a chunk's texts. A window counts where its document has all its words."""

    def __init__(self, texts: list[bytes], width: int):
        rows = [t.split() for t in texts]
        self.words = [w for r in rows for w in r]
        self.n = np.fromiter(map(len, rows), np.int64, len(rows))
        self.ends = np.cumsum(self.n)
        self.width = width
        one, two = both_hashes(self.words)
        hashes = rolling(one, width)
        self.starts = np.flatnonzero(np.repeat(self.ends, self.n)[: len(hashes)] >= np.arange(len(hashes)) + width)
        hashes = hashes[self.starts]
        more = (rolling(two, width, _BASES[1])[self.starts] >> np.uint64(32)).astype(np.uint32)
        order, new = ordered(hashes, more)
        at = np.flatnonzero(new)
        #: distinct hashes in order, which of them the chunk has more than once, and the one of each window
        self.distinct, self.more = hashes[order[at]], more[order[at]]
        self.again = np.diff(np.append(at, len(order))) > 1
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1

    def removed(self, repeated: np.ndarray) -> np.ndarray:
        """For each word, whether a window with a repeated hash covers it; repeated: a mark per distinct hash."""
        hit = self.starts[repeated[self.which]]
        edges = np.zeros(len(self.words) + 1, np.int32)
        edges[hit] += 1
        edges[hit + self.width] -= 1
        return np.cumsum(edges[:-1]) > 0

    def cuts(self, ranges: int) -> list[int]:
        """Where the distinct hashes of each range begin, and their end."""
        limits = np.array([(r << 64) // ranges for r in range(1, ranges)], np.uint64)
        return [0, *np.searchsorted(self.distinct, limits).tolist(), len(self.distinct)]


def packed(hashes: np.ndarray, more: np.ndarray) -> bytes:
    """Sorted hashes by byte planes, leading bytes first: those hardly change and compress away."""
    return hashes.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes() + more.tobytes()


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // 12
    planes = np.frombuffer(raw, np.uint8, 8 * n).reshape(8, n)
    return np.ascontiguousarray(planes.T).view(">u8").ravel().astype(np.uint64), np.frombuffer(raw, np.uint32, n, 8 * n)


def chunked(documents: DataFrame) -> DataFrame:
    """Staged rows of one chunk each: its number, and each column of documents as an array. A row is never split, so later passes see the same chunks."""
    names = documents.columns
    arrays = ", ".join(f"`{f.name}` array<{f.dataType.simpleString()}>" for f in documents.schema)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text"):
                at = pa.array([0, part.num_rows], pa.int32())
                size = int(byte_lengths(part.column("text")).sum())
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([size]), *[pa.ListArray.from_arrays(at, pa.concat_arrays([c])) for c in part.columns]], ["chunk #", "bytes #", *names])
                chunk += 1

    return staged(documents.mapInArrow(number, f"`chunk #` long, `bytes #` long, {arrays}"), "chunks")


def answers(chunks: DataFrame, width: int, ranges: int) -> DataFrame:
    """(chunk, range, bits): for each distinct hash of the chunk in the range, whether another chunk has it too."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, texts in ((k.as_py(), t) for b in batches for k, t in zip(b.column("chunk"), b.column("text"), strict=True)):
            c = Chunk(encoded(texts.values), width)
            at = c.cuts(ranges)
            some = [r for r in range(ranges) if at[r] < at[r + 1]]
            blobs = [packed(c.distinct[at[r] : at[r + 1]], c.more[at[r] : at[r + 1]]) for r in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([chunk] * len(some), pa.int64()), pa.array(blobs, pa.binary())], ["range", "chunk", "hashes"])

    def count(key: tuple, table: pa.Table) -> pa.Table:
        chunks, blobs = table.column("chunk").to_pylist(), [unpacked(x) for x in table.column("hashes").to_pylist()]
        order, new = ordered(*(np.concatenate([b[i] for b in blobs]) for i in (0, 1)))
        repeated = ~new  # a chunk sends a hash once: equal neighbours are from different chunks
        repeated[:-1] |= ~new[1:]
        back = np.empty(len(order), bool)
        back[order] = repeated
        ends = np.cumsum([len(b[0]) for b in blobs]).tolist()
        bits = [np.packbits(back[a:b]).tobytes() for a, b in zip([0, *ends], ends, strict=False)]
        return pa.table([pa.array(chunks, pa.int64()), pa.array([key[0].as_py()] * len(chunks), pa.int32()), pa.array(bits, pa.binary())], ["chunk", "range", "bits"])

    sent = chunks.select(F.col("`chunk #`").alias("chunk"), "text").mapInArrow(send, "range int, chunk long, hashes binary")
    return sent.repartition(max(ranges, shuffle_partitions(chunks.sparkSession)), "range").groupBy("range").applyInArrow(count, "chunk long, range int, bits binary")


def deduplicated(documents: DataFrame, width: int = WIDTH, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256. With ``texts`` all columns of documents instead, the text without its repeated words
    (as it was if it has none), and n_words, n_removed, and the removal intervals [first, end) in words."""
    spark = documents.sparkSession
    documents = documents.drop(*OWN) if texts else documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunks = chunked(documents)
    volume = chunks.agg(F.sum("bytes #")).first()[0] or 0
    ranges = max(1, -(-volume // RANGE_BYTES))
    partitions = max(shuffle_partitions(spark), -(-volume // PARTITION_BYTES))
    release(spark)  # what was shuffled before
    # the shuffled hashes, which take more disk than all else here, go before chunks and answers are shuffled
    marks = staged(answers(chunks, width, ranges), "marks", free=True)
    names = documents.columns
    if texts:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema) + ", n_words long, n_removed long, removed array<array<long>>"
    else:
        schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"

    def finish(key: tuple, rows: pa.Table, marks: pa.Table) -> pa.Table:
        columns = {n: rows.column(n).combine_chunks().flatten() for n in names}
        c = Chunk(encoded(columns["text"]), width)
        at = c.cuts(ranges)
        repeated = c.again.copy()
        for r, bits in zip(marks.column("range").to_pylist(), marks.column("bits").to_pylist(), strict=True):
            repeated[at[r] : at[r + 1]] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=at[r + 1] - at[r]).astype(bool)
        gone = c.removed(repeated)
        n_removed, kept, spans = [], [], []
        for i, (a, b) in enumerate(zip((c.ends - c.n).tolist(), c.ends.tolist(), strict=True)):
            g = gone[a:b]
            n = int(g.sum())
            n_removed.append(n)
            words = c.words[a:b] if not n else [c.words[a + k] for k in np.flatnonzero(~g).tolist()]
            if texts:
                kept.append(b" ".join(words).decode() if n else columns["text"][i].as_py())
                spans.append(np.flatnonzero(np.diff(np.concatenate([[0], g.astype(np.int8), [0]]))).reshape(-1, 2).tolist())
            else:
                kept.append(hashlib.sha256(b" ".join(words)).hexdigest())
        counts = {"n_words": pa.array(c.n), "n_removed": pa.array(n_removed, pa.int64())}
        if texts:
            return pa.table(columns | {"text": pa.array(kept, pa.string())} | counts | {"removed": pa.array(spans, pa.list_(pa.list_(pa.int64())))})
        return pa.table({"doc_id": columns["doc_id"]} | counts | {"kept_sha256": pa.array(kept, pa.string())})

    rows = chunks.drop("bytes #").repartition(partitions, "chunk #")
    return rows.groupBy("chunk #").cogroup(marks.repartition(partitions, "chunk").groupBy("chunk")).applyInArrow(finish, schema)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return deduplicated(read_table(spark, sf_dir, "documents"))
