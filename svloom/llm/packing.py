"""Best-fit packing with large-item matching: documents above a third of the capacity pair at most twice per sequence, smaller ones
best-fit the gaps that remain.

Lengths are whole numbers up to the capacity, so the packing is planned on a histogram: at most ``capacity`` counters, whatever the
size of the corpus. The plan says, for each length, which ranks go to which sequences; a piece finds its place from its rank among the
pieces of its length. Ranks come from counts per task and length, not from a global sort.

Edge cases: a null text is an empty one, which still has its end token; longer documents are cut from the end, so that only their
first piece can be short; equal documents are all packed; an empty table gives no rows."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ragged, read_table, slices, staged

CAPACITY, END = 1024, 2
#: Units that a worker keeps encoded; beyond it, it starts anew. Units that the library gets in one text.
CACHE_UNITS, UNITS_AT_ONCE = 1_000_000, 1000
#: White space other than single spaces and line breaks, and neighbours of it that the split pattern takes together.
UNCLEAN = ["  ", " \n", "\n ", "\n\n", *map(chr, [9, 11, 12, 13, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])]
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, rank long"


class UnitEncoder:
    """Ids of whole texts from a byte-level BPE tokenizers file.

    The file's split pattern never joins what stands before a single space (or line break) with what stands after it, beyond giving
    the space to the word that follows. So texts with no other white space are encoded word by word, each distinct word once, by the
    library; other texts, and those with special tokens, go to the library whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.line = self.library.encode("\n", add_special_tokens=False).ids[0]
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        from array import array

        self.known: dict[str, int] = {}
        self.bank, self.starts, self.sizes = array("I"), array("q"), array("q")

    def keep(self, keys: list[str]) -> None:
        """Encodes new units, many in one text, one per line: no token spans a line break, and no unit has one inside."""
        for a in range(0, len(keys), UNITS_AT_ONCE):
            some = keys[a : a + UNITS_AT_ONCE]
            ids = self.library.encode_batch_fast(["\n".join([k[1:] if k[0] in "\n\t" else " " + k for k in some])], add_special_tokens=False)[0].ids
            at = [-1, *[i for i, x in enumerate(ids) if x == self.line], len(ids)]
            if len(at) != len(some) + 1:
                raise ValueError("the vocabulary joins line breaks with words")
            for k, i, j in zip(some, at[:-1], at[1:], strict=True):
                own = ids[i:j] if k[0] == "\n" and i >= 0 else ids[i + 1 : j]
                if k[0] == "\n" and i < 0:
                    own = [self.line, *own]
                self.known[k] = len(self.sizes)
                self.starts.append(len(self.bank))
                self.sizes.append(len(own))
                self.bank.extend(own)

    def units(self, text: str) -> list[str] | None:
        """The text's units: words that a space precedes as they are, others with what precedes them, a line break or (a tab: first) nothing.
        None if it must be encoded whole."""
        if not text or text[0] in " \n" or text[-1] in " \n" or any(x in text for x in UNCLEAN) or any(s in text for s in self.special):
            return None
        words = text.replace("\n", " \n").split(" ")
        words[0] = "\t" + words[0]
        return words

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > CACHE_UNITS:
            self.forget()
        flat: list[str] = []
        ends, whole = [0], {}
        for k, t in enumerate(texts):
            u = self.units(t)
            if u is None:
                whole[k] = t
            else:
                flat += u
            ends.append(len(flat))
        at = list(map(self.known.get, flat))
        if missing := [i for i, k in enumerate(at) if k is None]:
            self.keep(list(dict.fromkeys(flat[i] for i in missing)))
            for i in missing:
                at[i] = self.known[flat[i]]
        which = np.array(at, dtype=np.int64)
        if flat:
            n = np.frombuffer(self.sizes, dtype=np.int64)[which]
            ids = np.frombuffer(self.bank, dtype="<u4")[ragged(np.frombuffer(self.starts, dtype=np.int64)[which], n)]
        else:
            n, ids = which, np.zeros(0, "<u4")
        at = np.concatenate([[0], np.cumsum(n)])[ends].tolist()
        out = [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        if whole:
            for k, e in zip(whole, self.library.encode_batch_fast(list(whole.values()), add_special_tokens=False), strict=True):
                out[k] = np.array(e.ids, dtype="<u4")
        return out


@lru_cache(2)
def loaded(path: str) -> UnitEncoder:
    return UnitEncoder(path)


def pieces(documents: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The documents' pieces, each with its task and its rank among the task's pieces of its length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, seen = loaded(vocabulary), TaskContext.get().partitionId(), Counter()
        last = np.array([end], dtype="<u4")
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.encode([t or "" for t in part.column("text").to_pylist()]), strict=True):
                    ids = np.concatenate([ids, last])
                    a, k = 0, 0
                    while a < len(ids):
                        b = a + ((len(ids) - 1) % capacity + 1 if k == 0 else capacity)
                        rows.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), task, seen[b - a]))
                        seen[b - a] += 1
                        a, k = b, k + 1
                kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECE)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Sequences as (lengths, how many sequences have them), for so many pieces of each length.

    Large pieces, above a third of the capacity: each in descending order, with the largest other one that fits. Then small pieces in
    descending order: each into the sequence with the smallest gap that holds it. Both run on whole runs of equal lengths."""
    left = {n: c for n, c in counts.items() if c}
    third = capacity // 3
    large = sorted((n for n in left if n > third), reverse=True)
    kinds: list[tuple[list[int], int]] = []
    for n in large:
        while left[n]:
            partner = next((m for m in large if m <= capacity - n and left[m] > (m == n)), None)
            if partner is None:
                kinds.append(([n], left[n]))
                left[n] = 0
            elif partner == n:
                kinds.append(([n, n], left[n] // 2))
                left[n] %= 2
            else:
                k = min(left[n], left[partner])
                kinds.append(([n, partner], k))
                left[n] -= k
                left[partner] -= k
    gaps: dict[int, list[tuple[list[int], int]]] = {}
    for lengths, k in kinds:
        gaps.setdefault(capacity - sum(lengths), []).append((lengths, k))
    for n in sorted((n for n in left if n <= third), reverse=True):
        need = left[n]
        while need:
            gap = min((g for g in gaps if g >= n and gaps[g]), default=None)
            if gap is None:
                per = capacity // n
                full, rest = divmod(need, per)
                for each, k in ((per, full), (rest, 1)):
                    if each and k:
                        gaps.setdefault(capacity - each * n, []).append(([n] * each, k))
                break
            lengths, k = gaps[gap].pop()
            per = gap // n
            full, rest = divmod(need, per)
            used = min(k, full)
            if used:
                gaps.setdefault(gap - per * n, []).append((lengths + [n] * per, used))
            elif rest:
                gaps.setdefault(gap - rest * n, []).append((lengths + [n] * rest, 1))
                used, need = 1, need - rest + per
            need -= used * per
            if k > used:
                gaps.setdefault(gap, []).append((lengths, k - used))
    return [x for g in gaps.values() for x in g]


def places(kinds: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, first sequence, offset): rank r of a row goes to sequence first + r - first rank."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    ranks: Counter = Counter()
    first = 0
    for lengths, k in kinds:
        offset = 0
        for n in lengths:
            rows.setdefault(n, []).append((ranks[n], first, offset))
            ranks[n] += k
            offset += n
        first += k
    return {n: np.array(r, dtype=np.int64) for n, r in rows.items()}


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Staged pieces with sequence_id and offset. Only the histogram of lengths, at most ``capacity`` rows, reaches the driver."""
    per_task = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    totals = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = places(plan(totals, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(base, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                rows = where[int(n)]
                k = np.searchsorted(rows[:, 0], rank[at], side="right") - 1
                sequence[at], offset[at] = rows[k, 1] + rank[at] - rows[k, 0], rows[k, 2]
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op6_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(staged(pieces(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")), "pieces"))
