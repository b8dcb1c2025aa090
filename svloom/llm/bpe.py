"""BPE encoding and decoding with a pair occurrence index.

The distinct words of a partition's slice stand in one symbol array. An index maps each pair of neighbouring symbols to all its
positions; the active pair with the lowest rank is merged at all of them at once, and only the lists of the neighbours change. As a
merge's products only take part in merges of higher rank, one pass in ascending order gives each word what it gets alone.

Edge cases: null and empty texts have no ids; special token strings in a text become their ids; characters without a token are
dropped, as in the library; very long words are encoded whole."""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ragged, read_table, slices

#: Words that a worker keeps encoded; beyond it, it starts anew.
CACHE_WORDS = 1_000_000


def byte_letters() -> list[str]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, others for letters from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A tokenizers file of kind BPE with word ends: NFC, lower case, a split pattern, byte letters, ranked merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.end = model["end_of_word_suffix"] or ""
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(x if isinstance(x, list) else x.split(" ") for x in model["merges"]):
            self.merges.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a + b]))
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        letters = byte_letters()
        self.by_byte = [self.vocab.get(x) for x in letters]
        self.by_last = [self.vocab.get(x + self.end) for x in letters]
        self.cache: dict[str, int] = {}
        self.forget()

    def forget(self) -> None:
        self.cache.clear()
        self.bank, self.starts, self.sizes = array("I"), array("q"), array("q")

    def pieces(self, word: str) -> list[str]:
        """What the pattern leaves of a word: the normalizer may make white space of it, so the pattern decides."""
        if word.isascii():
            return self.pattern.findall(word.lower())
        return self.pattern.findall("".join(c.lower() for c in unicodedata.normalize("NFC", word)))

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each piece, all merged together through the pair occurrence index."""
        of, last, merges = self.by_byte, self.by_last, self.merges
        sym: list[int] = []
        starts = []
        where: dict[tuple[int, int], list[int]] = {}
        left, right = [], []
        for p in pieces:
            raw = p.encode()
            row = [i for i in map(of.__getitem__, raw[:-1]) if i is not None]
            if (i := last[raw[-1]]) is not None:
                row.append(i)
            n = len(sym)
            starts.append(n if row else -1)
            for k, pair in enumerate(zip(row, row[1:]), n):  # noqa: B905
                if pair in merges:
                    if pair in where:
                        where[pair].append(k)
                    else:
                        where[pair] = [k]
            sym += row
            left += range(n - 1, n + len(row) - 1)
            right += range(n + 1, n + len(row) + 1)
            if row:
                left[n] = right[-1] = -1
        active = [(merges[p][0], p) for p in where]
        heapq.heapify(active)
        while active:
            pair = heapq.heappop(active)[1]
            a, b = pair
            new = merges[pair][1]
            at = where.pop(pair)
            at.sort()
            for i in at:
                j = right[i]
                if sym[i] != a or j < 0 or sym[j] != b:
                    continue  # an earlier merge has taken one of the two
                k, h = right[j], left[i]
                sym[i], sym[j], right[i] = new, -1, k
                if k >= 0:
                    left[k] = i
                    p = new, sym[k]
                    if p in where:
                        where[p].append(i)
                    elif p in merges:
                        where[p] = [i]
                        heapq.heappush(active, (merges[p][0], p))
                if h >= 0:
                    p = sym[h], new
                    if p in where:
                        where[p].append(h)
                    elif p in merges:
                        where[p] = [h]
                        heapq.heappush(active, (merges[p][0], p))
        out = []
        for i in starts:
            ids = []
            while i >= 0:
                ids.append(sym[i])
                i = right[i]
            out.append(ids)
        return out

    def learn(self, words: list[str]) -> None:
        """Encodes new words, all at once, and keeps their ids. A piece that stands alone in a word is a word too."""
        cache = self.cache
        found = [self.pieces(w) for w in words]
        new = list(dict.fromkeys(p for f in found for p in f if p not in cache))
        for p, ids in zip(new, self.encode_pieces(new), strict=True):
            self.keep(p, ids)
        for w, f in zip(words, found, strict=True):
            if w not in cache:
                if len(f) == 1:
                    cache[w] = cache[f[0]]
                else:
                    self.keep(w, [i for p in f for i in self.ids_of(cache[p])])

    def keep(self, key: str, ids: list[int]) -> None:
        self.cache[key] = len(self.sizes)
        self.starts.append(len(self.bank))
        self.sizes.append(len(ids))
        self.bank.extend(ids)

    def ids_of(self, k: int):
        return self.bank[self.starts[k] : self.starts[k] + self.sizes[k]]

    def decode(self, ids: list[int]) -> str:
        """The library's decode without a decoder: tokens joined by a space."""
        return " ".join(map(self.tokens.__getitem__, ids))

    def words(self, text: str) -> list[str]:
        """The text cut at white space, and at special tokens, which stay whole, marked by a NUL before them.

        str.split() takes \x1c to \x1f for white space, the library doesn't: texts with one of these are cut at ASCII space only."""
        cut = str.split if not any(c in text for c in "\x1c\x1d\x1e\x1f") else lambda x: [w for w in regex.split(r"[\t-\r ]+", x) if w]
        if "<|" not in text or not self.cut.search(text):
            return cut(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += cut(text[at : m.start()])
            out.append("\0" + m[0])
            at = m.end()
        return out + cut(text[at:])

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        if len(self.cache) > CACHE_WORDS:
            self.forget()
        words: list[str] = []
        ends = [0]
        for t in texts:
            words += self.words(t)
            ends.append(len(words))
        at = list(map(self.cache.get, words))
        if None in at:
            new = [w for w in dict.fromkeys(words) if w not in self.cache]
            for w in new:
                if w[0] == "\0" and w[1:] in self.special:
                    self.keep(w, [self.special[w[1:]]])
            self.learn([w for w in new if w not in self.cache])
            at = list(map(self.cache.get, words))
        which = np.array(at, dtype=np.int64)
        n = np.frombuffer(self.sizes, dtype=np.int64)[which] if words else which
        starts = np.frombuffer(self.starts, dtype=np.int64)[which] if words else which
        ids = np.frombuffer(self.bank, dtype="<u4")[ragged(starts, n)] if n.any() else np.zeros(0, "<u4")
        at = np.concatenate([[0], np.cumsum(n)])[ends].tolist()
        return [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


@lru_cache(2)
def loaded(path: str) -> WordBpe:
    return WordBpe(path)


def coded(documents: DataFrame, vocabulary: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with ``ids`` also the ids and the decoded text."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * ids

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for batch in batches:
            for part in slices(batch, "text"):
                each = bpe.encode_texts([t or "" for t in part.column("text").to_pylist()])
                decoded = [bpe.decode(x.tolist()) for x in each]
                columns = [part.column("doc_id"), pa.array(map(len, each), pa.int64()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in each]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    columns += [pa.array([x.tolist() for x in each], pa.list_(pa.int64())), pa.array(decoded)]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(code, schema)


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return coded(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
