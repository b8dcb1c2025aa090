"""URL filters by host word segmentation: unigram Viterbi splits concatenated names, multinomial naive Bayes scores the words.

Rules (host, path prefix) come first; the longest that fits decides. Other URLs are judged by the words of host and path.

Both models are fitted on the data, counted in Spark. The unigram model has the VOCABULARY most frequent words of all documents and all
words that the names of all URLs spell out with hyphens. Naive Bayes is fitted on all URLs: there are no labels for URLs, so one whose words
include an entry of WEAK counts as unwanted and all others as wanted; every word that goes with either gets a weight. The weights of the
VOCABULARY most frequent words are broadcast, those of all others join the pages' words.

Edge cases: a null URL or one without ``://`` has an empty host and path, fits no rule and is judged by the prior alone (an
empty URL has no words). Very long names are segmented whole (time grows with their length times the longest word). Repeated rows give
repeated results. Extra columns are ignored. Without documents, names are split at hyphens only; without pages there are no rows."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, read_table, staged
from .quality import kth

#: Words whose presence is the weak label of an unwanted site.
WEAK = frozenset("ads adult bets betting casino cialis escort gambling jackpot lottery payday pills poker porn sex slots spam torrent viagra warez xxx".split())
VOCABULARY, LONGEST = 50_000, 30
#: Letters of a name that are a word of their own, for both models.
WORD = r"[^\W\d_]+"
# Fixed values: (verdict, host, path prefix).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


class Segmenter:
    """Unigram word model; ``split`` finds the most probable words of a name."""

    def __init__(self, counts: Counter):
        self.total = sum(counts.values())
        self.cost = {w: -math.log(c / self.total) for w, c in counts.items()}
        self.lengths = sorted(set(map(len, self.cost)), reverse=True)
        self.unseen = math.log(self.total)

    def split(self, name: str) -> list[str]:
        """Viterbi over all cuts; unseen letters cost ten tenfold-rare letters each, so they stay together as one unknown word."""
        n = len(name)
        best, back = [0.0] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            best[end], back[end] = best[end - 1] + self.unseen + 2.3, end - 1
            for start in (end - k for k in self.lengths if k <= end):
                c = self.cost.get(name[start:end])
                if c is not None and best[start] + c < best[end]:
                    best[end], back[end] = best[start] + c, start
        words, end = [], n
        while end:
            words.append(name[back[end] : end])
            end = back[end]
        words.reverse()
        out: list[str] = []
        joined = False
        for w in words:
            known = w in self.cost
            if not known and joined:
                out[-1] += w
            else:
                out.append(w)
            joined = not known
        return out


class NaiveBayes:
    """Multinomial naive Bayes with add-one smoothing; words unseen in training say nothing.

    counts has each word with the times it goes with wanted and with unwanted URLs, and the numbers of these URLs with a null word. ``weight``
    has the words more frequent than the ``most``-th, or all if there are no more than that; ``rest`` is the table (word, weight) of the
    others, or None."""

    def __init__(self, counts: DataFrame, most: int = VOCABULARY):
        urls = counts.where("word IS NULL").select("wanted", "unwanted").first() or (0, 0)
        words = counts.where("word IS NOT NULL")
        size, *seen = words.agg(F.count("*"), F.sum("wanted"), F.sum("unwanted")).first()
        totals = [(n or 0) + size for n in seen]
        self.prior = math.log((urls[1] + 1) / (urls[0] + 1))
        hot, self.rest = words, None
        if size > most:
            n = F.col("wanted") + F.col("unwanted")
            limit = kth(words.select(n.cast("double").alias("key")), most)
            hot = words.where(n > limit)
            self.rest = words.where(n <= limit).select("word", (F.log((F.col("unwanted") + 1) / totals[1]) - F.log((F.col("wanted") + 1) / totals[0])).alias("weight"))
        self.weight = {r["word"]: math.log((r["unwanted"] + 1) / totals[1]) - math.log((r["wanted"] + 1) / totals[0]) for r in hot.collect()}


def tokens_of(host: str, path: str, split) -> list[str]:
    """Words of the host's labels and of the path: pieces of letters, each segmented."""
    return [w for part in re.findall(WORD, f"{host} {path.lower()}") for w in split(part)]


def word_counts(documents: DataFrame, most: int = VOCABULARY) -> Counter:
    """The most frequent words of all texts, lower-cased, with their counts: all of them, or those more frequent than the ``most``-th. Which
    count that is comes from counting counts; only the words themselves reach the driver."""
    words = documents.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    counts = staged(words.groupBy("word").agg(F.count("*").alias("n")).where((F.length("word") <= LONGEST) & (F.col("n") > 1)), "words")
    chosen = counts if counts.count() <= most else counts.where(F.col("n") > kth(counts.select(F.col("n").cast("double").alias("key")), most))
    out = Counter({r["word"]: r["n"] for r in chosen.collect()})
    drop_staged(counts)
    return out


def spelled(pages: DataFrame) -> Counter:
    """The words that hosts spell out with hyphens, with their counts over all URLs."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts = (parts(u)[0] for u in batch.column("url").to_pylist())
            found = Counter(w for h in hosts for label in h.split(".") if "-" in label for w in re.findall(WORD, label))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    found = pages.select("url").mapInArrow(spell, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return Counter({r["word"]: r["n"] for r in found.collect()})


def url_words(pages: DataFrame, seg: Segmenter) -> DataFrame:
    """Staged (word, wanted, unwanted): how often each word goes with URLs of either kind; the numbers of these URLs have a null word."""
    sent = pages.sparkSession.sparkContext.broadcast(seg)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = lru_cache(100_000)(sent.value.split)
        for batch in batches:
            found = (Counter(), Counter())
            for url in batch.column("url").to_pylist():
                words = tokens_of(*parts(url), split)
                found[any(w in WEAK for w in words)].update([None, *words])
            words = list(found[0] | found[1])
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *[pa.array([c[w] for w in words], pa.int64()) for c in found]], ["word", "wanted", "unwanted"])

    counts = pages.where("url IS NOT NULL").select("url").mapInArrow(count, "word string, wanted long, unwanted long")
    return staged(counts.groupBy("word").agg(F.sum("wanted").alias("wanted"), F.sum("unwanted").alias("unwanted")), "url-words")


def fitted(pages: DataFrame, documents: DataFrame, most: int = VOCABULARY) -> tuple[Segmenter, NaiveBayes]:
    """Both models, from all URLs of pages and the words of all documents. ``most`` bounds the weights that are broadcast, not those that count."""
    counts = word_counts(documents)
    counts.update(spelled(pages))
    counts.update(dict.fromkeys(WEAK, 1))
    seg = Segmenter(counts)
    words = url_words(pages, seg)
    bayes = NaiveBayes(words, most)
    if bayes.rest is None:
        drop_staged(words)
    return seg, bayes


def parts(url: str | None) -> tuple[str, str]:
    """(host, path): what stands between ``://`` and the first of / ? #, A-Z lower-cased, then up to ? or #."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
    return re.sub("[A-Z]+", lambda x: x[0].lower(), m[1]), m[2]


def fitting(host: str, path: str, rules=RULES) -> tuple[str, str] | None:
    """(verdict, rule) of the longest rule that fits; of equally long ones the one with the longer host."""
    fits = [(len(h) + len(p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else None


def judged(pages: DataFrame, models: tuple[Segmenter, NaiveBayes], rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (log odds of unwanted; null where a rule decides)."""
    seg, bayes = models
    out = "page_id long, host string, path string, rule string, verdict string, score double, rest array<string>"
    sent = pages.sparkSession.sparkContext.broadcast((seg, bayes.prior, bayes.weight))  # VOCABULARY words twice at most, and those that names spell out

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, prior, weight = sent.value
        split = lru_cache(100_000)(seg.split)
        for batch in batches:
            rows = []
            for page_id, url in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), strict=True):
                host, path = parts(url)
                verdict, rule = fitting(host, path, rules) or (None, None)
                words = [] if verdict else tokens_of(host, path, split)
                score = None if verdict else prior + sum(weight.get(w, 0.0) for w in words)
                rows.append((page_id, host, path, rule, verdict, score, [w for w in words if w not in weight]))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string())]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "host", "path", "rule", "verdict", "score", "rest"])

    rows = pages.select(F.col("page_id").cast("long"), "url").mapInArrow(judge, out)
    if bayes.rest is not None:
        rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "judged")
        more = rows.select("row", F.explode("rest").alias("word")).join(bayes.rest, "word").groupBy("row")
        # sorted, so that the sum does not depend on the order of the shuffled rows
        more = more.agg(F.aggregate(F.array_sort(F.collect_list("weight")), F.lit(0.0), lambda x, y: x + y).alias("more"))
        rows = rows.join(more, "row", "left").withColumn("score", F.col("score") + F.coalesce("more", F.lit(0.0)))
    verdict = F.coalesce("verdict", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return judged(pages, fitted(pages, read_table(spark, sf_dir, "documents"))).select("page_id", "host", "path", "rule", "verdict")
