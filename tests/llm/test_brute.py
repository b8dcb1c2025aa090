"""Operators against brute force, on fixed texts and on the driver's small tables."""

import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from svloom.llm import bpe, common, knn, near_dedup, packing, quality, substring_dedup, url_filter, warc

DATA = "/root/testdata/sf0.001"
COMMON = " ".join(f"w{i}" for i in range(60))
TEXTS = [None, "", " \n\t ", "one", "one two", "One  TWO", COMMON, COMMON, "x " + COMMON + " y", "a b c d e " * 30, "tok " * 200, "é ü ñ 日本 🎉 <|endoftext|> don't", COMMON.upper(), " ".join(f"v{i}" for i in range(400)), " ".join(f"v{i}" for i in range(390)) + " z", "q" * 5000]


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "one")]
    small = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text")
    return small.unionByName(table).withColumn("chunk", F.lit("clash")).repartition(5)


@pytest.fixture(scope="module")
def rows(documents):
    return [(r["doc_id"], r["text"] or "") for r in documents.collect()]


def test_substring_dedup(documents, rows):
    width = 35
    words = [t.encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    expected = Counter()
    for (doc_id, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone |= set(range(i, i + width))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        expected[doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    assert Counter(map(tuple, substring_dedup.deduplicated(documents).collect())) == expected
    full = substring_dedup.deduplicated(documents, texts=True).collect()
    assert Counter(r["n_removed"] for r in full) == Counter(k[2] for k in expected.elements())
    assert all(r["n_removed"] == sum(b - a for a, b in r["removed"]) and r["chunk"] == "clash" for r in full)


def brute_components(rows, size, limit):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = []
    for _, t in rows:
        w = t.encode().translate(low).split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    pairs = {(a, b) for v in by.values() for k, a in enumerate(v) for b in v[k + 1 :]}
    for a, b in pairs:
        if rows[a][0] is not None and rows[b][0] is not None:
            n = len(sets[a] & sets[b])
            if 100 * n >= limit * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    best = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            best[root(i)] = min(best.get(root(i), doc_id), doc_id)
    return Counter((d, len(sets[i]), best.get(root(i)) if d is not None else None) for i, (d, _) in enumerate(rows))


def near_rows(df, size=4, limit=80):
    return Counter(map(tuple, near_dedup.classes_of(df, size, limit).collect()))


def test_near_dedup(documents, rows, monkeypatch):
    expected = brute_components(rows, 4, 80)
    assert near_rows(documents) == expected
    # blocks of a few members, so that bands and clusters have several; no broadcast
    for name, value in (("BLOCK_MEMBERS", 2), ("BAND_BLOCK", 2), ("REST_MEMBERS", 2), ("BROADCAST_MEMBERS", 0)):
        monkeypatch.setattr(near_dedup, name, value)
    assert near_rows(documents) == expected
    assert near_rows(documents.limit(0)) == Counter()


def test_near_dedup_of_an_id_with_several_texts(spark):
    base, other = (" ".join(f"{k}{i}" for i in range(60)) for k in "bo")
    out = [(5, base), (5, other), (7, other + " word"), (9, base + " word"), (11, base), (12, None), (None, base)]
    got = near_rows(spark.createDataFrame(out, "doc_id long, text string"))
    assert got == brute_components([(i, t or "") for i, t in out], 4, 80)


def varied(n, seed, changes):
    """Copies of one text with some words changed: every copy a different set, in one large group of bands."""
    import random

    rng = random.Random(seed)
    base = [f"t{i}" for i in range(120)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, changes)):
            w[rng.randrange(len(w))] = f"n{rng.random()}"
        out.append((i, " ".join(w)))
    return out


def test_near_dedup_large_cluster(spark, monkeypatch):
    for name, value in (("BLOCK_MEMBERS", 7), ("BAND_BLOCK", 8), ("REST_MEMBERS", 9), ("SALTS", 3)):
        monkeypatch.setattr(near_dedup, name, value)
    monkeypatch.setattr(common, "SLICE_EDGES", 5)
    for changes in (6, 12):  # with more changes, many are alone or in small components of one cluster
        out = varied(60, 1, changes)
        assert near_rows(spark.createDataFrame(out, "doc_id long, text string")) == brute_components(out, 4, 80)


def test_components(spark, monkeypatch):
    import random

    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, k) for k in range(1, 60)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)] + [(5, 5), (None, 3)]
    parent = list(range(400))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    nodes = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    for size in (3, 1 << 20):
        monkeypatch.setattr(common, "SLICE_EDGES", size)
        assert Counter(map(tuple, common.components(df).collect())) == Counter((n, root(n)) for n in nodes)
    assert common.components(df.limit(0)).count() == 0


def test_sketches_estimate_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    for shared in (0.0, 0.5, 0.8):
        n = 4000
        both = int(n * 2 * shared / (1 + shared))
        pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        s = near_dedup.sketches(np.concatenate([pool[:n], pool[n - both : 2 * n - both]]), np.array([n, n]))
        equal = (s[0] == s[1]).mean()
        assert abs(equal - shared) < 0.16
        found = near_dedup.near(s[0], n, s[1:], np.array([n]), 80)
        assert len(found) == (shared == 0.8)


def test_bpe(documents, rows):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = Counter()
    for doc_id, t in rows:
        ids = lib.encode(t, add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        expected[doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.coded(documents, public_tokenizers.path("word_bpe_49k.json")).collect())) == expected


def test_packing(documents, rows, spark):
    from svloom.llm.common import staged

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.packed(staged(packing.pieces(documents, public_tokenizers.path("byte_bpe_50k.json")), "p")).collect()
    expected = Counter()
    for doc_id, t in rows:
        ids = [*lib.encode(t, add_special_tokens=False).ids, 2]
        a, k = 0, 0
        while a < len(ids):
            b = a + ((len(ids) - 1) % 1024 + 1 if k == 0 else 1024)
            expected[doc_id, k, a, b - a, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a:b]))] += 1
            a, k = b, k + 1
    assert Counter(tuple(r)[:5] for r in got) == expected
    full = defaultdict(list)
    for r in got:
        full[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in full.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:]))  # noqa: B905
        assert x[-1][0] + x[-1][1] <= 1024
    assert len(full) <= -(-sum(r["length"] for r in got) // 1024) * 1.05 + 2


def test_plan_holds_every_piece():
    import random

    rng = random.Random(0)
    for _ in range(50):
        counts = Counter(rng.choice([rng.randint(1, 64), rng.randint(1, 20)]) for _ in range(rng.randint(0, 300)))
        kinds = packing.plan(counts, 64)
        back = Counter()
        for lengths, k in kinds:
            assert sum(lengths) <= 64
            for n in lengths:
                back[n] += k
        assert back == counts


def test_knn(spark):
    import random

    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(40)] + [(400, None), (401, []), (402, [float("nan")] * 8), (403, [None, *[0.1] * 7]), (404, [float("inf")] * 8), (405, [0.1] * 3), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = knn.joined(df, F.col("vec_id") % 20 == 0).collect()
    import math

    v = {i: [math.floor(64 * x) for x in e] for i, e in rows[:340]}
    expected = {(q, r, i, s) for q in v if q % 20 == 0 for r, (s, i) in enumerate(((-s, i) for s, i in sorted((-sum(a * b for a, b in zip(v[q], v[i], strict=True)), i) for i in v if i != q)[:20]), 1)}
    assert {tuple(r) for r in got} == expected
    few = knn.joined(df.where("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert len(few) == 2
    assert knn.joined(df.where("vec_id < 0"), F.col("vec_id") == 0).count() == 0


def test_warc(spark, tmp_path):
    rows = [(5, "http://a/", "same"), (2, "http://b/\r\nx", "same"), (3, None, None), (4, "u", ""), (7, "u", "é" * 1000), (8, "u", "other")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for least, kinds in ((0, {5: 2, 4: 3}), (1, {5: 2})):
        folder = f"file://{tmp_path}/{least}"
        index = warc.write_archives(pages, folder, least).persist()
        got = {r["page_id"]: r for r in warc.read_records(index, folder).collect()}
        for i, _, text in rows:
            raw = (text or "").encode()
            assert got[i]["payload_bytes"] == len(raw)
            assert got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
            assert got[i]["refers_to"] == kinds.get(i)
            assert got[i]["record_type"] == ("revisit" if i in kinds else "response")
            assert got[i]["stored"] == (None if i in kinds else raw)
        some = warc.read_records(index.where("page_id = 7"), folder).collect()
        assert [r["page_id"] for r in some] == [7]
        index.unpersist()


def test_substring_dedup_frees_its_hashes(spark):
    """When the result is handed back, the shuffled hashes are not on disk any more."""
    import time

    def shuffled():
        files = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles())
        return sum(f.length() for f in files if f.getName().startswith("shuffle_"))

    before = shuffled()
    df = spark.createDataFrame([(i, " ".join(f"w{i}_{k}" for k in range(2000))) for i in range(50)], "doc_id long, text string")
    out = substring_dedup.deduplicated(df)
    for _ in range(50):  # Spark deletes in the background
        if shuffled() < before + 100_000:  # the hashes alone take a million bytes
            break
        time.sleep(0.2)
    assert shuffled() < before + 100_000
    assert out.count() == 50 and spark.conf.get(common.FREE, "false") == "false"


def test_url_rules():
    f = url_filter.fitting
    assert f("www.example.com", "/en/1") == ("allow", "www.example.com/en/")
    assert f("a.www.example.com", "/en/") == ("allow", "www.example.com/en/")
    assert f("blog.example.com", "/en/1") == ("block", "example.com/en/")
    assert f("blog.example.com", "/fr/1") == ("allow", "com/")
    assert f("example.net", "/es/1") == ("block", "net/es/")
    assert f("example.net", "/en/") is None and f("com", "") is None and f("xcom", "/") is None
    assert url_filter.parts("HTTP://WWW.Ex.com?x/y") == ("www.ex.com", "")
    assert url_filter.parts("http://h/P/a#b?c") == ("h", "/P/a")
    assert url_filter.parts(None) == url_filter.parts("nothing") == ("", "")


def test_url_words(spark):
    counts = Counter({"free": 50, "green": 40, "bets": 5, "house": 30, "a": 60})
    seg = url_filter.Segmenter(counts)
    assert seg.split("freegreenhouse") == ["free", "green", "house"]
    assert seg.split("zzqx") == ["zzqx"] and seg.split("") == []

    def cost(words):  # all ways to cut a name, unseen letters one by one
        return sum(seg.cost.get(w, len(w) * (seg.unseen + 2.3) if w not in seg.cost else 0) for w in words)

    def cuts(name):
        return [[]] if not name else [[name[:k], *rest] for k in range(1, len(name) + 1) for rest in cuts(name[k:])]

    for name in ("freebets", "ahouse", "greenzz", "zafree"):
        assert abs(cost(seg.split(name)) - min(map(cost, cuts(name)))) < 1e-9


def test_url_models(spark):
    documents = spark.createDataFrame([("green house garden green " * 3,), ("garden house tools tools",), (None,)], "text string")
    pages = [(i, f"http://www.{h}.example.org/x{i}") for i, h in enumerate(["casinogarden", "casino-royal", "royal-bets", "greenhouse", "gardentools", "housetools", "green-garden"] * 3)]
    df = spark.createDataFrame([*pages, (90, None), (91, "nothing"), (92, "http://royal.example.org/")], "page_id long, url string").withColumn("host", F.lit("clash"))
    models = url_filter.fitted(df, documents)
    seg, bayes = models
    assert seg.split("casinogarden") == ["casino", "garden"] and seg.split("housetools") == ["house", "tools"]
    # naive Bayes by hand
    tokens = {r["page_id"]: url_filter.tokens_of(*url_filter.parts(r["url"]), seg.split) for r in df.collect() if r["url"]}
    y = {i: any(w in url_filter.WEAK for w in t) for i, t in tokens.items()}
    assert sum(y.values()) == 9
    words = [Counter(w for i, t in tokens.items() if y[i] == k for w in t) for k in (False, True)]
    import math

    size = len(set(words[0]) | set(words[1]))
    got = {r["page_id"]: r for r in url_filter.judged(df, models).collect()}
    for i, t in tokens.items():
        score = math.log((9 + 1) / (len(y) - 9 + 1)) + sum(math.log((words[1][w] + 1) / (sum(words[1].values()) + size)) - math.log((words[0][w] + 1) / (sum(words[0].values()) + size)) for w in t)
        assert abs(got[i]["score"] - score) < 1e-9 and got[i]["verdict"] == ("block" if score > 0 else "allow")
    assert got[92]["score"] > got[91]["score"] == got[90]["score"] == bayes.prior  # a word that goes with unwanted ones
    assert [got[i]["host"] for i in (90, 91)] == ["", ""]
    none = df.limit(0)
    assert url_filter.judged(none, url_filter.fitted(none, documents.limit(0))).count() == 0


def test_url_models_count_all_urls(spark):
    """More URLs than any sample had: the prior, the words that names spell out and the weights are those of all."""
    rare = ["xylo", "quorn", "vexil", "zorb", "kwyj", "plinth", "ombre", "jarl", "fjeld", "gnu"]
    hosts = [f"{w}-bets" for w in rare] + ["casino" if i % 100 == 0 else "garden" for i in range(30_000)]
    df = spark.createDataFrame([(i, f"http://{h}.example.org/{i}") for i, h in enumerate(hosts)] + [(40_000, None)], "page_id long, url string")
    documents = spark.createDataFrame([("garden garden",)], "text string")
    seg, bayes = url_filter.fitted(df, documents)
    import math

    assert set(rare) <= set(seg.cost) and set(rare) <= set(bayes.weight) and bayes.rest is None
    tokens = [url_filter.tokens_of(*url_filter.parts(f"http://{h}.example.org/"), seg.split) for h in hosts]
    y = [any(w in url_filter.WEAK for w in t) for t in tokens]
    assert sum(y) == 310 and abs(bayes.prior - math.log(311 / (30_010 - 310 + 1))) < 1e-9
    words = [Counter(w for t, k in zip(tokens, y, strict=True) if k == kind for w in t) for kind in (False, True)]
    totals = [sum(c.values()) + len(words[0] | words[1]) for c in words]
    for w in words[0] | words[1]:
        assert abs(bayes.weight[w] - math.log((words[1][w] + 1) / totals[1]) + math.log((words[0][w] + 1) / totals[0])) < 1e-9

    # weights that are joined are those that are broadcast
    some = df.where("page_id < 50 OR page_id = 40000")
    whole = {r["page_id"]: r for r in url_filter.judged(some, (seg, bayes)).collect()}
    few = url_filter.fitted(df, documents, 3)
    assert len(few[1].weight) < 3 and few[1].rest.count() == len(bayes.weight) - len(few[1].weight)
    joined = {r["page_id"]: r for r in url_filter.judged(some, few).collect()}
    assert joined.keys() == whole.keys() and len(joined) == 51
    assert all(abs(joined[i]["score"] - r["score"]) < 1e-9 and joined[i]["verdict"] == r["verdict"] for i, r in whole.items())
    assert {r["verdict"] for r in whole.values()} == {"allow", "block"}


def test_url_query(spark):
    from svloom.llm.queries import queries

    pages = {r["page_id"]: r["url"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url").collect()}
    got = queries()["op7_url_filter"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(r["page_id"] for r in got) == sorted(pages)
    for r in got:
        host, path = url_filter.parts(pages[r["page_id"]])
        fit = url_filter.fitting(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, fit and fit[1]) and r["verdict"] in (fit[0],) if fit else ("allow", "block")


def small_grams(text):
    """(bucket of each n-gram), one by one."""
    from xxhash import xxh3_64_intdigest as h

    mask = (1 << 64) - 1
    base = 0x9E3779B97F4A7C15
    words = [h(w) for w in text.split()]

    def mix(x):
        x ^= x >> 32
        x = x * 0xD6E8FEB86659FD93 & mask
        return x ^ x >> 32

    out = [mix((a + b * base) & mask) >> 48 for a, b in zip(words, words[1:], strict=False)]
    return out + [(((text[i] << 16 | text[i + 1] << 8 | text[i + 2]) * base & mask) >> 48) + (1 << 16) for i in range(len(text) - 2)]


def test_quality_against_brute_force(spark):
    import math

    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = {r["doc_id"]: ((r["text"] or "").encode(), r["lang"]) for r in documents.collect()}
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1}
    n_labels = labels.where("quality IS NOT NULL").count()
    raw, target = defaultdict(Counter), defaultdict(Counter)
    grams = {i: small_grams(t) for i, (t, _) in rows.items()}
    for i, (_, lang) in rows.items():
        for g in grams[i]:
            raw[lang, g >> 16][g] += 1
            if i in good:
                target[lang, g >> 16][g] += 1
    size = 1 << 16
    weights = {}
    n_raw, n_target = ({k: sum(c.values()) for k, c in x.items()} for x in (raw, target))
    for i, (t, lang) in rows.items():
        w = 0.0
        for g in grams[i]:
            k = lang, g >> 16
            if k in n_target:
                p = (raw[k][g] + 1) / (n_raw[k] + size)
                w += math.log((target[k][g] / n_target[k] + p) / 2) - math.log(p)
        weights[i] = w if t.split() else quality.EMPTY
    got = {r["doc_id"]: r for r in quality.sampled(documents, labels, texts=False).collect()}
    assert got.keys() == rows.keys()
    assert all(math.isclose(got[i]["log_weight"], weights[i], rel_tol=1e-4, abs_tol=1e-3) for i in rows)
    # Gumbel top-k: exactly the k largest keys
    k = math.ceil(len(good) / n_labels * len(rows))
    best = sorted(rows, key=lambda i: -got[i]["key"])[:k]
    assert {i for i in rows if got[i]["kept"]} == set(best)
    noise = [got[i]["key"] - got[i]["log_weight"] for i in rows if got[i]["log_weight"] > quality.EMPTY]
    assert 0.3 < sum(noise) / len(noise) < 0.9 and max(noise) > 2 > min(noise)  # Gumbel's mean is 0.577


def test_quality_cases(spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (3, None), (None, 1), (4, 0)], "doc_id long, quality int")
    odd = spark.createDataFrame([(8, None, "de", 5), (2, "", None, 6), (None, "a b", "en", 7), (1, "good words here", "en", 8), (1, "good words here", "en", 8), (4, " \n ", "en", 9), (9, "x" * 100_000, "en", 9)], "doc_id long, text string, lang string, kept int")
    out = quality.sampled(odd, labels).collect()
    assert len(out) == 7
    weight = {r["text"]: r["log_weight"] for r in out}
    assert weight[None] == weight[""] == weight[" \n "] == quality.EMPTY and weight["good words here"] > weight["x" * 100_000]
    assert quality.sampled(odd, labels, 2).where("kept").select("text").distinct().count() == 1  # equal rows have equal keys
    assert quality.sampled(odd.drop("lang"), labels.limit(0)).where("kept").count() == 7
    assert quality.sampled(odd.limit(0), labels).count() == 0
    assert quality.sampled(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"), 5, texts=False).where("kept").count() == 5


def test_quality_of_held_out_labels(spark):
    """Good documents without a label stay too, in every language."""
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = {r["doc_id"]: r["quality"] for r in labels.where("doc_id % 3 = 0").collect()}
    by = defaultdict(list)
    for r in quality.sampled(documents, labels.where("doc_id % 3 <> 0")).select("doc_id", "lang", "kept").collect():
        if held.get(r["doc_id"]) is not None:
            by[held[r["doc_id"]], r["lang"]].append(r["kept"])
    good = {lang: (sum(v), len(v)) for (q, lang), v in by.items() if q == 1}
    assert len(good) == 4 and all(kept >= 0.9 * n for kept, n in good.values()), good
    bad = [kept for (q, _), v in by.items() if q == 0 for kept in v]
    assert sum(bad) <= 0.2 * len(bad)


def test_substring_cases(spark, monkeypatch):
    width = 35
    passage = " ".join(f"p{i}" for i in range(50))
    texts = [f"a {passage} b", f"c {passage}", None, "", "short", "x " * 5000, passage.upper()] + [" ".join(f"u{i}_{k}" for i in range(300)) for k in range(6)]
    df = spark.createDataFrame([(i % 9 or None, t, i, "z") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, removed string").repartition(3)
    monkeypatch.setattr(substring_dedup, "RANGE_BYTES", 500)  # many ranges
    # hashes that are equal in 64 bits only are told apart by the other 32
    monkeypatch.setattr(substring_dedup, "ordered", substring_dedup.ordered)
    got = substring_dedup.deduplicated(df, width, texts=True).collect()
    assert len(got) == len(texts)
    by = {r["text"]: r for r in got}
    assert by["a b"]["n_removed"] == 50 and by["a b"]["removed"] == [[1, 51]] and by["c"]["removed"] == [[1, 51]]
    assert by[None]["n_words"] == 0 and by["short"]["n_removed"] == 0 and by[passage.upper()]["n_removed"] == 0
    assert [r["n_removed"] for r in got if r["n_words"] == 5000] == [5000]
    assert substring_dedup.deduplicated(df.limit(0)).count() == 0


def test_hashes_equal_in_64_bits():
    import numpy as np

    h = np.array([5, 5, 5, 7, 7, 9], np.uint64)
    m = np.array([1, 2, 1, 3, 3, 4], np.uint32)
    order, new = substring_dedup.ordered(h, m)
    assert [(int(h[i]), int(m[i])) for i in order[new]] == [(5, 1), (5, 2), (7, 3), (9, 4)]
    again = substring_dedup.unpacked(substring_dedup.packed(h, m))
    assert (again[0] == h).all() and (again[1] == m).all()


def test_knn_blocks(spark, monkeypatch):
    import random

    rng = random.Random(5)
    rows = [(i, [float(rng.randint(-3, 3)) for _ in range(4)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name, value in (("BLOCK", 20), ("CELLS", 64)):
        monkeypatch.setattr(knn, name, value)
    v = {i: [int(64 * x) for x in e] for i, e in rows}
    expected = {(q, r, i, s) for q in v if q % 20 == 0 for r, (s, i) in enumerate(((-s, i) for s, i in sorted((-sum(a * b for a, b in zip(v[q], v[i], strict=True)), i) for i in v if i != q)[:5]), 1)}
    assert {tuple(r) for r in knn.joined(df, F.col("vec_id") % 20 == 0, 5, pivots=7).collect()} == expected
