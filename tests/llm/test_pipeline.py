"""The pipeline's stages: their rows, their columns, odd input; the whole against its own operators."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.test_brute import brute_components

DATA = "/root/testdata/sf0.001"
#: columns that operators use inside or add, in other types and spellings
CLASH = ["kept", "key", "log_weight", "n_words", "N_REMOVED", "removed", "kept_id", "component_id", "node", "rep", "stratum #", "row #", "chunk #", "piece", "length", "column 0"]


@pytest.fixture(scope="module")
def docs(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    passage = " ".join(f"shared{i}" for i in range(60))
    odd = [(None, "no id here at all", None, None, None), (9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (9003, "y " * 3000, None, "s", 6000), (9004, f"first {passage}", "en", "s", 1), (9005, f"other one {passage} end", "en", "s", 1), (9005, "same id, another text", "en", "s", 1), (9005, "same id, another text", "en", "s", 1)]
    rows = table.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long"))
    return rows.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id"), F.lit(-1)).cast("string")) for c in CLASH})


def test_columns_and_rows(spark, docs):
    before = Counter((r["doc_id"], r["kept"], r["n_words"], r["column 0"]) for r in docs.collect())
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        after = Counter((r["doc_id"], r["kept"], r["n_words"], r["column 0"]) for r in out.collect())
        assert not after - before, name
        assert name != "substring_dedup" or after == before
        assert stage(spark, docs.limit(0), DATA).count() == 0
    pieces = cp.packing(spark, docs, DATA)
    assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == {d for d, *_ in before}
    assert cp.packing(spark, docs.limit(0), DATA).count() == 0


def test_near_dedup_keeps_one_of_each_group(spark, docs):
    rows = [(i, r["text"] or "", r["doc_id"]) for i, r in enumerate(docs.collect())]
    group = {i: c for i, _, c in brute_components([(i, t) for i, t, _ in rows], 5, 80)}
    smallest = {}
    for i, t, d in rows:
        if t.split():
            smallest.setdefault(group[i], []).append((d is None, d or 0, t))
    expected = Counter((None if n else d) for n, d, _ in (min(v) for v in smallest.values()))
    expected += Counter(d for _, t, d in rows if not t.split())
    assert Counter(r["doc_id"] for r in cp.near_dedup(spark, docs, DATA).collect()) == expected


def test_substring_stage_removes_passages(spark, docs):
    texts = {(r["doc_id"], r["text"]): r["n_chars"] for r in cp.substring_dedup(spark, docs, DATA).collect()}
    assert texts[9004, "first"] == 5 and texts[9005, "other one end"] == 13
    words = [(r["text"] or "").encode().split() for r in docs.collect()]
    seen = Counter(hashlib.md5(b" ".join(w[i : i + 35])).digest() for w in words for i in range(len(w) - 34))
    left = Counter()
    for w in words:
        gone = {k for i in range(len(w) - 34) if seen[hashlib.md5(b" ".join(w[i : i + 35])).digest()] > 1 for k in range(i, i + 35)}
        if gone:
            left[b" ".join(x for i, x in enumerate(w) if i not in gone).decode()] += 1
    got = Counter(r["text"] for r in cp.substring_dedup(spark, docs, DATA).collect())
    assert not left - got


def test_run_is_its_stages(spark):
    from svloom.llm.common import read_table, staged

    docs = read_table(spark, DATA, "documents")
    for name, stage in cp.STAGES[:-1]:
        docs = staged(stage(spark, docs, DATA), name)
    out = cp.run(spark, DATA).collect()
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    per = Counter()
    for r in out:
        per[r["sequence_id"]] += r["length"]
    assert max(per.values()) <= 1024
