"""The index against brute force, and what its search leaves unread."""

import math
import random
from collections import Counter

import pytest

from tidemark.operators import retrieval as R


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    words, odds = [f"w{i}" for i in range(3000)], [1 / (i + 1) ** 0.9 for i in range(3000)]
    docs = [(i, " ".join(rng.choices(words, odds, k=rng.randint(1, 120)))) for i in range(3000)] + [(5000, None), (5001, ""), (5002, "W0, w0! w0"), (5003, docs_like)]
    asked = [(i, " ".join(rng.choices(words, odds, k=rng.randint(1, 8)))) for i in range(20)] + [(100, "w0"), (101, "w2999 w2998 w0 w0"), (102, "nowhere"), (103, None), (104, docs_like)]
    return docs, asked


docs_like = "w1500 w1600 w1700 w1800"


def bm25(docs, asked, k):
    terms = lambda t: "".join(c if c.isascii() and c.isalnum() else " " for c in (t or "").lower()).split()
    there = [(d, terms(t)) for d, t in docs]
    n, avg = len(there), sum(len(w) for _, w in there) / len(there)
    df = Counter(x for _, w in there for x in set(w))
    out = {}
    for q, t in asked:
        found = []
        for d, w in there:
            tf, s = Counter(w), 0
            for x, times in Counter(terms(t)).items():
                if tf[x]:
                    part = math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * tf[x] * (R.K1 + 1) / (tf[x] + R.K1 * (1 - R.B + R.B * len(w) / avg))
                    s += times * math.floor(part * 1e6 + 0.5)
            if s:
                found.append((-s, d))
        out[q] = [(d, -s) for s, d in sorted(found)[:k]]
    return out


def test_search_equals_brute_force_and_skips_blocks(spark, corpus):
    docs, asked = corpus
    index = R.Index.build(spark.createDataFrame(docs, "doc_id long, text string"))
    questions = spark.createDataFrame(asked, "q long, text string")
    for k in (3, 10):
        best, reads = R.search(index, questions, k)
        got = {}
        for r in sorted(best.collect(), key=lambda r: (r["q"], r["rk"])):
            got.setdefault(r["q"], []).append((r["doc_id"], r["score"]))
        assert got == {q: v for q, v in bm25(docs, asked, k).items() if v}
        seen = {r["q"]: (r["postings"], r["read"]) for r in reads.collect()}
        assert all(read <= postings for postings, read in seen.values())
        assert sum(r for _, r in seen.values()) < 0.6 * sum(p for p, _ in seen.values())


def test_a_frequent_term_is_cut_into_blocks(spark, corpus):
    docs, _ = corpus
    index = R.Index.build(spark.createDataFrame(docs, "doc_id long, text string"))
    b = index.blocks.where("term = 'w0'").collect()
    assert len(b) > 8 and max(r["n"] for r in b) < 2 * R.BLOCK
    assert all(r["top"] == max(p["impact"] for p in r["postings"]) for r in b)
    assert sum(r["n"] for r in b) == sum("w0" in (t or "").lower().replace(",", " ").replace("!", " ").split() for _, t in docs)


def test_rerank_prefers_texts_that_say_the_question(spark):
    docs = spark.createDataFrame([(1, "red cars and blue boats"), (2, "boats blue and cars red"), (3, "red wine"), (4, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(0, "red cars and blue boats")], "q long, text string")
    fused = spark.createDataFrame([(0, 3, 0.03), (0, 2, 0.02), (0, 1, 0.02), (0, 4, 0.01)], "q long, doc_id long, fused double")
    rows = R.rerank(fused, asked, docs).orderBy("rk").collect()
    assert [r["doc_id"] for r in rows] == [1, 2, 3, 4]
    assert rows[0]["score"] == pytest.approx(0.5 * 2 / 3 + 0.5, abs=1e-6) and rows[3]["score"] == pytest.approx(0.5 / 3, abs=1e-6)


def shuffled(spark):
    """Bytes that the session has written for exchanges."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    rows = sc.statusStore().executorList(False)
    return sum(rows.apply(k).totalShuffleWrite() for k in range(rows.size()))


def test_no_posting_is_sent_for_an_index_and_one_once_for_all_questions(spark, corpus):
    docs, _ = corpus
    docs = [(d, t) for d, t in docs if d < 2000]
    postings = sum(len(set(t.split())) for _, t in docs)
    table, at = spark.createDataFrame(docs, "doc_id long, text string"), shuffled(spark)
    index = R.Index.build(table)
    built = shuffled(spark) - at
    best, _ = R.search(index, spark.createDataFrame(docs[:300], "q long, text string"), 3)
    assert best.count() == 900 and built < 2 * postings
    assert shuffled(spark) - at - built < 80 * postings


def test_odd_documents_equal_sql(spark, tmp_path, monkeypatch):
    """Repeated rows, ids of several texts, null ids, and shards that end in their midst; questions in parts."""
    import duckdb

    from tidemark.catalog import ORACLES

    monkeypatch.setattr(R, "SHARD", 40)
    monkeypatch.setattr(R, "ASKED", 8)
    rng = random.Random(8)
    text = lambda: " ".join(rng.choice("abcdefghij") * rng.randint(1, 2) for _ in range(rng.randint(1, 12)))
    docs = [(k, text()) for k in range(150)] + [(k % 5, text()) for k in range(40)] + [(7, "a b"), (7, "a a"), (7, "a b"), (None, "a c"), (None, "c c"), (None, "b"), (200, ""), (201, None), (202, "A-bÉc K x"), (202, "...")]
    asked = [(k, text()) for k in range(30)] + [(50, None), (51, "k"), (52, "a a a b c"), (53, "nowhere")]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(asked, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    c = duckdb.connect()
    for name in ("documents", "benchmark"):
        c.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    key = lambda r: (r[0], r[1])
    want = sorted(c.sql(f"select item_id, rk, doc_id, score from ({ORACLES['index_topk']})").fetchall(), key=key)
    got = sorted(map(tuple, R.index_topk(spark, str(tmp_path)).select("item_id", "rk", "doc_id", "score").collect()), key=key)
    assert got == want and any(r[2] is None for r in got)


def test_an_index_of_nothing_finds_nothing(spark):
    for docs in ([], [(1, None), (2, "")]):
        index = R.Index.build(spark.createDataFrame(docs, "doc_id long, text string"))
        best, reads = R.search(index, spark.createDataFrame([(1, "a b"), (2, None)], "q long, text string"))
        assert best.collect() == [] and reads.collect() == []
