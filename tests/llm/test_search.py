"""Importance resampling, near vectors and lexical search against SQL, brute force and their defined cases."""

import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.test_edges import ROWS, docs, empty, own_columns  # noqa: F401

ITEMS = [(1, ROWS[8][1]), (2, "alpha0 alpha0 beta7 zeta3 unseen"), (3, None), (4, ""), (5, "unseen words alone"), (5, ROWS[9][1]), (6, "the of and to in that was by with from this are")]


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_vector_graph", "op13_lexical_search"])
def test_sql(spark, sf, name):
    from tidemark.llm.queries import ORACLES, QUERIES

    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = c.sql(ORACLES[name])
    got = QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, (tuple(r[c] for c in sorted(got.columns)) for r in got.collect()))) == sorted(map(str, want.select(*[duckdb.ColumnExpression(c) for c in sorted(got.columns)]).fetchall()))


def features(text):
    w = brute.lowered(text)
    return [zlib.crc32(x.encode()) % 10_000 for x in [*w, *map(" ".join, zip(w, w[1:], strict=False))]], len(w)


def importance(rows, target, percent=25):
    """(id, n_features, weight, score, rank) of each row, as the law says."""
    found = [(d, *features(t)) for d, t in rows]
    s, t = Counter(b for _, f, _ in found for b in f), Counter(b for x in target for b in features(x)[0])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(float((t[b] + 1) * (all_s + 10_000)) / float((s[b] + 1) * (all_t + 10_000))))
    out = []
    for d, f, n in found:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n >= 20))
    order = sorted((i for i in range(len(out)) if out[i][4]), key=lambda i: (-out[i][3], math.inf if out[i][0] is None else out[i][0]))
    rank = {i: k + 1 for k, i in enumerate(order[: percent * len(order) // 100])}
    return [(*x[:4], rank.get(i)) for i, x in enumerate(out)]


def test_crc_of_words():
    from tidemark.llm import tokens
    from tidemark.llm.importance import feature_buckets
    import pyarrow as pa

    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcéñ日x9") for _ in range(rng.choice([1, 2, 5, 9, 40, 64, 65, 200]))) for _ in range(rng.randint(0, 30))) for _ in range(60)] + [None, "", "A"]
    w = tokens.split(pa.array(texts), tokens.ALPHANUMERIC, tokens.LOWER)
    text, bucket = feature_buckets(w, 10_000)
    for i, t in enumerate(texts):
        assert sorted(bucket[text == i]) == sorted(features(t)[0])


def test_importance(spark, docs, empty, bench):  # noqa: F811
    from tidemark.llm.importance import importance_scores, resample

    rows = [(d, t) for d, t, *_ in ROWS]
    pick = lambda df: sorted(map(str, ((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect())))
    for percent in (25, 60, 100):
        assert pick(importance_scores(docs.select("doc_id", "text"), bench, percent)) == sorted(map(str, importance(rows, [t for _, t in ITEMS], percent)))
    assert pick(importance_scores(docs.select("doc_id", "text"), bench.where("false"))) == sorted(map(str, importance(rows, [])))
    drawn = resample(docs, bench, 60)
    own_columns(docs, drawn)
    want = {d for (d, *_, rank) in importance(rows, [t for _, t in ITEMS], 60) if rank}
    assert {r["doc_id"] for r in drawn.collect()} == want
    assert resample(empty, bench).count() == 0


def test_importance_repeats(spark, bench):
    """A third of the rows share one id and text: they are ranked one by one, over several partitions."""
    from tidemark.llm.importance import importance_scores

    rows = [(7 if i % 3 == 0 else i, ROWS[8][1] if i % 3 == 0 else ROWS[12 + i % 10][1]) for i in range(3000)]
    out = importance_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), bench, 50).collect()
    assert sorted(r["rank"] for r in out if r["rank"]) == list(range(1, 1501))
    assert sorted(map(str, ((r["doc_id"], r["score"], r["rank"]) for r in out if r["rank"]))) == sorted(map(str, ((d, s, k) for d, _, _, s, k in importance(rows, [t for _, t in ITEMS], 50) if k)))


def test_importance_draws_the_target(spark):
    """Documents in the words of the target are drawn far more often than others."""
    from tidemark.llm.importance import importance_scores

    rng = random.Random(8)
    kinds = [[f"{a}{i}" for i in range(60)] for a in ("law", "art")]
    rows = [(i, " ".join(rng.choices(kinds[i % 5 > 0], k=60))) for i in range(2000)]
    target = spark.createDataFrame([(" ".join(rng.choices(kinds[0], k=60)),) for _ in range(40)], "text string")
    drawn = [r["doc_id"] for r in importance_scores(spark.createDataFrame(rows, "doc_id long, text string"), target, 20).where("rank is not null").collect()]
    assert len(drawn) == 400 and sum(d % 5 == 0 for d in drawn) > 300


def lexical(rows, items, k=10):
    words = [brute.lowered(t) for _, t in rows]
    there = [Counter(w) for w in words]
    n, total = sum(map(bool, words)), sum(map(len, words))
    df = Counter(t for c in there for t in c)
    out = []
    for q, text in items:
        found = []
        for (d, _), w, c in zip(rows, words, there, strict=True):
            score = 0
            for t in brute.lowered(text):
                if c[t]:
                    m = 100 - 75 + (75 * len(w) * n) // total
                    score += math.floor(1000 * math.log(float(2 * n + 2) / float(2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if score:
                found.append((-score, math.inf if d is None else d, d))
        out += [(q, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(found, key=lambda x: x[:2])[:k])]
    return sorted(map(str, out))


@pytest.mark.parametrize("block_terms", [1 << 20, 20])
def test_lexical(spark, docs, empty, bench, monkeypatch, block_terms):  # noqa: F811
    from tidemark.llm import lexical as L

    monkeypatch.setattr(L, "BLOCK_TERMS", block_terms)
    rows = [(d, t) for d, t, *_ in ROWS]
    for k in (1, 3, 10):
        assert sorted(map(str, map(tuple, L.search(docs.select("doc_id", "text"), bench, k).collect()))) == lexical(rows, ITEMS, k)
    assert L.search(empty, bench).count() == 0 and L.search(docs, bench.where("false")).count() == 0
    assert L.search(docs, bench).columns == ["item_id", "rank", "doc_id", "score"]


def test_lexical_prunes(spark):
    """Common terms of an item are pruned, by bounds that lose no document."""
    from tidemark.llm import lexical as L

    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(800)]
    odds = [1 / (i + 1) for i in range(800)]
    rows = [(i, " ".join(rng.choices(vocabulary, odds, k=rng.randint(5, 200)))) for i in range(1500)]
    items = [(i, " ".join(rng.choices(vocabulary, odds, k=20))) for i in range(30)]
    df, asked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(str, map(tuple, L.search(df, asked).collect()))) == lexical(rows, items)
    terms = asked.withColumn("item", F.col("item_id")).select("item", "text").mapInArrow(L._item_terms, "item long, term long, times long")
    stored = L.postings(df, terms)
    total = stored.agg(F.sum("n")).first()[0]
    planned = L.plan(terms, L.term_bounds(stored, 1500, total, 10), 1500)
    assert planned.where("pruned").count() > 0
    full = {i: int(s.split(", ")[3][:-1]) for i in range(30) for s in lexical(rows, items) if s.startswith(f"({i}, 10,")}
    assert all(r["threshold"] <= full[r["item"]] for r in planned.collect() if r["item"] in full)


def linked(rows, cosine=0.95):
    """vec_id -> (links, component) of rows with distinct ids."""
    good = [(i, np.array(v, dtype=float)) for i, v in rows if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    good = [(i, x / np.abs(x).max()) for i, x in good]
    near = {i: set() for i, _ in rows}
    for a, (i, x) in enumerate(good):
        for j, y in good[:a]:
            if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                near[i].add(j)
                near[j].add(i)
    out = {}
    for i in near:
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        out[i] = (len(near[i]), min(seen))
    return out


def test_vectors(spark):
    from tidemark.llm.neargraph import near_vectors

    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 8))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.r_[base, base[:10] + 0.05 * rng.normal(size=(10, 8)), base[:5] * 1e200, base[5:8] * 1e-200, base[:3]])]
    rows += [(100, None), (101, []), (102, [0.0] * 8), (103, [None] + [1.0] * 7), (104, [float("nan")] * 8), (105, [float("inf")] * 8), (106, [1.0, 2.0]), (107, [2.0, 4.0]), (108, [0.0] * 7 + [1.0])]
    df = spark.createDataFrame([(i, v, "mine") for i, v in rows], "vec_id long, embedding array<double>, n_links string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(df).collect()}
    assert got == linked(rows)
    assert near_vectors(df.where("false")).count() == 0
    again = near_vectors(spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.01]), (None, None)], "vec_id long, embedding array<float>")).collect()
    assert sorted(map(str, map(tuple, again))) == ["(1, 2, 1)", "(1, 2, 1)", "(None, 0, None)", "(None, 2, 1)"]


def test_vectors_hot_groups(spark, monkeypatch):
    """A third of all vectors are near copies and fill many blocks; chains join components; copies count."""
    from tidemark.llm import neargraph as G

    monkeypatch.setattr(G, "HOLDS", 60)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(700, 24))
    hot = rng.normal(size=24)
    x[:230] = hot + 0.1 * rng.normal(size=(230, 24))
    for i in range(300, 340):  # a chain, each near to its neighbours alone
        x[i + 1] = x[i] / np.linalg.norm(x[i]) + 0.28 * (lambda v: v / np.linalg.norm(v))(rng.normal(size=24))
    x[600:650] = x[599]
    rows = [(i, [float(v) for v in y]) for i, y in enumerate(x)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in G.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    want = linked(rows)
    assert max(n for n, _ in want.values()) >= 200 and want[620][0] == 50
    assert got == want


def test_vectors_recall_at_the_limit(spark):
    """Pairs at a cosine of 0.955 among many shards: nine in ten at least, and none below the limit."""
    from tidemark.llm import neargraph as G

    rng = np.random.default_rng(1)
    x = rng.normal(size=(5000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.normal(size=(1500, 32))
    z -= (z * x[:1500]).sum(1)[:, None] * x[:1500]
    z /= np.linalg.norm(z, axis=1)[:, None]
    x = np.r_[x, 0.955 * x[:1500] + math.sqrt(1 - 0.955**2) * z]
    df = spark.createDataFrame([(i, [float(v) for v in y]) for i, y in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in G.near_vectors(df).collect()}
    true = (x @ x.T >= 0.95).sum(axis=1) - 1
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= true).all() and found.sum() >= 0.98 * true.sum()


def test_bits_never_exceed_edits(spark):
    """Pairs that the bitmaps drop have more edits than allowed; of unlike pairs they drop nearly all."""
    from tidemark.llm import nearcopies as N

    rng = random.Random(7)
    base = [f"w{rng.randint(0, 400)}" for _ in range(150)]
    texts, dropped = [], 0
    for share in (0, 0.05, 0.1, 0.15, 0.19, 0.2, 0.25, 0.35, 0.5, 1):
        for _ in range(3):
            texts.append([w if rng.random() > share else f"v{rng.randint(0, 10**6)}" for w in base][: rng.randint(120, 150)])
    texts += [["x"] * 50, ["x"] * 45 + ["y"] * 5, ["x"] * 30, []]
    ids = {}
    seqs = [np.array([ids.setdefault(x, len(ids)) for x in t], dtype=np.int32) for t in texts]
    rows = [(i, len(t), [int(b) for b in N.word_set(N.label(t))]) for i, t in enumerate(seqs)]
    df = spark.createDataFrame(rows, "i int, n int, w array<long>")
    side = lambda x: df.select(F.col("i").alias(x), F.col("n").alias(f"n{x}"), F.col("w").alias(f"w{x}"))
    kept = {(r["a"], r["b"]) for r in side("a").join(side("b"), F.col("a") < F.col("b")).where(N._may_be_near("a", "b")).collect()}
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            longest = max(len(seqs[a]), len(seqs[b]), 1)
            near = N.edits_within([(seqs[a], seqs[b])], np.array([int(longest * 0.2 + 1e-9)]))[0] >= 0
            assert not near or (a, b) in kept
            dropped += (a, b) not in kept
    assert dropped > 100


def test_long_variants_of_one_text_meet_once_if_at_all(spark):
    """Texts of 800 words, alike by three quarters, are told apart by their bitmaps; near ones among them still meet."""
    from tidemark.llm import nearcopies as N

    rng = np.random.default_rng(5)
    base = np.arange(800, dtype=np.int64)
    texts = []
    for _ in range(40):
        t = base.copy()
        at = rng.choice(800, 120, replace=False)
        t[at] = rng.integers(10**4, 10**7, len(at))
        texts.append(t)
    near = texts[0].copy()
    near[:100] = np.arange(5000, 5100)
    texts.append(near)
    rows = [(i, i, len(t), t.tolist()) for i, t in enumerate(texts)]
    met = {(r["a"], r["b"]) for r in N._by_rare_words(spark.createDataFrame(rows, "cid long, root long, n_words int, words array<int>")).collect()}
    assert (0, 40) in met and len(met) < 0.2 * 40 * 39 / 2
    for a, b in ((a, b) for a in range(41) for b in range(a + 1, 41)):
        assert (a, b) in met or N.edits_within([(texts[a], texts[b])], np.array([160]))[0] < 0


def test_windows_longer_than_a_piece(spark):
    """Decontamination by windows of 100 words, over several pieces."""
    from tidemark.llm.decontamination import decontaminate

    rng = random.Random(9)
    item = [f"i{rng.randint(0, 10**6)}" for _ in range(130)]
    filler = [f"f{k}" for k in range(90)]
    texts = {0: filler + item + filler, 1: filler + item[:99] + filler, 2: item[30:], 3: filler}
    docs = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["n_hit"] for r in decontaminate(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"), window=100).collect()}
    assert got == {0: 130, 1: 0, 2: 100, 3: 0}
