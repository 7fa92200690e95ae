"""Near duplicates, neighbours, numbers, masks and joins against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evidence


def jaccard(a, b):
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_duplicates_are_components_of_all_similar_pairs(spark):
    """Copies of copies, and texts of which half is one passage, so bands hold unlike texts."""
    random.seed(6)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(25):
        base = passage + [word() for _ in range(random.randint(20, 60))]
        texts.append(" ".join(base))
        for _ in range(random.randint(0, 3)):
            base = list(base)
            for _ in range(random.randint(0, 2)):
                base[random.randrange(60, len(base))] = word()
            texts.append(" ".join(base))
    texts += ["", "one", "one", "two words"]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [set() for _ in texts]
    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or jaccard(texts[i], texts[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
                if texts[i] != texts[j]:
                    links[i].add(texts[j])
                    links[j].add(texts[i])
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in evidence.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {k: v[0] for k, v in got.items()} == {i: find(i) for i in range(len(texts))}
    assert all(v[1] <= len(links[k]) and (v[1] > 0) == bool(links[k]) for k, v in got.items())


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(0, 1, (300, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<double>").repartition(5)
    got = {}
    for r in evidence.nearest(df.where("vec_id % 50 = 0"), df, 4).collect():
        got.setdefault(r["query_id"], {})[r["rk"]] = r["vec_id"]
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(0, 300, 50):
        sim = unit @ unit[q]
        sim[q] = -2
        assert [got[q][k] for k in range(1, 5)] == np.argsort(-sim)[:4].tolist()


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ("fell 12.4% to 60", [(-12.4, "%"), (60.0, "")]),
        ("dropped by 3 pp", [(-3.0, "pp")]),
        ("a loss of -5 lakh", [(-500000.0, "")]),
        ("1.2 crore and 7%", [(12000000.0, ""), (7.0, "%")]),
        ("nothing", []),
    ],
)
def test_numbers_have_signs_and_units(spark, said, want):
    assert [tuple(x) for x in spark.range(1).select(evidence.numbers(F.lit(said)).alias("n")).first()["n"]] == want


def test_masks(spark):
    said = "Dr. Ann Lee (CUST-00123, +49 170 5557713, ann@x.org) paid with 4111 1111 1111 1111 from 10.0.0.1"
    assert spark.range(1).select(evidence.pii_mask(F.lit(said))).first()[0] == "[NAME] ([ID], [PHONE], [EMAIL]) paid with [CARD] from [IP]"


def test_rates_hold_for_orders_after_the_last_one(spark, tmp_path):
    from tidemark.operators.ingestion import asof_fx

    spark.sql("select 1L as o_orderkey, 10.0D as o_totalprice, timestamp_ntz'1996-03-01 00:00:00' as o_orderdate union all select 2L, 10.0D, timestamp_ntz'2005-03-01 00:00:00' union all select 3L, 10.0D, timestamp_ntz'1990-03-01 00:00:00'").write.parquet(f"{tmp_path}/orders.parquet")
    assert sorted((r["o_orderkey"], r["inr"]) for r in asof_fx(spark, str(tmp_path)).collect()) == [(1, 366.0), (2, 447.0), (3, None)]


def test_an_empty_source_streams_nothing(spark, tmp_path):
    from tidemark.streaming.arrivals import stream_ingest

    (tmp_path / "events.parquet").mkdir()
    assert stream_ingest(spark, str(tmp_path)).count() == 0


def test_a_late_row_takes_a_breach_back(spark, tmp_path):
    """Two files, the second with the row that fills the first one's gap."""
    from tidemark.streaming.arrivals import EVENTS, freshness_state

    at = lambda h: f"2024-01-01 {h:02d}:10:00"
    for hours in ((0, 1, 8, 9), (3, 5, 6)):
        rows = spark.createDataFrame([(h, at(h), 1, "click", 1.0, "{}") for h in hours], "event_id long, ts string, user_id long, event_type string, value double, props string")
        rows.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in EVENTS.split(", ")]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    r = freshness_state(spark, str(tmp_path)).first()
    assert (r["red"], r["amber"], r["slots"], r["status"]) == (0, 3, 7, "green")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Published 2024-01-02, effective from 5 March 2024.", "2024-03-05"), ("effective 2024-02-30", None), ("With effect from March 15, 2023 and later 1 May 2025", "2023-03-15"),
        ("on 07/08/2022", "2022-08-07"), ("31/31/2022", None), ("no date", None), ("", None), (None, None), ("EFFECTIVE AS OF 1 January 1999", "1999-01-01"), ("effectively 2020-01-01 began", "2020-01-01"),
    ],
)
def test_effective_dates_are_read_from_texts(spark, text, want):
    got = spark.range(1).select(evidence.effective_date(F.lit(text).cast("string"))).first()[0]
    assert (str(got) if got else None) == want


def test_evidence_weighs_what_a_document_says(spark):
    from tidemark.operators.decisions import evidence_weight, stances

    docs = spark.createDataFrame([(1, "The license, the token: rights 1 2 3 4 5 6 7 8 9 10", "src0", 4000), (2, "nothing", "src3", 0), (3, None, None, None), (4, "the", "src5", 1000)], "doc_id long, text string, source string, n_chars long")
    got = {r["doc_id"]: (r["conf"], r["source_tier"]) for r in evidence_weight(docs).collect()}
    assert got == {1: (1.0, 0), 2: (0.0625, 3), 3: (0.25, 0), 4: (0.25 * 0.25 + 0.25 * 0.75 + 0.125, 1)}
    said = spark.createDataFrame([("e", "sales rose, more gain"), ("e", "not good, no gain, never"), ("e", "nothing"), ("f", "all new")], "event string, text string")
    assert {r["event"]: (r["n"], r["agreeing"], r["contradictory"]) for r in stances(said, F.col("event")).collect()} == {"e": (2, 1, True), "f": (1, 1, False)}


def test_names_are_linked_however_they_are_spelt(spark):
    """All pairs by brute force, over random names with edits anywhere."""
    import random

    rng = random.Random(5)
    names = {"".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 18))) for _ in range(120)}

    def spoilt(x):
        x = list(x)
        for _ in range(rng.randint(0, 4)):
            k = rng.randint(0, len(x))
            x[k : k + rng.randint(0, 1)] = rng.choice(["", "z", "q"])
        return "".join(x)

    other = {spoilt(x) for x in names} | {"", "ab", "ba"}
    left, right = spark.createDataFrame([(x,) for x in names], "a string"), spark.createDataFrame([(x,) for x in other], "b string")
    for least in (0.6, 0.75, 0.9):
        pairs = left.crossJoin(right).withColumn("score", F.round(1 - F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b"), F.lit(1)), 6)).where(F.col("score") >= least)
        assert sorted(map(tuple, evidence.similar_names(left, right, least).collect())) == sorted(map(tuple, pairs.collect()))


def test_short_names_that_share_no_pair_of_letters_are_linked(spark):
    """All names of up to five letters of two, against names of up to five that edits have made of others."""
    from itertools import product

    names = ["".join(x) for n in range(6) for x in product("ab", repeat=n)] + ["gbecf", "hggb", "abcdefghij"]
    other = ["".join(x) for n in range(4) for x in product("bc", repeat=n)] + ["gedf", "zzggb", "acbcc", "axcxexgxij"]
    left, right = spark.createDataFrame([(x,) for x in names], "a string"), spark.createDataFrame([(x,) for x in other], "b string")
    score = F.round(1 - F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b"), F.lit(1)), 6)
    pairs = [tuple(r) for r in left.crossJoin(right).withColumn("score", score).collect()]
    assert ("gbecf", "gedf", 0.6) in pairs
    for least in (0.4, 0.5, 0.6, 0.666667, 0.8):
        assert sorted(map(tuple, evidence.similar_names(left, right, least).collect())) == sorted(p for p in pairs if p[2] >= least), least
