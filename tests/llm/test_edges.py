"""Each operator over nulls, empty and very long texts, ties, repeated rows, clashing columns and empty tables."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm import brute

random.seed(11)
LONG = " ".join(random.choice("alpha beta gamma delta epsilon zeta eta theta iota".split()) + str(random.randint(0, 99)) for _ in range(30000))
PROSE = [" ".join(random.choice("the of and to in that was by with from this are".split()) + random.choice(["", "ly", "ing", "er", "s"]) for _ in range(120)) for _ in range(12)]
TEXTS = [None, "", " \t\n", "x", LONG, LONG, "a " * 50, "no words? é ñ", PROSE[0], PROSE[0] + " once more", PROSE[1].replace(" ", "  ", 3), *PROSE, "1" * 3000, "a." * 3000 + "@x.y", "Released under the MIT License.", "mail a@b.co or call +1 (017) 555-7713"]
ROWS = [(i, t, (None, "en", "de")[i % 3], (None, "s1", "s2", "s10")[i % 4], -1, "k", True) for i, t in enumerate(TEXTS)]
ROWS += [(None, "hello null id", "en", "s1", 0, "k", False), (3, "x", "en", "s1", 0, "k", False), (3, "x", "en", "s1", 0, "k", False), (None, None, None, None, None, None, None)]
SCHEMA = "doc_id long, text string, lang string, source string, size int, shard string, kept boolean"
#: Names that operators compute themselves, as columns of the input.
CLASHING = ["n_words", "m", "pii", "__key", "slot", "taken", "target", "class_id", "t1", "entries", "at", "score", "hits", "items", "rank"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("mine") for c in CLASHING})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def keys(rows):
    return sorted(((r["doc_id"], r["text"]) for r in rows), key=str)


def own_columns(before, after):
    assert after.columns == before.columns
    assert all(r["m"] == "mine" and r["entries"] == "mine" for r in after.select("m", "entries").collect())


def test_quality(docs, empty):
    from tidemark.llm.quality import quality_filter, with_measures

    kept = quality_filter(docs)
    own_columns(docs, kept)
    assert quality_filter(empty).count() == 0
    for r in with_measures(docs).collect():
        w = brute.WORD.findall(r["__row"]["text"] or "")
        assert r["m"]["n_words"] == len(w) and r["m"]["word_chars"] == sum(map(len, w))
    assert all(len(brute.WORD.findall(r["text"] or "")) >= 20 for r in kept.collect())


def test_toxicity(spark, docs, empty):
    from tidemark.llm.toxicity import fit, score

    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(len(TEXTS))] + [(None, 1), (1, None)], "doc_id long, toxic int")
    model = fit(docs, labels)
    rows = score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert score(empty, model).count() == 0
    assert {r["score"] for r in score(docs, fit(docs, labels.where("toxic = 0"))).collect()} == {0.0}


def test_licenses(docs, empty):
    from tidemark.llm.licenses import with_licenses

    out = with_licenses(docs)
    assert out.count() == docs.count() and out.columns == [*docs.columns, "license_matches"]
    assert [r["license_matches"][0]["license"] for r in out.collect() if r["license_matches"]] == ["mit"]
    assert with_licenses(empty).count() == 0


def test_pii(docs, empty):
    from tidemark.llm.pii import redact, with_spans

    for r in with_spans(docs).collect():
        want = brute.pii(r["text"])
        assert {k: sum(s["kind"] == k[2:] for s in r["pii"]) for k in want if k[:2] == "n_"} == {k: v for k, v in want.items() if k[:2] == "n_"}
    own_columns(docs, redact(docs))
    assert {r["text"] for r in redact(docs).where("text like 'mail%'").collect()} == {"mail <email> or call <phone>"}
    assert with_spans(empty).count() == 0


def test_sharding(docs, empty):
    from tidemark.llm.sharding import histogram_sort

    rows = histogram_sort(docs, shards=5).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows if r["doc_id"] is not None) == sorted((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in ROWS if d is not None)
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert len(rows) == len(ROWS) and all(0 <= r["shard"] < 5 for r in rows)
    assert histogram_sort(empty).count() == 0


def test_substrings(spark, docs, empty):
    from tidemark.llm.substrings import remove_repeats

    rows = remove_repeats(docs).collect()
    assert len(rows) == len(ROWS)
    want = brute.substring_dedup([(d, t) for d, t, *_ in ROWS if d is not None])
    for r in rows:
        if r["doc_id"] is not None:
            assert want[r["doc_id"]] == (r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest())
    assert remove_repeats(empty).count() == 0


def test_near_copies(docs, empty):
    from tidemark.llm.nearcopies import drop_near_copies, near_copies

    found = near_copies(docs).collect()
    assert len(found) == len(ROWS)
    group = {}
    for r in found:
        group.setdefault(r["class_id"], []).append(r)
    assert {r["doc_id"] for r in group[4]} == {4, 5}
    assert {8, 9, 11} <= {r["doc_id"] for r in group[8]}
    assert all(len(v) == v[0]["class_size"] for k, v in group.items() if k is not None)
    kept = drop_near_copies(docs)
    own_columns(docs, kept)
    assert sum(r["text"] == "x" for r in kept.collect()) == 1
    assert drop_near_copies(empty).count() == 0


def test_mixing(docs, empty):
    from tidemark.llm.mixing import mix, sample_mix

    rows = mix(docs).collect()
    assert len(rows) == len(ROWS)
    for s in {r["source"] for r in rows}:
        of = [r for r in rows if r["source"] == s]
        assert sum(r["size"] for r in of) == of[0]["source_size"]
        assert sum(r["taken"] for r in of) <= of[0]["target"] + 1 and all(r["taken"] <= 2 * r["size"] for r in of)
        assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in of)
    assert sum({r["source"]: r["target"] for r in rows}.values()) == pytest.approx(1.5 * sum(r["size"] for r in rows))
    again = sorted((str(r["doc_id"]), str(r["text"])[:20], r["taken"]) for r in mix(docs.repartition(5)).collect())
    assert again == sorted((str(r["doc_id"]), str(r["text"])[:20], r["taken"]) for r in rows)
    own_columns(docs, sample_mix(docs))
    assert mix(empty).count() == 0 and sample_mix(empty).count() == 0


def test_byte_spans(docs, empty):
    from tidemark.llm.bytespans import remove_repeated_bytes

    short = docs.where(F.length("text") < 20000)
    rows = remove_repeated_bytes(short).withColumn("kept", F.sha2("kept", 256)).collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, brute.suffix_dedup([(d, t) for d, t, *_ in ROWS if t is not None and len(t) < 20000])))
    both = remove_repeated_bytes(docs.where("doc_id in (4, 5)")).collect()
    assert all(r["n_removed"] == r["n_bytes"] and r["n_spans"] == 1 for r in both)
    assert remove_repeated_bytes(empty).count() == 0


def test_decontamination(spark, docs, empty):
    from tidemark.llm.decontamination import clean_documents, decontaminate

    items = [(1, " ".join(PROSE[2].split()[30:55])), (2, "x"), (3, None), (4, ""), (5, " ".join(PROSE[2].split()[30:55]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.decontamination([(k, t) for k, (_, t, *_) in enumerate(ROWS)], items)
    rows = decontaminate(docs.select("doc_id", "text"), bench).collect()
    got = sorted((r["n_words"], r["n_hit"], len(r["items"])) for r in rows)
    assert got == sorted(v[:3] for v in want.values())
    clean = clean_documents(docs, bench)
    own_columns(docs, clean)
    assert clean.count() == sum(not v[4] for v in want.values())
    assert clean_documents(docs, bench.where("false")).count() == len(ROWS)
    assert clean_documents(empty, bench).count() == 0


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stages(spark, sf, docs, empty, stage):
    """Each stage alone: columns of all but the last stay, and an empty table is no failure."""
    import corpus_pipeline as cp

    out = cp.STAGES[stage][1](spark, docs, sf)
    assert out.columns[: len(docs.columns)] == docs.columns
    if stage < 4:
        own_columns(docs, out)
        assert {str(r["text"]) for r in out.select("text").collect()} <= {str(t) for _, t, *_ in ROWS}
    else:
        assert out.count() == len(ROWS) and {"text_crc32"} <= set(out.columns)
    assert cp.STAGES[stage][1](spark, empty, sf).count() == 0
