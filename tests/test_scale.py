"""What keeps queries in proportion to their input: passes over the facts, rows that travel, and batches in place of groups."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators import baselines, decisions, evidence, kpi, retrieval
from tidemark.sources import tables


def counted(monkeypatch, module, name):
    calls, real = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a: calls.append(a) or real(*a))
    return calls


def test_route_reads_sales_once(spark, sf, monkeypatch):
    calls = counted(monkeypatch, decisions, "sales")
    assert decisions.adaptation_route(spark, sf).count() and len(calls) == 1


def test_lines_are_joined_by_order_and_by_product_alone(spark, sf):
    def joins(node, above=0):
        above += node.nodeName() == "Join"
        children = [node.children().apply(k) for k in range(node.children().size())]
        if not children:
            return [above] if "l_orderkey" in node.toString() else []
        return [n for c in children for n in joins(c, above)]

    assert joins(tables.sales(spark, sf)._jdf.queryExecution().optimizedPlan()) == [2]


def test_sources_are_projected_from_one_pass(spark, sf, monkeypatch):
    sold, sent = counted(monkeypatch, kpi, "sales"), counted(monkeypatch, kpi, "fulfilment")
    assert kpi.project_sources(spark, sf).count() == 11 and len(sold) == len(sent) == 1


def test_products_are_smoothed_in_batches(spark, sf, monkeypatch):
    assert "InPandas" not in decisions.croston_tsb(spark, sf)._jdf.queryExecution().toString()
    monkeypatch.setattr(stats, "CELLS", 64)  # several products at once, and one alone
    rng = np.random.default_rng(3)
    months = [sorted(rng.choice(np.arange(-5, 40), rng.integers(1, 30), replace=False).tolist()) for _ in range(60)]
    units = [[float(x) for x in rng.integers(0, 90, len(m))] for m in months]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(months, pa.list_(pa.int32())), pa.array(units)], ["sku", "t", "units"])
    got = [r for b in stats.tsb_batches(iter([batch, batch.slice(7, 20), batch.slice(0, 0)])) for r in b.to_pylist()]
    want = [stats.tsb(pd.DataFrame({"sku": k, "t": m, "units": u})).iloc[0].to_dict() for k, (m, u) in enumerate(zip(months, units, strict=True))]
    assert got == want + want[7:27]


def test_forecasts_read_sales_twice(spark, sf, monkeypatch):
    calls = counted(monkeypatch, decisions, "sales"), counted(monkeypatch, baselines, "sales")
    rows = baselines.adapted_forecast(spark, sf).collect()
    assert sum(map(len, calls)) == 2  # routes and months
    smooth = {r["sku"]: round(r["forecast"], 4) for r in decisions.croston_tsb(spark, sf).collect()}
    sparse = [r for r in rows if r["operator"] == "croston_tsb"]
    assert all(abs(r["forecast"] - smooth[r["sku"]]) < 1e-9 for r in sparse)


def test_a_pair_of_blocks_is_held_at_a_time():
    """Forty pairs in one Arrow batch: what is held beside it is a pair's products, not forty blocks' as Python objects."""
    rng = np.random.default_rng(4)
    q, v = rng.normal(size=(50, 8)), np.round(rng.normal(size=(3000, 8)), 1)
    v[1500:] = v[:1500]  # ties
    row = {"qids": list(range(50)), "qm": q.tobytes(), "ids": rng.permutation(3000).tolist(), "m": v.tobytes(), "width": 8}
    batch = pa.RecordBatch.from_pylist([row] * 40, pa.schema([("qids", pa.list_(pa.int64())), ("qm", pa.binary()), ("ids", pa.list_(pa.int64())), ("m", pa.binary()), ("width", pa.int32())]))
    out = evidence._best(5)(iter([batch]))
    tracemalloc.start()
    got = next(out).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    sim, ids = np.round(q @ v.T, 6), np.array(row["ids"])
    want = [(a, int(ids[i])) for a in range(50) for i in sorted((i for i in range(3000) if ids[i] != a), key=lambda i: (-sim[a, i], ids[i]))[:5]]
    assert [(r["query_id"], r["vec_id"]) for r in got] == want and peak < 6 * sim.nbytes


def test_shingles_travel_as_hashes_and_lone_ones_stay(spark, monkeypatch):
    """Written sets are numbers, and of shingles that one document has none is ranked."""
    kept, real = {}, evidence.written
    monkeypatch.setattr(evidence, "written", lambda df, label: kept.update({label: real(df, label)}) or kept[label])
    texts = [" ".join(f"w{k}x{i}" for i in range(40)) for k in range(6)] + [" ".join(["same"] * 3 + [f"v{k}x{i}" for i in range(40)] + ["one", "two", "three", "four", "five", "six"]) for k in range(6)]
    texts += [texts[0] + " more", "a b c d e f g h", "a b c d e f g i"]
    got = {r["doc_id"]: r["class_id"] for r in evidence.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {k: 0 if k == 12 else k for k in range(15)}
    assert kept["shingles"].schema["s"].dataType.simpleString() == "array<bigint>"
    ranked = kept["shingles"]
    pairs = {(r["doc_id"], r["other"]) for r in evidence._by_rare_shingles(ranked, 0.6).collect()}
    assert pairs == {(12, 0), (14, 13)}


def test_index_is_ordered_within_files_alone(spark, monkeypatch):
    """No table of postings is exchanged by range, which would send each posting once more."""
    plans, real = {}, retrieval.written
    monkeypatch.setattr(retrieval, "written", lambda df, label: plans.update({label: df._jdf.queryExecution().toString()}) or real(df, label))
    retrieval.Index.build(spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string"))
    assert {"blocks", "forward"} <= set(plans) and not any("rangepartitioning" in p for p in plans.values())


def test_masks_look_for_what_a_match_needs_first(spark):
    """The same masks as the patterns alone, which are tried only where they can match."""
    said = ["a.b@c.de or 1.2.3.4", "+49 170 5557713, 1234 5678 9012 3456", "CUST-123 EMP#4567 Dr. Who Prof Ada Love, Mrs Ann", "Mr jones @ home. TKT12", "", None, "x@y.zz" * 3]
    df = spark.createDataFrame([(t,) for t in said], "text string")
    plain = F.col("text")
    for pattern, name in evidence._MASKS:
        plain = F.regexp_replace(plain, pattern, name)
    masked = df.select(evidence.pii_mask(F.col("text")).alias("got"), plain.alias("want"))
    assert all(r["got"] == r["want"] for r in masked.collect())
    assert "contains(" in df.select(evidence.pii_mask(F.col("text")))._jdf.queryExecution().toString().lower()
