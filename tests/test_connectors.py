"""Batches by contract: nothing is inferred, dropped or taken twice."""

import json

from pyspark.sql import functions as F

from tidemark.operators.ingestion import MANIFEST
from tidemark.sources.connectors import CORRUPT, PagesApi, SourceContract, append, drift, new_batches, on_landing, overwrite_partitions, read_batch, split_quarantine, stamp
from tidemark.streaming.arrivals import event_stream

FEED = SourceContract("martech", "sftp_drop", "iso_week string, campaign string, spend double", "csv", {"header": "true"}, {"spend": "spend between 0 and 1000", "campaign": "campaign is not null"})


def test_csv_keeps_lines_that_do_not_fit(spark, tmp_path):
    (tmp_path / "a.csv").write_text("iso_week,campaign,spend\n2026-W01,c1,10.5\n2026-W01,c2,oops\n2026-W02,,5000\n")
    df = read_batch(spark, FEED, str(tmp_path)).cache()
    assert df.count() == 3 and df.where(F.col(CORRUPT).isNotNull()).count() == 1
    good, bad = split_quarantine(df, FEED.rules)
    assert good.count() == 1
    assert {tuple(r["reasons"]) for r in bad.collect()} == {("spend",), ("spend", "campaign")}


def test_drift_names_both_sides(spark):
    df = spark.createDataFrame([("2026-W01", "c", 1.0)], "iso_week string, campaign_id string, spend double")
    assert drift(df, FEED, spark) == (["campaign"], ["campaign_id"])


def test_bronze_is_stamped_and_appended(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, x string")
    path = str(tmp_path / "bronze")
    append(stamp(df, "b1", "2026-01-05 04:00:00"), path, ("batch_id",))
    append(stamp(df, "b2", "2026-01-06 04:00:00"), path, ("batch_id",))
    out = spark.read.parquet(path)
    assert out.count() == 4 and out.select("row_hash").distinct().count() == 2 and {"received_at", "source_file", "schema_version"} <= set(out.columns)


def test_only_touched_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "gold")
    overwrite_partitions(spark.createDataFrame([(1, "w1"), (2, "w2")], "v long, week string"), path, ("week",))
    overwrite_partitions(spark.createDataFrame([(9, "w2")], "v long, week string"), path, ("week",))
    assert sorted((r["v"], r["week"]) for r in spark.read.parquet(path).collect()) == [(1, "w1"), (9, "w2")]


def test_known_batches_are_no_ops(spark, tmp_path):
    m = {"source_id": "oms", "batch_id": "b1", "covers": {"grain": "day", "periods": ["2026-01-05"]}, "supersedes": [], "row_count": 1, "schema_version": 1}
    for k, b in enumerate(("b1", "b2", "b2")):
        (tmp_path / f"{k}.json").write_text(json.dumps(m | {"batch_id": b}))
    landed = spark.read.schema(MANIFEST).option("multiLine", "true").json(str(tmp_path))
    registry = spark.createDataFrame([("oms", "b1")], "source_id string, batch_id string")
    assert [r["batch_id"] for r in new_batches(landed, registry).collect()] == ["b2"]


def test_api_pages_are_partitions(spark):
    spark.dataSource.register(PagesApi)
    df = read_batch(spark, SourceContract("prices", "api_pull", "id bigint, sku string, price double", options={"pages": "3", "page_size": "50"}))
    assert df.count() == 150 and df.rdd.getNumPartitions() == 3


def test_landing_wakes_only_dependent_measures(spark, sf, tmp_path):
    woken = []

    def handle(batch, epoch):
        edges = batch.sparkSession.createDataFrame([("net_revenue", "purchase"), ("errors", "error"), ("other", "nothing")], "kpi string, source string")
        woken.extend(r["kpi"] for r in edges.join(batch.select(F.col("event_type").alias("source")), "source", "left_semi").collect())

    on_landing(event_stream(spark, sf), str(tmp_path / "state"), handle).awaitTermination()
    assert sorted(woken) == ["errors", "net_revenue"]
    on_landing(event_stream(spark, sf), str(tmp_path / "state"), handle).awaitTermination()
    assert len(woken) == 2  # the same files again are no news


def test_a_run_is_on_record_stage_by_stage(spark, tmp_path):
    """Rows, time, bytes and cost of each stage; what fails is told, and what comes after it gets no rows."""
    from tidemark.operators.ingestion import run_stages

    def broken(df):
        raise ValueError("no")

    stages = [("load", lambda _: spark.range(1000)), ("halve", lambda df: df.where("id % 2 = 0")), ("publish", broken)]
    rows = run_stages(spark, stages, f"file://{tmp_path}/runs").orderBy("k").collect()
    assert [(r["stage"], r["rows_in"], r["rows_out"], r["status"]) for r in rows] == [("load", 1000, 1000, "ok"), ("halve", 1000, 500, "ok"), ("publish", 500, 0, "failed: ValueError")]
    assert all(r["ms"] > 0 and r["bytes"] > 0 and r["gb_seconds"] > 0 for r in rows[:2]) and rows[2]["bytes"] == 0
    assert run_stages(spark, stages[:1], f"file://{tmp_path}/runs").count() == 4  # appended
