"""Baselines against planted series, and launches against planted speeds."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import baselines as B


def fitted(spark, **series):
    rows = [(s, t, float(y), int(e)) for s, (ys, es) in series.items() for t, (y, e) in enumerate(zip(ys, es, strict=True))]
    return {r["series"]: r for r in B.fit_baselines(spark.createDataFrame(rows, "series string, t int, y double, event int")).collect()}


def test_periods_events_and_errors(spark):
    rng = np.random.default_rng(1)
    t = np.arange(364)
    event = (rng.uniform(size=364) < 0.1).astype(int)
    weekly = np.exp(5 + 0.3 * np.sin(2 * np.pi * t / 7) + 0.2 * event + 0.001 * t + rng.normal(0, 0.02, 364))
    got = fitted(spark, weekly=(weekly, event), flat=(10 + rng.normal(0, 1, 364), event * 0), zero=(np.maximum(0, rng.normal(0, 1, 364)), event * 0), short=([3, 4, 5], [0, 0, 0]))
    w = got["weekly"]
    assert list(w["periods"]) == [7] and w["logged"] and w["event_effect"] == pytest.approx(np.exp(0.2) - 1, rel=0.05)
    assert w["mape"] < 0.03 and w["mape"] < w["naive_mape"] and 0.6 <= w["coverage"] <= 1
    assert w["next"] == pytest.approx(np.exp(5 + 0.3 * np.sin(0) + 0.364), rel=0.05) and w["low"] < w["next"] < w["high"]
    assert list(got["flat"]["periods"]) == [] and got["flat"]["mape"] < 0.15 and abs(got["flat"]["event_effect"]) < 1e-6
    assert not got["zero"]["logged"]
    assert got["short"]["next"] == 4 and got["short"]["mape"] is None or np.isnan(got["short"]["mape"])


def test_anomalies_do_not_bend_the_fit():
    rng = np.random.default_rng(2)
    t = np.arange(300.0)
    y = 50 + 10 * (t / 300 - 0.5) + rng.normal(0, 1, 300)
    y[100:115] += 500
    x = B.design(t, 300, [], np.zeros(300))[:, :2]
    robust, scale = B.robust_fit(x, y)
    plain = np.linalg.lstsq(x, y, rcond=None)[0]
    assert robust == pytest.approx([50, 10], abs=0.8) and abs(plain[0] - 50) > 10 and scale == pytest.approx(1, rel=0.3)


def test_young_products_follow_the_pool_at_their_own_speed(spark):
    day = datetime.date(1995, 1, 1)
    at = lambda k: day + datetime.timedelta(days=k)
    curve = [10, 12, 14, 16, 18, 20, 20, 20, 20, 20, 20, 20]
    rows = [(s, at(s + 28 * j), 8 * u) for s in range(12) for j, u in enumerate(curve)]  # old ones
    rows += [(100, at(500 - 28 * 4 + 28 * j), 2 * 8 * u) for j, u in enumerate(curve[:5])]  # twice as fast, four whole periods
    rows += [(101, at(500 - 28 + 28 * j), 8 * u) for j, u in enumerate(curve[:2])]
    rows += [(102, at(490), 5)]  # no whole period yet
    got = {r["sku"]: r for r in B.pooled_launches(spark.createDataFrame(rows, "sku long, d date, units long")).collect()}
    assert set(got) == {100, 101} and got[100]["n"] == 4 and got[101]["n"] == 1
    speed = (4 * 2 + 2) / (4 + 2)
    assert got[100]["velocity"] == pytest.approx(speed, abs=1e-6) and got[100]["forecast"] == pytest.approx(8 * 18 * speed, abs=1e-3) and got[100]["actual"] == 2 * 8 * 18
    assert got[101]["velocity"] == 1 and got[101]["forecast"] == 8 * 12


def test_bands_narrow_with_history(spark):
    rng = np.random.default_rng(5)
    day = datetime.date(1995, 1, 1)
    rows = [(s, day + datetime.timedelta(days=s + 28 * j), int(rng.integers(50, 150))) for s in range(12) for j in range(12)]
    for sku, n in ((100, 1), (101, 9)):
        rows += [(sku, day + datetime.timedelta(days=500 - 28 * n + 28 * j), 100) for j in range(n + 1)]
    got = {r["sku"]: (r["high"] - r["low"]) / r["velocity"] for r in B.pooled_launches(spark.createDataFrame(rows, "sku long, d date, units long")).collect()}
    curve = spark.createDataFrame([r for r in rows if r[0] < 100], "sku long, d date, units long").withColumn("j", F.floor((F.datediff("d", F.lit(day)) - F.col("sku")) / 28)).groupBy("j").agg(F.expr("percentile(units, 0.9) - percentile(units, 0.1)").alias("w"))
    width = {r["j"]: r["w"] for r in curve.collect()}
    assert got[100] == pytest.approx(2 * width[1], rel=1e-3) and got[101] == pytest.approx((1 + 1 / 3) * width[9], rel=1e-3)


def test_every_product_is_forecast_by_its_route(spark, sf):
    from tidemark.operators.decisions import adaptation_route

    routes = {r["sku"]: r["operator"] for r in adaptation_route(spark, sf).collect()}
    rows = B.adapted_forecast(spark, sf).collect()
    assert {r["sku"]: r["operator"] for r in rows} == routes and len(rows) == len(routes)
    assert all(r["low"] <= r["forecast"] <= r["high"] for r in rows)
