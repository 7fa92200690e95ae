"""Tails against tables, folds against numpy, instruments and changepoints against planted truth."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import tails
from tidemark.operators import confidence, inference, series, shifts
from tidemark.operators.signals import SIGNALS


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    ("tail", "args", "want"),
    [
        # quantiles as statistical tables print them
        ("chi2_tail", (3.841459, 1), 0.05), ("chi2_tail", (18.307038, 10), 0.05), ("chi2_tail", (124.342113, 100), 0.05), ("chi2_tail", (2.705543, 1), 0.1), ("chi2_tail", (23.209251, 10), 0.01), ("chi2_tail", (0.0, 3), 1.0),
        ("t_two_sided", (2.228139, 10), 0.05), ("t_two_sided", (12.706205, 1), 0.05), ("t_two_sided", (-3.169273, 10), 0.01), ("t_two_sided", (1.983972, 100), 0.05), ("t_two_sided", (0.0, 7), 1.0),
        ("f_tail", (4.964603, 1, 10), 0.05), ("f_tail", (2.710890, 5, 20), 0.05), ("f_tail", (4.102685, 5, 20), 0.01),
    ],
)
def test_tails_equal_tables(spark, tail, args, want):
    assert value(spark, getattr(tails, tail)(*[F.lit(a) for a in args])) == pytest.approx(want, abs=1e-6)


def test_tails_over_many_arguments(spark):
    """Both branches against integrals by small steps, and even degrees of freedom against their closed form."""
    x = np.linspace(0.1, 60, 40)
    rows = spark.createDataFrame([(float(v), k) for v in x for k in (2, 4, 30)], "x double, k int").select("x", "k", tails.chi2_tail(F.col("x"), F.col("k")).alias("p")).collect()
    for r in rows:
        terms = np.cumprod(np.r_[1.0, r["x"] / 2 / np.arange(1, r["k"] // 2)])
        assert r["p"] == pytest.approx(np.exp(-r["x"] / 2) * terms.sum(), abs=1e-9)
    u = (np.arange(400000) + 0.5) / 400000
    for a, b, top in ((2.5, 1.5, 0.2), (2.5, 1.5, 0.9), (10.0, 30.0, 0.3), (0.5, 4.0, 0.01)):
        area = np.mean((top * u) ** (a - 1) * (1 - top * u) ** (b - 1)) * top / np.mean(u ** (a - 1) * (1 - u) ** (b - 1))
        assert value(spark, tails.beta_share(F.lit(a), F.lit(b), F.lit(top))) == pytest.approx(area, rel=3e-3)


def test_folds_never_see_their_test(spark):
    """A line is foretold exactly; a jump in the last weeks hurts only the fold that tests them."""
    y = [100.0 + 2 * t for t in range(120)]
    jump = y[:-5] + [v + 1000 for v in y[-5:]]
    df = spark.createDataFrame([(s, t, v) for s, ys in (("line", y), ("jump", jump)) for t, v in enumerate(ys)], "series string, t int, y double")
    got = {(r["series"], r["fold"]): r for r in inference.rolling_origin(df).collect()}
    assert all(got["line", k]["trend_mape"] == 0 for k in range(1, 5)) and [got["line", k]["n"] for k in range(1, 5)] == [107, 94, 81, 68]
    assert got["jump", 1]["trend_mape"] > 0.2 and all(got["jump", k]["trend_mape"] == 0 for k in (2, 3, 4))
    want = np.mean([abs(y[t] - y[t - 52]) / y[t] for t in range(107, 120)])
    assert got["line", 1]["naive_mape"] == pytest.approx(want, abs=1e-6)


def test_instrument_frees_the_slope_of_demand(spark):
    """Demand shocks raise prices too, and dear products sell more: only the instrument finds the true slope of -1.5."""
    rng = np.random.default_rng(4)
    rows = []
    for sku in range(150):
        quality = rng.normal()
        for q in range(20):
            cost, shock = rng.normal(0, 0.2), rng.normal(0, 0.3)
            lp = quality + cost + 0.6 * shock
            rows.append((sku, float(-1.5 * lp + 2 * quality + shock), float(lp), float(cost + rng.normal(0, 0.1))))
    r = inference.elasticities(spark.createDataFrame(rows, "sku int, lu double, lp double, z double")).first()
    assert r["instrumented"] == pytest.approx(-1.5, abs=0.1)
    assert r["naive"] > 0 and r["within"] > -1.2 and r["first_stage_f"] > 100 and r["p_instrument"] < 1e-6


@pytest.mark.parametrize("seed", range(6))
def test_pruning_changes_nothing(seed):
    rng = np.random.default_rng(seed)
    y = rng.normal(size=300) + np.repeat(rng.normal(scale=2, size=10), 30)
    p = shifts.penalty(y)
    assert shifts.pelt(y, p) == shifts.pelt(y, p, prune=False)


def test_changepoints_find_planted_dates(spark):
    rng = np.random.default_rng(12)
    level = {"two": [5, 9, 3], "none": [4], "late": [2, 6]}
    cut = {"two": [40, 95, 150], "none": [150], "late": [140, 150]}
    rows = []
    for s in level:
        begin = 0
        for mean, end in zip(level[s], cut[s], strict=True):
            rows += [(s, t, float(mean + rng.normal(0, 0.5))) for t in range(begin, end)]
            begin = end
    df = spark.createDataFrame(rows, "series string, t int, y double")
    got = {}
    for r in shifts.changepoints(df).collect():
        got.setdefault(r["series"], []).append((r["t"], round(r["before"]), round(r["after"]), r["weeks"]))
    assert got == {"two": [(40, 5, 9, 55), (95, 9, 3, 55)], "late": [(140, 2, 6, 10)]}
    alarms = [r for r in shifts.confirmed(df).collect() if r["shift"] is not None]
    assert {("two", "down", 95)} <= {(r["series"], r["direction"], r["shift"]) for r in alarms}
    short = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 9.0), ("b", 0, 3.0)], "series string, t int, y double")
    assert shifts.changepoints(short).count() == 0


@pytest.mark.parametrize("decay", [0.5, 0.97, 0.999])
def test_decayed_sums_lose_nothing_for_slow_decays(spark, decay):
    n = 3000
    out = series.decayed_sum(spark.range(n).select(F.lit("a").alias("series"), F.col("id").cast("int").alias("t"), F.lit(1.0).alias("x")), "x", decay, "s")
    for t in (0, 127, 128, 1500, n - 1):
        assert out.where(F.col("t") == t).first()["s"] == pytest.approx((1 - decay ** (t + 1)) / (1 - decay), rel=1e-9)
    with pytest.raises(ValueError):
        series.decayed_sum(out, "x", 1.0, "s2")


def movements(spark, n, months, informative=True):
    rng = np.random.default_rng(2)
    rows = []
    for m in range(months):
        for r in range(n):
            x = rng.uniform(size=6)
            held = (x[2] + rng.normal(0, 0.1) > 0.5) if informative else rng.uniform() > 0.5
            rows.append((f"r{r}", f"{2000 + m // 12}-{m % 12 + 1:02d}-01", *map(float, x), float(held)))
    return spark.createDataFrame(rows, "region string, month string, " + ", ".join(f"{c} double" for c in SIGNALS) + ", label double").withColumn("month", F.to_date("month"))


def test_ranker_is_trained_on_earlier_months_alone(spark):
    s = movements(spark, 10, 30)
    out = confidence.ranked(s, F.lit("2002-01-01").cast("date"))
    assert {r["ranked_by"] for r in out.collect()} == {"model"} and out.agg(F.min("month")).first()[0].year == 2002
    assert confidence.rank_quality(out, "rank_score").first()["auc"] > 0.85
    # outcomes from today on make no difference
    spoilt = s.withColumn("label", F.when(F.col("month") >= "2001-12-01", 1 - F.col("label")).otherwise(F.col("label")))
    again = confidence.ranked(spoilt, F.lit("2002-01-01").cast("date"))
    pick = lambda df: sorted((r["region"], r["month"], r["rank_score"]) for r in df.collect())
    assert pick(out) == pick(again)


def test_ranker_falls_back(spark):
    s = movements(spark, 4, 36)
    few = confidence.ranked(s, F.lit("2001-01-01").cast("date"))  # 44 labels
    assert {r["ranked_by"] for r in few.collect()} == {"order"} and few.count() == 96
    stale = confidence.ranked(s.withColumn("label", F.when(F.col("month") < "2002-07-01", F.col("label"))), F.lit("2006-01-01").cast("date"))
    assert stale.columns == ["region", "month", "label", "rank_score", "ranked_by"]
    old = confidence.ranked(s.withColumn("month", F.when(F.col("month") >= "2002-10-01", F.add_months("month", 60)).otherwise(F.col("month"))).withColumn("label", F.when(F.col("month") < "2003-01-01", F.col("label"))), F.lit("2007-01-01").cast("date"))
    assert {r["ranked_by"] for r in old.collect()} == {"order"}
    one_kind = confidence.ranked(movements(spark, 10, 30).withColumn("label", F.lit(1.0)), F.lit("2002-01-01").cast("date"))
    assert {r["ranked_by"] for r in one_kind.collect()} == {"order"}


def test_rank_quality_is_the_share_of_pairs(spark):
    rng = np.random.default_rng(3)
    x, y = np.round(rng.uniform(size=200), 1), rng.integers(0, 2, 200)
    want = np.mean([(a > b) + 0.5 * (a == b) for a in x[y == 1] for b in x[y == 0]])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "s double, label double")
    assert confidence.rank_quality(df, "s").first()["auc"] == pytest.approx(want, abs=1e-6)
