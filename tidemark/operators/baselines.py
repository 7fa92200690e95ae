"""Baselines of the business's own series: robust regressions with discovered periods, pooled launches, and who gets which.

A baseline is fitted by series, in Arrow groups: in logs where all values are positive, with a trend, harmonics of the
periods that the series shows, and event terms; Huber's weights keep anomalies from bending it. Its last points are kept
out of the fit and say how good it is, beside the value one period before. Young products borrow the curve of the last
launches, at their own speed, in a band that is wider the fewer periods they have.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.stats import discover_periods
from tidemark.operators.decisions import adaptation_route, smoothed
from tidemark.registry import query
from tidemark.session import written
from tidemark.sources.tables import FACTS, sales

#: Points that are kept out, harmonics of a period, Huber's constant, and half of an 80 % band in standard deviations.
HELD, HARMONICS, HUBER, BAND = 28, 3, 1.345, 1.2816
FITTED = "series string, n int, logged boolean, periods array<int>, event_effect double, mape double, naive_mape double, coverage double, next double, low double, high double"


def design(t: np.ndarray, n: int, periods: list[int], event: np.ndarray) -> np.ndarray:
    """Level, trend, event and harmonics at the points t of a series of n points."""
    columns = [np.ones(len(t)), t / max(n, 1) - 0.5, event]
    for p in periods:
        for k in range(1, min(HARMONICS, p // 2) + 1):
            columns += [np.sin(2 * np.pi * k * t / p), np.cos(2 * np.pi * k * t / p)]
    return np.column_stack(columns)


def robust_fit(x: np.ndarray, y: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Coefficients by reweighted least squares with Huber's weights, and the scale of what is left."""
    weights = np.ones(len(y))
    beta, scale = np.zeros(x.shape[1]), 0.0
    for _ in range(rounds):
        root = np.sqrt(weights)
        new = np.linalg.lstsq(x * root[:, None], y * root, rcond=None)[0]
        left = y - x @ new
        scale = 1.4826 * float(np.median(np.abs(left - np.median(left))))
        done = np.allclose(new, beta, rtol=1e-8, atol=1e-10)
        beta = new
        if done or scale <= 1e-12:
            break
        weights = np.minimum(1.0, HUBER * scale / np.maximum(np.abs(left), 1e-300))
    return beta, scale


def _fitted(held: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values("t")
        y, event = f["y"].to_numpy(float), f["event"].to_numpy(float)
        n, kept = len(y), max(0, len(y) - held)
        row = {"series": f["series"].iloc[0], "n": n, "logged": bool((y > 0).all())}
        if kept < 8:  # too short to be judged: its median, and no error
            return pd.DataFrame([row | {"periods": [], "event_effect": 0.0, "mape": np.nan, "naive_mape": np.nan, "coverage": np.nan, "next": float(np.median(y)), "low": float(y.min()), "high": float(y.max())}])
        z = np.log(y) if row["logged"] else y
        back = np.exp if row["logged"] else (lambda v: v)
        t = np.arange(n, dtype=float)
        periods = discover_periods(z[:kept])
        x = design(t, n, periods, event)
        beta, scale = robust_fit(x[:kept], z[:kept])
        said = x[kept:] @ beta
        low, high = back(said - BAND * scale), back(said + BAND * scale)
        real = y[kept:]
        step = periods[-1] if periods else 1
        naive = np.array([y[kept - step + k % step] for k in range(held)])
        there = real != 0
        error = lambda v: round(float(np.mean(np.abs(v - real)[there] / np.abs(real[there]))), 6) if there.any() else np.nan
        whole, spread = robust_fit(x, z)
        ahead = float(design(np.array([float(n)]), n, periods, np.zeros(1)) @ whole)
        effect = float(np.exp(whole[2]) - 1) if row["logged"] else float(whole[2])
        return pd.DataFrame([row | {
            "periods": periods, "event_effect": round(effect, 6), "mape": error(back(said)), "naive_mape": error(naive), "coverage": round(float(np.mean((real >= low) & (real <= high))), 6),
            "next": float(back(ahead)), "low": float(back(ahead - BAND * spread)), "high": float(back(ahead + BAND * spread)),
        }])

    return run


def fit_baselines(series: DataFrame, held: int = HELD) -> DataFrame:
    """A row a series: periods, effect of the event, errors over the last ``held`` points and the forecast of the next.

    series: series, t (without gaps), y, event (0 or 1).
    """
    return series.groupBy("series").applyInPandas(_fitted(held), FITTED)


def daily_by_region(spark: SparkSession, sf: str) -> DataFrame:
    """series (region), t, y: net revenue of every day, none left out; event: a day whose discounts are in the region's top tenth."""
    s = sales(spark, sf).groupBy(F.col("region").alias("series"), "d").agg((F.sum("net_e4") / 10000.0).alias("y"), F.avg("discount_e4").alias("discount"))
    s = written(s, "days")
    first = s.agg(F.min("d").alias("first"), F.max("d").alias("last"))  # one row
    days = first.select(F.explode(F.sequence("first", "last")).alias("d")).crossJoin(s.select("series").distinct())  # a few regions
    top = s.groupBy("series").agg(F.expr("percentile(discount, 0.9)").alias("top"))
    full = days.join(s, ["series", "d"], "left").join(top, "series").crossJoin(first)
    return full.select("series", F.datediff("d", "first").alias("t"), F.coalesce("y", F.lit(0.0)).alias("y"), F.coalesce(F.col("discount") > F.col("top"), F.lit(False)).cast("int").alias("event"))


@query("sales_baselines")
def sales_baselines(spark: SparkSession, sf: str) -> DataFrame:
    """Baselines of daily revenue by region, with their error over the last four weeks."""
    f = fit_baselines(daily_by_region(spark, sf))
    return f.select("series", "n", "logged", F.concat_ws(",", F.transform("periods", lambda p: p.cast("string"))).alias("periods"), "event_effect", "mape", "naive_mape", "coverage")


#: Days from the first sale of all at which launches are judged, days of a period, periods of a curve, launches of a pool,
#: and periods that a pool's own speed counts for.
ASOF, PERIOD, CURVE, POOL, PRIOR = 500, 28, 12, 12, 2.0


def pooled_launches(s: DataFrame, asof: int = ASOF) -> DataFrame:
    """sku, n, velocity, forecast, low, high, actual of each product in its first year at that day: units of its next period.

    The pool are the last POOL launches that have a whole curve by then. n are the whole periods a product has; its velocity
    is its units against the pool's median over them, drawn towards 1 by PRIOR periods. s: sku, d, units.
    """
    units = written(s.groupBy("sku", "d").agg(F.sum("units").alias("u")), "sku-days")
    start = units.agg(F.date_add(F.min("d"), asof).alias("asof"))  # one row
    first = units.groupBy("sku").agg(F.min("d").alias("f")).crossJoin(start).withColumn("age", F.floor(F.datediff("asof", "f") / PERIOD).cast("int")).where("age >= 1")
    first = written(first.select("sku", "f", "age"), "launches")
    pool = first.where(F.col("age") >= CURVE).orderBy(F.desc("f"), "sku").limit(POOL)
    period = F.floor(F.datediff("d", "f") / PERIOD).cast("int")
    by_period = units.join(first, "sku").groupBy("sku", period.alias("j")).agg(F.sum("u").alias("u"))
    by_period = written(by_period.where(F.col("j") < CURVE), "periods")
    grid = lambda p, upto: p.withColumn("j", F.explode(F.sequence(F.lit(0), upto))).join(by_period, ["sku", "j"], "left").fillna(0, ["u"])
    q = lambda x: F.expr(f"percentile(u, {x})")
    curve = written(grid(pool, F.lit(CURVE - 1)).groupBy("j").agg(q(0.5).alias("mid"), q(0.1).alias("p10"), q(0.9).alias("p90")), "curve")
    young = grid(first.where(F.col("age") < CURVE), F.col("age")).join(curve, "j")
    seen, now = F.col("j") < F.col("age"), F.col("j") == F.col("age")
    at = lambda c: F.max(F.when(now, F.col(c)))
    y = young.groupBy("sku", "age").agg(F.sum(F.when(seen, F.col("u"))).alias("own"), F.sum(F.when(seen, F.col("mid"))).alias("pooled"), *[at(c).alias(c) for c in ("mid", "p10", "p90")], at("u").alias("actual"))
    raw = F.coalesce(F.col("own") / F.nullif("pooled", F.lit(0.0)), F.lit(1.0))
    y = y.withColumn("velocity", (F.col("age") * raw + PRIOR) / (F.col("age") + PRIOR)).withColumn("wide", F.col("velocity") * (1 + 1 / F.sqrt("age")))
    mid = F.col("mid") * F.col("velocity")
    low, high = F.greatest(F.lit(0.0), mid - (F.col("mid") - F.col("p10")) * F.col("wide")), mid + (F.col("p90") - F.col("mid")) * F.col("wide")
    return y.select("sku", F.col("age").alias("n"), F.round("velocity", 6).alias("velocity"), F.round(mid, 4).alias("forecast"), F.round(low, 4).alias("low"), F.round(high, 4).alias("high"), "actual")


@query(
    "pooled_launch",
    f"""{FACTS}, u as materialized (select sku, d, sum(units)::bigint as u from sales group by all), a as (select min(d) + {ASOF} as judged from u),
  f as materialized (select * from (select sku, f, (date_diff('day', f, judged) // {PERIOD})::int as age from (select sku, min(d) as f from u group by sku), a where f <= judged) where age >= 1),
  p as (select sku from f where age >= {CURVE} order by f desc, sku limit {POOL}),
  b as materialized (select u.sku, (date_diff('day', f, d) // {PERIOD})::int as j, sum(u)::bigint as u from u join f using (sku) group by all),
  c as (select g.j, median(coalesce(b.u, 0)) as mid, quantile_cont(coalesce(b.u, 0), 0.1) as p10, quantile_cont(coalesce(b.u, 0), 0.9) as p90 from (select sku, unnest(range(0, {CURVE}))::int as j from p) g left join b on b.sku = g.sku and b.j = g.j group by g.j),
  y as (select g.sku, g.age, sum(case when g.j < age then coalesce(b.u, 0) end)::bigint as own, sum(case when g.j < age then mid end) as pooled, max(case when g.j = age then mid end) as mid, max(case when g.j = age then p10 end) as p10, max(case when g.j = age then p90 end) as p90, max(case when g.j = age then coalesce(b.u, 0) end) as actual
    from (select sku, age, unnest(range(0, age + 1))::int as j from f where age < {CURVE}) g join c on c.j = g.j left join b on b.sku = g.sku and b.j = g.j group by all),
  v as (select *, (age * coalesce(own / nullif(pooled, 0), 1) + {PRIOR}) / (age + {PRIOR}) as velocity from y)
  select sku, age as n, round(velocity, 6) as velocity, round(mid * velocity, 4) as forecast, round(greatest(0.0, mid * velocity - (mid - p10) * velocity * (1 + 1 / sqrt(age))), 4) as low, round(mid * velocity + (p90 - mid) * velocity * (1 + 1 / sqrt(age)), 4) as high, actual from v""",
)
def pooled_launch(spark: SparkSession, sf: str) -> DataFrame:
    """What products in their first year will sell next, by the curve of the last launches."""
    return pooled_launches(sales(spark, sf).select("sku", "d", "units"))


@query("adapted_forecast")
def adapted_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """Units of every product's next month, each by the operator that its data can bear: sku, operator, forecast, low, high.

    Months without sales are only filled in for products whose series is fitted; sums over all months need none.
    """
    route = written(adaptation_route(spark, sf), "routes")
    month = F.months_between(F.trunc("d", "month"), F.lit("1995-01-01").cast("date")).cast("int")
    m = written(sales(spark, sf).groupBy("sku", month.alias("t")).agg(F.coalesce(F.sum("units"), F.lit(0)).alias("u")), "months")
    ends = m.agg(F.min("t").alias("first"), F.max("t").alias("last"))  # one row
    routed = m.join(route, "sku")
    exact = F.col("u").cast("decimal(18,0)")
    sums = routed.groupBy("sku", "operator").agg(F.sum("u").alias("s"), F.sum(exact * exact).alias("q"), F.count_if(F.col("u") > 0).alias("n"), F.sum(F.when(F.col("u") > 0, F.col("u"))).alias("sold"))
    sums = written(sums.crossJoin(ends.select((F.col("last") - F.col("first") + 1).alias("months"))).withColumn("mean", F.col("s") / F.col("months")), "product-sums")
    of = lambda *names: sums.where(F.col("operator").isin(*names))
    bands = lambda df, mid, sd: df.select("sku", "operator", F.round(mid, 4).alias("forecast"), F.round(F.greatest(F.lit(0.0), mid - BAND * sd), 4).alias("low"), F.round(mid + BAND * sd, 4).alias("high"))
    sparse = smoothed(routed.where("operator = 'croston_tsb'").select("sku", "t", F.col("u").alias("units"))).withColumn("operator", F.lit("croston_tsb"))
    # the variance of whole numbers, from their exact sums
    spread = (F.col("months") * F.col("q") - F.col("s").cast("decimal(18,0)") * F.col("s").cast("decimal(18,0)")).cast("double") / F.nullif(F.col("months") * (F.col("months") - 1), F.lit(0)).cast("double")
    counts = of("poisson_bands").select("sku", "operator", F.col("mean").alias("mid"), spread.alias("v"))
    # all products are the pool; a product's own speed is its mean against theirs
    pool = sums.agg(F.expr("percentile(mean, 0.5)").alias("mid"), F.expr("percentile(mean, 0.1)").alias("p10"), F.expr("percentile(mean, 0.9)").alias("p90"))
    own = of("pooled_launch").where("n > 0").select("sku", "operator", "n", (F.col("sold") / F.col("n")).alias("mean")).crossJoin(pool)
    speed = (F.col("n") * F.col("mean") / F.nullif("mid", F.lit(0.0)) + PRIOR) / (F.col("n") + PRIOR)
    own = own.withColumn("v", speed).withColumn("wide", F.col("v") * (1 + 1 / F.sqrt("n")))
    mid = F.col("mid") * F.col("v")
    young = own.select("sku", "operator", F.round(mid, 4).alias("forecast"), F.round(F.greatest(F.lit(0.0), mid - (F.col("mid") - F.col("p10")) * F.col("wide")), 4).alias("low"), F.round(mid + (F.col("p90") - F.col("mid")) * F.col("wide"), 4).alias("high"))
    rich = of("mstl", "correlated_kpis").select("sku").crossJoin(ends).select("sku", F.explode(F.sequence("first", "last")).alias("t")).join(m, ["sku", "t"], "left").fillna(0, ["u"])
    fitted = fit_baselines(rich.select(F.col("sku").cast("string").alias("series"), "t", F.col("u").cast("double").alias("y"), F.lit(0).alias("event")), 6)
    fitted = fitted.join(route.withColumn("series", F.col("sku").cast("string")), "series")
    by_fit = fitted.select("sku", "operator", *[F.round(F.greatest(F.lit(0.0), F.col(c)), 4).alias(n) for c, n in (("next", "forecast"), ("low", "low"), ("high", "high"))])
    return bands(sparse, F.col("forecast"), F.sqrt("forecast")).union(bands(counts, F.col("mid"), F.sqrt(F.greatest("v", "mid")))).union(young).union(by_fit)
