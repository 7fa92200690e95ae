"""Drivers with lags and mediators, as a contract's graph says: which lag, which controls, and how much.

The graph is a table of edges from drivers to measures, each with the lags that the contract allows. What can be reached
from what is a recursive query. A driver's whole effect is estimated beside the other drivers of the measure but those
that it acts through (mediators, which stand on a path from it to the measure), as holding these would hide a part of it.
A lag is chosen inside its window by the correlation of changes, all series, drivers and lags in one job; then each series
is one regression by driver, with errors that allow for correlation (Newey and West).
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.registry import query
from tidemark.session import written
from tidemark.sources.tables import FACTS, sales

EDGES = "target string, driver string, lag_lo int, lag_hi int"
#: The contract of units sold: discounts act on units, and through the price on them; the breadth of the range acts on both.
UNITS = [("units", "price", 0, 2), ("units", "discount", 0, 4), ("units", "breadth", 0, 4), ("price", "discount", 0, 0)]
#: Pairs of changes that a correlation needs.
PAIRS = 12
_MONDAY = "1995-01-02"


def reachable(edges: DataFrame) -> DataFrame:
    """source, target: every measure that a driver acts on, directly or through others; a graph with a cycle ends too.

    edges: target, driver. One recursive query; the distance is bounded by the number of measures.
    """
    spark, name = edges.sparkSession, f"edges_{uuid.uuid4().hex}"
    edges.createOrReplaceTempView(name)
    most = edges.select("target").union(edges.select("driver")).distinct().count()
    return spark.sql(
        f"""with recursive r(source, target, steps) as (
          select driver, target, 1 from {name} union all select r.source, e.target, r.steps + 1 from r join {name} e on e.driver = r.target where r.steps < {most}
        ) select distinct source, target from r"""
    )


def controls(edges: DataFrame, target: str) -> DataFrame:
    """driver, other: for each driver of ``target`` the other drivers that are held beside it, mediators left out."""
    own = edges.where(F.col("target") == target).select("driver")
    pairs = own.join(own.select(F.col("driver").alias("other")), F.col("driver") != F.col("other"))
    through = reachable(edges).select(F.col("source").alias("driver"), F.col("target").alias("other"))
    return pairs.join(through, ["driver", "other"], "left_anti")


def choose_lags(panel: DataFrame, edges: DataFrame, target: str) -> DataFrame:
    """series, driver, lag, r: for each driver of ``target`` the lag in its window whose change goes most with the target's.

    Changes are from one point to the next; a lag counts with PAIRS pairs of them or more. panel: series, t, measure, y.
    """
    own = Window.partitionBy("series", "measure").orderBy("t")
    follows = F.lag("t").over(own) == F.col("t") - 1
    change = panel.withColumn("dy", F.when(follows, F.col("y") - F.lag("y").over(own))).where("dy is not null").select("series", "t", "measure", "dy")
    windows = edges.where(F.col("target") == target).select("driver", F.explode(F.sequence("lag_lo", "lag_hi")).alias("lag"))
    moved = change.join(windows, F.col("measure") == F.col("driver")).select("series", "driver", "lag", (F.col("t") + F.col("lag")).alias("t"), F.col("dy").alias("dx"))
    met = moved.join(change.where(F.col("measure") == target).select("series", "t", "dy"), ["series", "t"])
    r = met.groupBy("series", "driver", "lag").agg(F.round(F.corr("dx", "dy"), 6).alias("r"), F.count(F.lit(1)).alias("n")).where((F.col("n") >= PAIRS) & ~F.isnan("r") & F.col("r").isNotNull())
    best = F.row_number().over(Window.partitionBy("series", "driver").orderBy(F.desc(F.abs("r")), "lag"))
    return r.withColumn("best", best).where("best = 1").select("series", "driver", "lag", "r")


def _estimate(beside: dict[str, list[str]]):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values("t")
        y, rows = f["y"].to_numpy(float), []
        for driver, others in sorted(beside.items()):
            x = np.column_stack([np.ones(len(f)), f["t"].to_numpy(float) / len(f), *(f[c].to_numpy(float) for c in (driver, *others))])
            inv = np.linalg.pinv(x.T @ x)
            beta = inv @ x.T @ y
            xu = x * (y - x @ beta)[:, None]
            lags = int(4 * (len(y) / 100) ** (2 / 9))
            meat = xu.T @ xu
            for k in range(1, lags + 1):
                g = xu[k:].T @ xu[:-k]
                meat += (1 - k / (lags + 1)) * (g + g.T)
            se = float(np.sqrt(max((inv @ meat @ inv)[2, 2], 0.0)))
            rows.append((f["series"].iloc[0], driver, round(float(beta[2]), 6), round(se, 6), ",".join(others), len(f)))
        return pd.DataFrame(rows, columns=["series", "driver", "beta", "hac_se", "beside", "n"])

    return run


def effects(panel: DataFrame, edges: DataFrame, target: str) -> DataFrame:
    """series, driver, lag, beta, hac_se, beside, n: each driver's whole effect on ``target`` at its lag.

    A series is one group; it has as many rows as points in time.
    """
    lags = written(choose_lags(panel, edges, target), "lags")
    beside: dict[str, list[str]] = {r["driver"]: [] for r in edges.where(F.col("target") == target).select("driver").distinct().collect()}  # the contract's drivers
    for r in controls(edges, target).collect():
        beside[r["driver"]].append(r["other"])
    beside = {k: sorted(v) for k, v in beside.items()}
    x = panel.join(lags, (panel["series"] == lags["series"]) & (panel["measure"] == lags["driver"])).select(panel["series"], (F.col("t") + F.col("lag")).alias("t"), "measure", F.col("y").alias("x"))
    wide = x.groupBy("series", "t").pivot("measure", sorted(beside)).agg(F.max("x"))
    full = wide.join(panel.where(F.col("measure") == target).select("series", "t", "y"), ["series", "t"]).na.drop()
    found = full.groupBy("series").applyInPandas(_estimate(beside), "series string, driver string, beta double, hac_se double, beside string, n int")
    return found.join(lags.select("series", "driver", "lag"), ["series", "driver"]).select("series", "driver", "lag", "beta", "hac_se", "beside", "n")


def weekly_panel(spark: SparkSession, sf: str) -> DataFrame:
    """series (region), t (week), measure, y: log units and price, mean discount, and log breadth, of whole weeks."""
    t = F.floor(F.datediff("d", F.lit(_MONDAY).cast("date")) / 7).cast("int")
    w = sales(spark, sf).groupBy(F.col("region").alias("series"), t.alias("t")).agg(F.sum("units").alias("u"), F.sum("net_e4").alias("v"), F.avg("discount_e4").alias("discount"), F.count_distinct("sku").alias("skus"))
    w = written(w, "weeks")
    ends = w.agg(F.min("t").alias("low"), F.max("t").alias("high"))  # one row; the first and the last week are cut off
    w = w.crossJoin(ends).where("t > low and t < high")
    measures = {"units": F.log("u"), "price": F.log(F.col("v") / 10000.0 / F.col("u")), "discount": F.col("discount") / 10000.0, "breadth": F.log("skus")}
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), v.cast("double").alias("y")) for k, v in measures.items()]))
    return written(w.select("series", "t", pairs.alias("x")).select("series", "t", "x.*"), "weekly-panel")


_PANEL = f"""{FACTS}, w0 as (select region as series, floor(date_diff('day', date '{_MONDAY}', d) / 7)::int as t, sum(units)::bigint as u, sum(net_e4)::bigint as v, avg(discount_e4) as discount, count(distinct sku) as skus from sales group by all), w as (select * from w0 where t > (select min(t) from w0) and t < (select max(t) from w0)),
  panel as materialized (select series, t, 'units' as measure, ln(u) as y from w union all select series, t, 'price', ln(v / 10000.0::double / u) from w union all select series, t, 'discount', discount / 10000.0::double from w union all select series, t, 'breadth', ln(skus) from w),
  edges as (select * from (values {', '.join(str(e) for e in UNITS)}) e(target, driver, lag_lo, lag_hi))"""


@query(
    "driver_lags",
    f"""{_PANEL}, c as (select series, t, measure, case when lag(t) over w = t - 1 then y - lag(y) over w end as dy from panel window w as (partition by series, measure order by t)),
  x as (select c.series, driver, lag_lo + k as lag_, c.t + lag_lo + k as t, dy as dx from c join edges on measure = driver and target = 'units', range(0, 5) r(k) where lag_lo + k <= lag_hi and dy is not null),
  r as (select x.series, driver, lag_, round(corr(dx, dy), 6) as r from x join c on c.series = x.series and c.t = x.t and c.measure = 'units' where dy is not null group by all having count(*) >= {PAIRS} and not isnan(corr(dx, dy)))
  select series, driver, lag_::int as lag, r from (select *, row_number() over (partition by series, driver order by abs(r) desc, lag_) as o from r) where o = 1""",
)
def driver_lags(spark: SparkSession, sf: str) -> DataFrame:
    """At which lag each driver of the contract moves with the units of each region."""
    return choose_lags(weekly_panel(spark, sf), spark.createDataFrame(UNITS, EDGES), "units")


@query("driver_effects")
def driver_effects(spark: SparkSession, sf: str) -> DataFrame:
    """The whole effect of each driver on a region's units, mediators left out."""
    return effects(weekly_panel(spark, sf), spark.createDataFrame(UNITS, EDGES), "units")
