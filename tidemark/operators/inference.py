"""What estimates are worth: p-values of a regression's tests, errors out of sample, and a slope freed of its endogeneity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.tails import chi2_tail, f_tail, t_two_sided
from tidemark.operators.attribution import _PANEL, panel
from tidemark.registry import query
from tidemark.session import written
from tidemark.sources.tables import FACTS, sales

_GAMMA = "1 - list_sum(list_transform(range(0, 400), lambda j: exp(({a} + j) * ln({x}) - ({x}) - lgamma({a} + j + 1))))"
#: I_x(k / 2, 1 / 2) at x = k / (k + t^2), as a series.
_TWO_SIDED = "list_sum(list_transform(range(0, 20000), lambda j: exp(lgamma(k / 2 + 0.5 + j) - lgamma(0.5) - lgamma(k / 2 + 1 + j) + (k / 2 + j) * ln(k / (k + t * t)) + 0.5 * ln(t * t / (k + t * t)))))"


@query(
    "test_p_values",
    f"""{_PANEL}, l as (select *, lag(u, 1) over (order by d) as u1, lag(u, 2) over (order by d) as u2, lag(u, 3) over (order by d) as u3, u * u as v from u),
  q as (select max(n)::double as n, max(beta) / sqrt(sum(v) / (max(n) - 2) / max(sxx)) as t, max(n) - 2.0::double as k, max(n) * regr_r2(v, x) as bp, max(n) * (max(n) + 2) * (pow(sum(u * u1) / sum(v), 2) / (max(n) - 1) + pow(sum(u * u2) / sum(v), 2) / (max(n) - 2) + pow(sum(u * u3) / sum(v), 2) / (max(n) - 3)) as lb from l)
  select n::int as n, round(t, 6) as t, round({_TWO_SIDED}, 6) as p_slope, round(lb, 6) as ljung_box, round({_GAMMA.format(a='1.5', x='lb / 2')}, 6) as p_no_memory, round(bp, 6) as breusch_pagan, round({_GAMMA.format(a='0.5', x='bp / 2')}, 6) as p_even_spread from q""",
)
def test_p_values(spark: SparkSession, sf: str) -> DataFrame:
    """Tests of purchases on clicks: the slope, memory over three days, and a spread that follows the driver."""
    order = Window.orderBy("d")  # one panel, a row a day
    r = panel(spark, sf).withColumns({f"u{k}": F.lag("u", k).over(order) for k in (1, 2, 3)}).withColumn("v", F.col("u") * F.col("u"))
    n, vv = F.max("n"), F.sum("v")
    lb = n * (n + 2) * sum((F.pow(F.sum(F.col("u") * F.col(f"u{k}")) / vv, 2) / (n - k) for k in (1, 2, 3)), F.lit(0.0))
    q = r.agg(n.alias("n"), (F.max("beta") / F.sqrt(vv / (n - 2) / F.max("sxx"))).alias("t"), (n * F.regr_r2("v", "x")).alias("bp"), lb.alias("lb"))
    return q.select(
        F.col("n").cast("int").alias("n"), F.round("t", 6).alias("t"), F.round(t_two_sided(F.col("t"), F.col("n") - 2), 6).alias("p_slope"),
        F.round("lb", 6).alias("ljung_box"), F.round(chi2_tail(F.col("lb"), F.lit(3)), 6).alias("p_no_memory"),
        F.round("bp", 6).alias("breusch_pagan"), F.round(chi2_tail(F.col("bp"), F.lit(1)), 6).alias("p_even_spread"),
    )


#: Folds, weeks of each fold's test, and weeks of a year.
FOLDS, AHEAD, YEAR = 4, 13, 52
_MONDAY = "1995-01-02"


def rolling_origin(weekly: DataFrame, folds: int = FOLDS, ahead: int = AHEAD) -> DataFrame:
    """series, fold, n, trend_mape, naive_mape: errors of a trend, and of last year's week, in weeks that the fit hasn't seen.

    weekly: series, t, y. The folds end one test before the other; all of them are one plan, a row once for each fold.
    """
    last = weekly.groupBy("series").agg(F.max("t").alias("last"))
    year = weekly.select("series", (F.col("t") + YEAR).alias("t"), F.col("y").alias("before"))
    rows = weekly.join(year, ["series", "t"], "left").join(last, "series").withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    cut = F.col("last") - F.col("fold") * ahead
    rows = rows.withColumn("part", F.when(F.col("t") <= cut, "fit").when(F.col("t") <= cut + ahead, "test")).where("part is not null")
    fit = lambda c: F.when(F.col("part") == "fit", c)
    line = rows.groupBy("series", "fold").agg(F.count(fit(F.col("y"))).alias("n"), F.regr_slope(fit(F.col("y")), fit(F.col("t"))).alias("slope"), F.regr_intercept(fit(F.col("y")), fit(F.col("t"))).alias("base"))
    test = rows.where("part = 'test' and y <> 0").join(line, ["series", "fold"])
    off = lambda x: F.round(F.avg(F.abs(F.col("y") - x) / F.abs("y")), 6)
    return test.groupBy("series", "fold").agg(F.max("n").alias("n"), off(F.col("base") + F.col("slope") * F.col("t")).alias("trend_mape"), off(F.col("before")).alias("naive_mape"))


def weekly_sales(spark: SparkSession, sf: str) -> DataFrame:
    """series (region), t (week), y: full weeks of net revenue."""
    t = F.floor(F.datediff("d", F.lit(_MONDAY).cast("date")) / 7).cast("int")
    w = sales(spark, sf).groupBy(F.col("region").alias("series"), t.alias("t")).agg((F.sum("net_e4") / 10000.0).alias("y"), F.count_distinct("d").alias("days"))
    return w.where("days = 7").drop("days")


_WEEKS = f"{FACTS}, w as (select region as series, floor(date_diff('day', date '{_MONDAY}', d) / 7)::int as t, sum(net_e4)::bigint / 10000.0::double as y from sales group by all having count(distinct d) = 7)"


@query(
    "rolling_origin",
    f"""{_WEEKS}, r as (select w.series, w.t, w.y, b.y as before, fold::int as fold, max(w.t) over (partition by w.series) - fold * {AHEAD} as cut from w left join w b on b.series = w.series and b.t = w.t - {YEAR}, (select unnest(range(1, {FOLDS + 1})) as fold)),
  l as (select series, fold, count(*) as n, regr_slope(y, t) as slope, regr_intercept(y, t) as base from r where t <= cut group by all)
  select r.series, r.fold, any_value(n) as n, round(avg(abs(y - (base + slope * t)) / abs(y)), 6) as trend_mape, round(avg(abs(y - before) / abs(y)), 6) as naive_mape from r join l on r.series = l.series and r.fold = l.fold where t > cut and t <= cut + {AHEAD} and y <> 0 group by all""",
)
def rolling_origin_query(spark: SparkSession, sf: str) -> DataFrame:
    return rolling_origin(weekly_sales(spark, sf))


def elasticities(panel: DataFrame, item: str = "sku") -> DataFrame:
    """naive, within, instrumented, first_stage_f, p_instrument, n: slopes of log units (lu) on log price (lp) over all rows,
    within items, and within items by an instrument (z) of the price alone.

    Two-stage least squares with one instrument is a ratio of two sums, so one aggregation serves all three.
    """
    own = Window.partitionBy(item)
    x = panel.select(item, "lu", "lp", *[(F.col(c) - F.avg(c).over(own)).alias(f"d{c}") for c in ("lu", "lp", "z")])
    s = lambda a, b: F.sum(F.col(a) * F.col(b))
    t = x.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(item).alias("items"), F.regr_slope("lu", "lp").alias("naive"), s("dlp", "dlu").alias("pu"), s("dlp", "dlp").alias("pp"), s("dz", "dlu").alias("zu"), s("dz", "dlp").alias("zp"), s("dz", "dz").alias("zz"))
    r2 = F.col("zp") * F.col("zp") / (F.col("zz") * F.col("pp"))
    free = F.col("n") - F.col("items") - 1
    f = r2 / (1 - r2) * free
    return t.select(
        F.round("naive", 5).alias("naive"), F.round(F.col("pu") / F.col("pp"), 5).alias("within"), F.round(F.col("zu") / F.col("zp"), 5).alias("instrumented"),
        F.round(f, 4).alias("first_stage_f"), F.round(f_tail(f, F.lit(1), free), 6).alias("p_instrument"), "n",
    )


def price_panel(spark: SparkSession, sf: str) -> DataFrame:
    """sku, region, q (quarter), lu, lp, z: logs of units and price; z is the product's log price in the other regions, which
    shares its costs but not the region's own demand."""
    g = written(sales(spark, sf).groupBy("sku", "region", F.trunc("d", "quarter").alias("q")).agg(F.sum("units").alias("u"), F.sum("net_e4").alias("v")), "quarters")
    both = Window.partitionBy("sku", "q")
    g = g.withColumns({"uo": F.sum("u").over(both) - F.col("u"), "vo": F.sum("v").over(both) - F.col("v")}).where("uo > 0 and u > 0 and v > 0 and vo > 0")
    return g.select("sku", "region", "q", F.log("u").alias("lu"), F.log(F.col("v") / F.col("u")).alias("lp"), F.log(F.col("vo") / F.col("uo")).alias("z"))


@query(
    "instrumented_elasticity",
    f"""{FACTS}, g as (select sku, region, date_trunc('quarter', d)::date as q, sum(units)::bigint as u, sum(net_e4)::bigint as v from sales group by all),
  o as (select *, sum(u) over (partition by sku, q)::bigint - u as uo, sum(v) over (partition by sku, q)::bigint - v as vo from g),
  p as (select sku, ln(u) as lu, ln(v / u) as lp, ln(vo / uo) as z from o where uo > 0 and u > 0 and v > 0 and vo > 0),
  x as (select sku, lu, lp, lu - avg(lu) over (partition by sku) as dlu, lp - avg(lp) over (partition by sku) as dlp, z - avg(z) over (partition by sku) as dz from p),
  t as (select count(*) as n, count(distinct sku) as items, regr_slope(lu, lp) as naive, sum(dlp * dlu) as pu, sum(dlp * dlp) as pp, sum(dz * dlu) as zu, sum(dz * dlp) as zp, sum(dz * dz) as zz from x),
  r as (select *, (n - items - 1)::double as k, zp * zp / (zz * pp) as r2 from t), f as (select *, r2 / (1 - r2) * k as f, sqrt(r2 / (1 - r2) * k) as t from r)
  select round(naive, 5) as naive, round(pu / pp, 5) as within, round(zu / zp, 5) as instrumented, round(f, 4) as first_stage_f, round({_TWO_SIDED}, 6) as p_instrument, n from f""",
)
def instrumented_elasticity(spark: SparkSession, sf: str) -> DataFrame:
    """Price elasticities side by side: naive, within products, and by prices elsewhere as the instrument."""
    return elasticities(price_panel(spark, sf))
