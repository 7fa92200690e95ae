"""A simulated business with known truth: every draw depends on its keys alone, so any part can be drawn again.

Series whose state feeds back on itself (stock, spend that follows revenue) run in one task for each series; all
else is column arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import stats
from tidemark.functions.rng import normal, normal_sql, uniform, uniform_sql
from tidemark.registry import query
from tidemark.sources.tables import table

SKUS, REGIONS, CHANNELS, DAYS = 40, 5, 4, 120
ACTIVE = 0.35
ELASTICITY = -0.8


def cube(spark: SparkSession) -> DataFrame:
    """The active cells of product, region and channel."""
    axis = lambda n, name: spark.range(n).select(F.col("id").cast("int").alias(name))
    cells = axis(SKUS, "sku").crossJoin(axis(REGIONS, "region")).crossJoin(axis(CHANNELS, "channel"))  # a few hundred cells by definition
    return cells.where(uniform("cube", "sku", "region", "channel") < ACTIVE)


def demand(spark: SparkSession, shock: float = 1.0) -> DataFrame:
    """sku, region, channel, t, price, units: level, week, season, price, autocorrelated noise, and a shock from day 60.

    The noise is AR(1) with phi .35: a sum over the last twelve draws, as older ones weigh under 1e-5.
    """
    c = cube(spark).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(DAYS - 1))))
    c = c.withColumns({"level": 20 + 80 * uniform("level", "sku"), "price": F.round(10 + 90 * uniform("price", "sku") * (1 - 0.2 * (uniform("promo", "sku", "t") < 0.1).cast("int")), 2), "e": normal("noise", "sku", "region", "channel", "t")})
    w = Window.partitionBy("sku", "region", "channel").orderBy("t")
    noise = sum((F.coalesce(F.lag("e", k).over(w), F.lit(0.0)) * 0.35**k for k in range(1, 12)), F.col("e"))
    week = 1 + 0.2 * (F.col("t") % 7 >= 5).cast("int")
    season = 1 + 0.1 * F.sin(F.col("t") * 0.05)
    hit = F.when((F.col("t") >= 60) & (F.col("region") == 1), shock).otherwise(1.0)
    mean = F.col("level") * week * season * F.pow(F.col("price") / 50, F.lit(ELASTICITY)) * F.exp(0.1 * noise) * hit
    return c.select("sku", "region", "channel", "t", "price", F.floor(mean + uniform("round", "sku", "region", "channel", "t")).alias("units"))


_CUBE = f"with cells as (select s.range::int as sku, r.range::int as region, c.range::int as channel from range({SKUS}) s, range({REGIONS}) r, range({CHANNELS}) c), cube0 as (select * from cells where {uniform_sql('cube', 'sku', 'region', 'channel')} < {ACTIVE})"
_NOISE = " + ".join(["e"] + [f"coalesce(lag(e, {k}) over w, 0) * {0.35**k!r}::double" for k in range(1, 12)])
_DEMAND = f"""{_CUBE}, g as (select *, 20 + 80 * {uniform_sql('level', 'sku')} as level, round(10 + 90 * {uniform_sql('price', 'sku')} * (1 - 0.2::double * ({uniform_sql('promo', 'sku', 't')} < 0.1)::int), 2) as price,
    {normal_sql('noise', 'sku', 'region', 'channel', 't')} as e from cube0, (select range::int as t from range({DAYS}))),
  n as (select *, {_NOISE} as noise from g window w as (partition by sku, region, channel order by t)),
  demand as (select sku, region, channel, t, price, floor(level * (1 + 0.2::double * (t % 7 >= 5)::int) * (1 + 0.1::double * sin(t * 0.05::double)) * pow(price / 50, {ELASTICITY}) * exp(0.1::double * noise) * {{shock}} + {uniform_sql('round', 'sku', 'region', 'channel', 't')})::bigint as units from n)"""
_PLAIN = _DEMAND.format(shock="1")
_SHOCKED = _DEMAND.format(shock="case when t >= 60 and region = 1 then 0.8::double else 1 end")


@query("rng_normal", f"select event_id, round({normal_sql('x', 'event_id')}, 8) as z from events")
def rng_normal(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.round(normal("x", "event_id"), 8).alias("z"))


@query("sim_cube", f"{_CUBE} select * from cube0")
def sim_cube(spark: SparkSession, sf: str) -> DataFrame:
    return cube(spark)


@query("sim_demand", f"{_PLAIN} select sku, region, t, sum(units)::bigint as units from demand group by all")
def sim_demand(spark: SparkSession, sf: str) -> DataFrame:
    return demand(spark).groupBy("sku", "region", "t").agg(F.sum("units").alias("units"))


@query("crn_except", f"{_PLAIN} select sku, region, channel, t, units from demand where false")
def crn_except(spark: SparkSession, sf: str) -> DataFrame:
    """An event without magnitude leaves every row as it was: nothing differs, either way."""
    a, b = demand(spark).drop("price"), demand(spark, 1.0).drop("price")
    return a.exceptAll(b).union(b.exceptAll(a))


@query("windowed_counterfactual", f"{_SHOCKED} select region, t, sum(units)::bigint as with_event from demand where t between 50 and 119 group by all")
def windowed_counterfactual(spark: SparkSession, sf: str) -> DataFrame:
    """The days around an event, drawn again with it."""
    return demand(spark, 0.8).where("t between 50 and 119").groupBy("region", "t").agg(F.sum("units").alias("with_event"))


@query("calib_events", f"select range::int as id, case when u1 < 0.25 then 'small' when u1 < 0.75 then 'medium' else 'large' end as magnitude, (range % 5)::int as region, 20 + floor(80 * {uniform_sql('day', 'range')})::bigint as day, u2 < 0.15 as undocumented, u2 >= 0.15 and u2 < 0.25 as contradictory, 3 + floor(4 * {uniform_sql('copies', 'range')})::bigint as syndication from (select range, {uniform_sql('mag', 'range')} as u1, {uniform_sql('docs', 'range')} as u2 from range(400))")
def calib_events(spark: SparkSession, sf: str) -> DataFrame:
    """Four hundred events over size, place, time and evidence."""
    e = spark.range(400).select(F.col("id").cast("int").alias("id"))
    e = e.withColumns({"u1": _u("mag"), "u2": _u("docs")})
    size = F.when(F.col("u1") < 0.25, "small").when(F.col("u1") < 0.75, "medium").otherwise("large")
    return e.select("id", size.alias("magnitude"), (F.col("id") % 5).alias("region"), (20 + F.floor(80 * _u("day"))).alias("day"), (F.col("u2") < 0.15).alias("undocumented"), ((F.col("u2") >= 0.15) & (F.col("u2") < 0.25)).alias("contradictory"), (3 + F.floor(4 * _u("copies"))).alias("syndication"))


def _u(seed: str):
    return uniform(seed, "id")


@query("corpus_rates", f"with e as (select range as id, {uniform_sql('docs', 'range')} as u, 3 + floor(4 * {uniform_sql('copies', 'range')})::bigint as copies from range(400)), d as (select id, u, unnest(range(0, copies)) as k from e where u >= 0.15) select count(distinct id) as documented, count(*) as documents, count(*) filter ({uniform_sql('dual', 'id', 'k')} < 0.2) as dual_dated, count(*) filter ({uniform_sql('decoy', 'id', 'k')} < 0.08) as decoys, count(distinct id) filter (u < 0.25) as contradictory from d")
def corpus_rates(spark: SparkSession, sf: str) -> DataFrame:
    """How many documents the events leave, and how many of them mislead."""
    e = spark.range(400).select("id", _u("docs").alias("u"), (3 + F.floor(4 * _u("copies"))).alias("copies")).where("u >= 0.15")
    d = e.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)))
    return d.agg(
        F.count_distinct("id").alias("documented"), F.count(F.lit(1)).alias("documents"), F.count_if(uniform("dual", "id", "k") < 0.2).alias("dual_dated"), F.count_if(uniform("decoy", "id", "k") < 0.08).alias("decoys"),
        F.count_distinct(F.when(F.col("u") < 0.25, F.col("id"))).alias("contradictory"),
    )


@query("sim_spend")
def sim_spend(spark: SparkSession, sf: str) -> DataFrame:
    """Spend that follows last week's revenue, week after week, by channel."""
    d = demand(spark).groupBy("channel", F.floor(F.col("t") / 7).cast("int").alias("week")).agg(F.sum(F.col("units") * F.col("price")).alias("revenue"))
    d = d.withColumn("z", normal("spend", "channel", "week"))
    return d.groupBy("channel").applyInPandas(stats.endogenous_spend, "channel int, week int, spend double")


@query("sim_inventory")
def sim_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Stock by product and region under an order-up-to rule; what is short isn't sold."""
    d = demand(spark).groupBy("sku", "region", "t").agg(F.sum("units").alias("units"))
    return d.groupBy("sku", "region").applyInPandas(stats.inventory, "sku int, region int, t int, stock long, sold long, short long")


@query("mstl_fit")
def mstl_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Baselines with the periods that each series shows, by region."""
    d = demand(spark).groupBy("region", "t").agg(F.sum("units").alias("y"))
    return d.groupBy("region").applyInPandas(stats.mstl, "region int, t int, trend double, seasonal double, remainder double")


@query("fgls_drivers")
def fgls_drivers(spark: SparkSession, sf: str) -> DataFrame:
    """Elasticity by region from a regression with autocorrelated errors; the truth is -0.8."""
    d = demand(spark).withColumns({"ly": F.log(F.col("units") + 0.5), "lx": F.log("price")})
    by = Window.partitionBy("sku", "region", "channel")
    d = d.select("region", "sku", "channel", "t", (F.col("ly") - F.avg("ly").over(by)).alias("y"), (F.col("lx") - F.avg("lx").over(by)).alias("x"))
    return d.groupBy("region").applyInPandas(stats.cochrane_orcutt, "region int, beta double, rho double, n long")
