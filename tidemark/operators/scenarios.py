"""Whole paths: golden scenarios, versions of a definition, the feed, and how the engine adapts to what data there is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.contracts import CONTRACTS
from tidemark.operators.attribution import _MOVES, moves
from tidemark.operators.decisions import _BELIEF, beliefs
from tidemark.operators.series import by_series, ordered
from tidemark.registry import query
from tidemark.sources.tables import FACTS, daily_events, marketing, sales, table

#: A pillar below this fails the case, and the shares of explained movement that publish and that only hint.
PILLAR, PUBLISH, HINT = 0.35, 0.8, 0.5
_CASE = "scenario string, actual double, expected double, unexplained_pp double, stale_h double, sla_h double, recon double, tolerance double, pillars array<double>, n int, min_n int, low double, high double"
#: Scenarios with their published figures: a movement with several causes, stale and unreconciled data, a young product.
_CASES = [
    ("multi_factor", 60.8, 69.4, -1.4, 20.0, 30.0, 0.01, 0.05, [0.9, 0.85, 0.8, 0.88], 400, 28, 66.0, 73.0),
    ("stale_spend", 1.22, 1.0, 0.0, 216.0, 56.0, 0.18, 0.05, [0.31, 0.55, 0.61, 0.40], 60, 8, 0.9, 1.1),
    ("sparse_launch", 4.12, 5.1, 0.0, 10.0, 30.0, 0.0, 0.05, [0.6, 0.6, 0.6, 0.6], 18, 28, 3.8, 6.4),
]


def judge(cases: DataFrame) -> DataFrame:
    """gap, gap_pct, coverage, flagged, failed, verdict of each case: every gate that fails is named, not only the first.

    A case inside its band isn't flagged. With a shorter history than its contract asks for, a case is told as medium at best.
    """
    pct = 100 * (F.col("actual") - F.col("expected")) / F.col("expected")
    gates = [F.when(F.col("stale_h") > F.col("sla_h"), F.lit("freshness")), F.when(F.col("recon") > F.col("tolerance"), F.lit("reconciliation")), F.when(F.array_min("pillars") < PILLAR, F.lit("pillar"))]
    c = cases.withColumns({"gap": F.round(F.col("actual") - F.col("expected"), 4), "gap_pct": F.round(pct, 1), "flagged": ~F.col("actual").between(F.col("low"), F.col("high")), "failed": F.concat_ws(",", *gates)})
    c = c.withColumn("coverage", F.round(F.greatest(F.lit(0.0), 1 - F.abs("unexplained_pp") / F.abs(pct)), 2))
    tier = F.when(F.col("n") < F.col("min_n"), "medium").when(F.col("coverage") >= PUBLISH, "high").when(F.col("coverage") >= HINT, "medium").otherwise("low")
    verdict = F.when(~F.col("flagged"), "not_flagged").when(F.col("failed") != "", "abstain").otherwise("publish")
    return c.select("scenario", "gap", "gap_pct", "coverage", "flagged", "failed", verdict.alias("verdict"), F.when(F.col("failed") == "", tier).otherwise("none").alias("tier"))


@query("golden_scenarios", "with c as (select * from (values " + ", ".join(str(c) for c in _CASES) + f""") t(scenario, actual, expected, unexplained_pp, stale_h, sla_h, recon, tolerance, pillars, n, min_n, low, high)),
  g as (select *, 100 * (actual::double - expected::double) / expected::double as pct, concat_ws(',', case when stale_h > sla_h then 'freshness' end, case when recon > tolerance then 'reconciliation' end, case when list_min(pillars) < {PILLAR} then 'pillar' end) as failed, actual not between low and high as flagged from c),
  v as (select *, round(greatest(0.0, 1 - abs(unexplained_pp::double) / abs(pct)), 2) as coverage from g)
  select scenario, round(actual::double - expected::double, 4) as gap, round(pct, 1) as gap_pct, coverage, flagged, failed, case when not flagged then 'not_flagged' when failed <> '' then 'abstain' else 'publish' end as verdict,
    case when failed <> '' then 'none' when n < min_n then 'medium' when coverage >= {PUBLISH} then 'high' when coverage >= {HINT} then 'medium' else 'low' end as tier from v""")
def golden_scenarios(spark: SparkSession, sf: str) -> DataFrame:
    return judge(spark.createDataFrame(_CASES, _CASE))


#: Versions of net revenue: from when, and whether returns are taken off.
_VERSIONS = [("v1", "1990-01-01", "1998-01-01", False), ("v2", "1998-01-01", "9999-12-31", True)]


@query("definition_versions", f"{FACTS}, v as (select version, f::date as f, u::date as u, net from (values {', '.join(str(v) for v in _VERSIONS)}) t(version, f, u, net)) select year(d)::int as y, version, sum(case when net then net_e4 - ret_e4 else net_e4 end)::bigint as v_e4, count(*) as n from sales join v on d >= f and d < u group by all")
def definition_versions(spark: SparkSession, sf: str) -> DataFrame:
    """A measure whose definition changed: each row is counted by the version in force on its day, so the break is known."""
    v = spark.createDataFrame(_VERSIONS, "version string, f string, u string, net boolean").select("version", F.to_date("f").alias("f"), F.to_date("u").alias("u"), "net")
    s = sales(spark, sf).groupBy("d").agg(F.sum("net_e4").alias("gross"), F.sum("ret_e4").alias("ret"), F.count(F.lit(1)).alias("n"))  # a row a day meets the versions
    j = s.join(v, (F.col("d") >= F.col("f")) & (F.col("d") < F.col("u")))
    return j.groupBy(F.year("d").alias("y"), "version").agg(F.sum(F.when(F.col("net"), F.col("gross") - F.col("ret")).otherwise(F.col("gross"))).alias("v_e4"), F.sum("n").alias("n"))


@query("feed_filters", f"{_MOVES} select region, month, round(impact, 2) as impact, case when impact < 0 then 'down' else 'up' end as direction from moves where region in ('ASIA', 'EUROPE') and abs(z) >= 1.5 and impact < 0")
def feed_filters(spark: SparkSession, sf: str) -> DataFrame:
    """The feed for one reader: regions, size and direction as asked for."""
    m = moves(spark, sf).where(F.col("region").isin("ASIA", "EUROPE") & (F.abs("z") >= 1.5) & (F.col("impact") < 0))
    return m.select("region", "month", F.round("impact", 2).alias("impact"), F.when(F.col("impact") < 0, "down").otherwise("up").alias("direction"))


_ASKED = [(1, "net_revenue", "region", "ASIA"), (2, "net_revenue", "planet", "MARS"), (3, "no_such_kpi", "region", "ASIA"), (4, "net_revenue", "region", "ATLANTIS"), (5, "blended_roas", "region", "ASIA")]
_DIMENSIONS = sorted((c.kpi, d) for c in CONTRACTS.values() for d in c.dimensions)


@query("plan_allowlist", f"with a as (select * from (values {', '.join(str(a) for a in _ASKED)}) t(id, kpi, dimension, value)), k as (select * from (values {', '.join(str(d) for d in _DIMENSIONS)}) t(kpi, dimension)) select id, case when kpi not in (select kpi from k) then 'unknown kpi' when (kpi, dimension) not in (select kpi, dimension from k) then 'unknown dimension' when dimension = 'region' and value not in (select r_name from region) then 'unknown value' else 'accepted' end as outcome from a")
def plan_allowlist(spark: SparkSession, sf: str) -> DataFrame:
    """Plans may name only what contracts and dimension tables know; all else is refused by kind."""
    a = spark.createDataFrame(_ASKED, "id int, kpi string, dimension string, value string")
    k = spark.createDataFrame(_DIMENSIONS, "kpi string, dimension string").withColumn("known", F.lit(True))
    kpis = k.select("kpi").distinct().withColumn("kpi_known", F.lit(True))
    values = table(spark, sf, "region").select(F.lit("region").alias("dimension"), F.col("r_name").alias("value"), F.lit(True).alias("value_known"))
    j = a.join(kpis, "kpi", "left").join(k, ["kpi", "dimension"], "left").join(values, ["dimension", "value"], "left")
    outcome = F.when(F.col("kpi_known").isNull(), "unknown kpi").when(F.col("known").isNull(), "unknown dimension").when((F.col("dimension") == "region") & F.col("value_known").isNull(), "unknown value").otherwise("accepted")
    return j.select("id", outcome.alias("outcome"))


#: Days of each year on which demand differs: month, day, name.
_HOLIDAYS = [(1, 1, "new year"), (1, 26, "republic day"), (8, 15, "independence day"), (10, 2, "gandhi jayanti"), (12, 25, "christmas")]


@query("holiday_effect", f"{FACTS}, h as (select * from (values {', '.join(str(h) for h in _HOLIDAYS)}) t(m, dd, holiday)), x as (select region, d, sum(units)::bigint as units from sales group by all), w as (select x.*, holiday, avg(units) over (partition by region order by d range between interval 14 days preceding and interval 1 day preceding) as base from x left join h on month(d) = m and day(d) = dd) select region, holiday, count(*) as n, round(avg(units / base), 6) as ratio from w where holiday is not null and base is not null group by all")
def holiday_effect(spark: SparkSession, sf: str) -> DataFrame:
    """Units on holidays against the two weeks before, by region."""
    h = spark.createDataFrame(_HOLIDAYS, "m int, dd int, holiday string")
    x = sales(spark, sf).groupBy("region", "d").agg(F.sum("units").alias("units")).withColumn("k", F.unix_date("d"))
    x = x.withColumn("base", F.avg("units").over(Window.partitionBy("region").orderBy("k").rangeBetween(-14, -1)))
    j = x.join(h, (F.month("d") == F.col("m")) & (F.day("d") == F.col("dd"))).where("base is not null")
    return j.groupBy("region", "holiday").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("units") / F.col("base")), 6).alias("ratio"))


@query("regime_refit", f"{FACTS}, s as (select series, t, y, sum(y - m) over (partition by series order by t) as c, sd, n from (select *, avg(y) over (partition by series) as m, stddev(y) over (partition by series) as sd, count(*) over (partition by series) as n from daily_events)), b as (select series, arg_max(t, (round(abs(c), 6), -t)) as brk, round(max(abs(c)) / (any_value(sd) * sqrt(any_value(n))), 6) as size from s group by series) select s.series, brk as break_t, size, size > 1.36 as broken, round(avg(y) filter (size <= 1.36 or t > brk), 6) as level, count(*) filter (size <= 1.36 or t > brk) as kept from s join b on s.series = b.series group by s.series, brk, size")
def regime_refit(spark: SparkSession, sf: str) -> DataFrame:
    """Where a series broke by more than chance would, the level is fitted to what came after, and the rest calibrates nothing."""
    w = by_series()
    s = daily_events(spark, sf).withColumns({"x": F.col("y") - F.avg("y").over(w), "sd": F.stddev("y").over(w), "n": F.count("y").over(w)}).withColumn("c", F.sum("x").over(ordered().rowsBetween(Window.unboundedPreceding, 0)))
    b = s.groupBy("series").agg(F.max_by("t", F.struct(F.round(F.abs("c"), 6), -F.col("t"))).alias("at"), F.round(F.max(F.abs("c")) / (F.first("sd") * F.sqrt(F.first("n"))), 6).alias("size"))
    kept = (F.col("size") <= 1.36) | (F.col("t") > F.col("at"))
    out = s.join(b, "series").groupBy("series", "at", "size").agg(F.round(F.avg(F.when(kept, F.col("y"))), 6).alias("level"), F.count_if(kept).alias("kept"))
    return out.select("series", F.col("at").alias("break_t"), "size", (F.col("size") > 1.36).alias("broken"), "level", "kept")


_ROUTE = "case when n < 8 then 'pooled_launch' when cadence = 'weekly' then 'cusum_first' when dims = 0 then 'correlated_kpis' when members > 1000 then 'top_down' when docs = 0 then 'calendar_only' else 'full' end"
_CAP = "case when n < 8 then 'moderate' when dims = 0 or docs = 0 then 'moderate' else 'high' end"


@query("adaptation_matrix", f"{FACTS}, f as (select 'sales' as fact, 'daily' as cadence, count(distinct d) as n, 7 as dims, count(distinct sku) as members from sales union all select 'marketing', 'weekly', count(distinct iso_week), 1, count(distinct media_channel) from marketing union all select 'totals', 'daily', count(distinct d), 0, 1 from daily_sales), g as (select *, (select count(*) from documents) as docs from f) select fact, cadence, n, members, {_ROUTE} as route, {_CAP} as cap from g")
def adaptation_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """What each fact can bear: its cadence, history, members and documents choose the route and cap the tier."""
    s = sales(spark, sf)
    count = lambda df, fact, cadence, time, dims, member: df.agg(F.count_distinct(time).alias("n"), (F.count_distinct(member) if member else F.lit(1).cast("long")).alias("members")).select(F.lit(fact).alias("fact"), F.lit(cadence).alias("cadence"), "n", F.lit(dims).alias("dims"), "members")
    f = count(s, "sales", "daily", "d", 7, "sku").unionByName(count(marketing(spark, sf), "marketing", "weekly", "iso_week", 1, "media_channel")).unionByName(count(s.select("d").distinct(), "totals", "daily", "d", 0, None))
    f = f.crossJoin(table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("docs")))  # one row
    return f.select("fact", "cadence", "n", "members", F.expr(_ROUTE).alias("route"), F.expr(_CAP).alias("cap"))


@query("insight_versions", f"{_BELIEF}, b as (select region, month, verdict, impact, lag(verdict) over (partition by region order by month) as before from d) select region, count(*) filter (before is not null and before <> verdict) as changed, arg_max(verdict, month) as current, count(*) as n from b group by region")
def insight_versions(spark: SparkSession, sf: str) -> DataFrame:
    """A region's verdict month after month: each new one supersedes the last, and how often it changed."""
    before = F.lag("verdict").over(Window.partitionBy("region").orderBy("month"))
    b = beliefs(spark, sf).select("region", "month", "verdict").withColumn("before", before)
    return b.groupBy("region").agg(F.count_if(F.col("before") != F.col("verdict")).alias("changed"), F.max_by("verdict", "month").alias("current"), F.count(F.lit(1)).alias("n"))
