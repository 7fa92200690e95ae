"""Where a movement happened, of what kind it is, and why: segments, price-volume-mix, drivers, event studies."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import stats
from tidemark.functions.rng import uniform, uniform_sql
from tidemark.registry import query
from tidemark.sources.tables import FACTS, daily_events, sales, table

#: The periods that the queries compare.
BASE, NOW = 1997, 1998
DIMS = ("region", "category", "segment", "sales_channel")


def actual_and_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """Leaf cube: dimensions, a (now) and f (base), in whole ten-thousandths, and n rows."""
    s = sales(spark, sf).where(F.year("d").isin(BASE, NOW))
    return s.groupBy(*DIMS).agg(F.sum(F.when(F.year("d") == NOW, F.col("net_e4")).otherwise(0)).alias("a"), F.sum(F.when(F.year("d") == BASE, F.col("net_e4")).otherwise(0)).alias("f"), F.count(F.lit(1)).alias("n"))


_CUBE = f"{FACTS}, cube0 as (select region, category, segment, sales_channel, sum(case when year(d) = {NOW} then net_e4 else 0 end)::bigint as a, sum(case when year(d) = {BASE} then net_e4 else 0 end)::bigint as f, count(*) as n from sales where year(d) in ({BASE}, {NOW}) group by all)"


def surprise(p: Column, q: Column) -> Column:
    """A segment's part of the Jensen-Shannon divergence of shares."""
    part = lambda x: F.when(x > 0, x * F.log(2 * x / (p + q))).otherwise(0.0)
    return 0.5 * (part(p) + part(q))


def adtributor(cube: DataFrame, dims: tuple[str, ...] = DIMS, max_dims: int = 1, top_k: int = 5, min_obs: int = 30) -> DataFrame:
    """dims, segment, ep, surprise, score, rk: the best segments of each set of at most ``max_dims`` dimensions.

    All sets come from one aggregation with grouping sets over the leaf cube.
    """
    sets = [list(c) for k in range(1, max_dims + 1) for c in combinations(dims, k)]
    g = cube.groupingSets(sets, *dims).agg(F.sum("a").alias("a"), F.sum("f").alias("f"), F.sum("n").alias("n"))
    name = F.concat_ws("+", *[F.when(F.col(d).isNotNull(), F.lit(d)) for d in dims])
    value = F.concat_ws("+", *[F.col(d) for d in dims])
    g = g.select(name.alias("dims"), value.alias("segment"), "a", "f", "n")
    by = Window.partitionBy("dims")
    ta, tf = F.sum("a").over(by), F.sum("f").over(by)
    g = g.withColumns({"ep": F.round((F.col("a") - F.col("f")) / (ta - tf), 8), "surprise": F.round(surprise(F.col("f") / tf, F.col("a") / ta), 10)})
    g = g.where(F.col("n") >= min_obs).withColumn("score", F.round(F.col("ep") * F.col("surprise"), 12))
    g = g.withColumn("rk", F.row_number().over(by.orderBy(F.desc("score"), "segment")).cast("long"))
    return g.where(F.col("rk") <= top_k).select("dims", "segment", "ep", "surprise", "score", "rk")


def _adtributor_sql(sets: list[tuple[str, ...]]) -> str:
    union = " union all ".join(f"select '{'+'.join(s)}' as dims, {' || chr(43) || '.join(s)} as segment, sum(a)::bigint as a, sum(f)::bigint as f, sum(n)::bigint as n from cube0 group by {', '.join(s)}" for s in sets)
    return f"""{_CUBE}, g as ({union}), t as (select *, sum(a) over (partition by dims)::bigint as ta, sum(f) over (partition by dims)::bigint as tf from g),
    e as (select *, round((a - f) / (ta - tf), 8) as ep, f / tf as p, a / ta as q from t),
    j as (select *, round(0.5 * (case when p > 0 then p * ln(2 * p / (p + q)) else 0 end + case when q > 0 then q * ln(2 * q / (p + q)) else 0 end), 10) as surprise from e where n >= 30),
    r as (select dims, segment, ep, surprise, round(ep * surprise, 12) as score from j),
    adtributor as (select * from (select *, row_number() over (partition by dims order by score desc, segment) as rk from r) where rk <= 5)"""


@query("adtributor_1d", _adtributor_sql([(d,) for d in DIMS]) + " select * from adtributor")
def adtributor_1d(spark: SparkSession, sf: str) -> DataFrame:
    return adtributor(actual_and_forecast(spark, sf))


_PAIRS = [(d,) for d in DIMS] + list(combinations(DIMS, 2))


@query("adtributor_2d", _adtributor_sql(_PAIRS) + " select * from adtributor")
def adtributor_2d(spark: SparkSession, sf: str) -> DataFrame:
    return adtributor(actual_and_forecast(spark, sf), max_dims=2)


@query("pareto_causes", _adtributor_sql([(d,) for d in DIMS]) + ", c as (select *, sum(ep) over (partition by dims order by rk rows between unbounded preceding and 1 preceding) as before from adtributor) select dims, segment, ep, rk from c where coalesce(round(before, 6), 0) < 0.85 and rk <= 4")
def pareto_causes(spark: SparkSession, sf: str) -> DataFrame:
    """Within a dimension segments don't overlap: they are kept until they explain enough, four at most."""
    before = F.sum("ep").over(Window.partitionBy("dims").orderBy("rk").rowsBetween(Window.unboundedPreceding, -1))
    c = adtributor_1d(spark, sf).withColumn("before", F.coalesce(F.round(before, 6), F.lit(0.0)))
    return c.where("before < 0.85 and rk <= 4").select("dims", "segment", "ep", "rk")


@query(
    "simpson_check",
    f"""{FACTS}, s as (select region, sales_channel, year(d) as y, sum(net_e4)::bigint as v, sum(units)::bigint as u from sales where year(d) in ({BASE}, {NOW}) group by all),
    c as (select region, sales_channel, max(case when y = {NOW} then v / u end) - max(case when y = {BASE} then v / u end) as dr from s group by all),
    p as (select region, sum(case when y = {NOW} then v else 0 end) / sum(case when y = {NOW} then u else 0 end) - sum(case when y = {BASE} then v else 0 end) / sum(case when y = {BASE} then u else 0 end) as dr from s group by 1)
    select c.region, round(p.dr, 4) as parent_change, count(*) filter (c.dr > 0) as children_up, count(*) as children, (bool_and(c.dr > 0) and p.dr < 0) or (bool_and(c.dr < 0) and p.dr > 0) as reversed from c join p on c.region = p.region group by c.region, p.dr""",
)
def simpson_check(spark: SparkSession, sf: str) -> DataFrame:
    """Whether all children of a segment moved one way while the segment itself moved the other."""
    s = sales(spark, sf).where(F.year("d").isin(BASE, NOW))
    rate = lambda y: F.sum(F.when(F.year("d") == y, F.col("net_e4")).otherwise(0)) / F.nullif(F.sum(F.when(F.year("d") == y, F.col("units")).otherwise(0)), F.lit(0))
    child = s.groupBy("region", "sales_channel").agg((rate(NOW) - rate(BASE)).alias("dr"))
    parent = s.groupBy("region").agg((rate(NOW) - rate(BASE)).alias("p"))
    up, down = F.bool_and(F.col("dr") > 0), F.bool_and(F.col("dr") < 0)
    out = child.join(parent, "region").groupBy("region", "p").agg(F.count_if(F.col("dr") > 0).alias("children_up"), F.count(F.lit(1)).alias("children"), ((up & (F.col("p") < 0)) | (down & (F.col("p") > 0))).alias("reversed"))
    return out.select("region", F.round("p", 4).alias("parent_change"), "children_up", "children", "reversed")


@query(
    "bootstrap_stability",
    f"""{_CUBE}, r as (select unnest(range(0, 100))::int as draw),
    w as (select draw, region, a, f, floor(-ln(1 - {uniform_sql('boot', 'draw', 'region', 'category', 'segment', 'sales_channel')}) * 1000000)::bigint as wt from cube0, r),
    s as (select draw, region, sum(wt * ((a - f) // 10000))::hugeint as gap from w group by all),
    k as (select *, row_number() over (partition by draw order by gap desc, region) as rk from s)
    select region, count(*) filter (rk = 1) as wins, round(count(*) filter (rk = 1) / 100, 4) as win_rate from k group by region""",
)
def bootstrap_stability(spark: SparkSession, sf: str) -> DataFrame:
    """How often a region leads when the leaves are weighted anew; weights depend on keys and draw alone."""
    cube = actual_and_forecast(spark, sf).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(99))))
    weight = F.floor(-F.log(1 - uniform("boot", "draw", *DIMS)) * 1000000).cast("decimal(20,0)")
    gap = F.floor((F.col("a") - F.col("f")) / 10000).cast("decimal(18,0)")
    s = cube.groupBy("draw", "region").agg(F.sum(weight * gap).alias("gap"))
    k = s.withColumn("rk", F.row_number().over(Window.partitionBy("draw").orderBy(F.desc("gap"), "region")))
    return k.groupBy("region").agg(F.count_if(F.col("rk") == 1).alias("wins"), F.round(F.count_if(F.col("rk") == 1) / 100, 4).alias("win_rate"))


_PVM = f"{FACTS}, g as (select category, sum(case when year(d) = {BASE} then units else 0 end)::bigint as q0, sum(case when year(d) = {NOW} then units else 0 end)::bigint as q1, sum(case when year(d) = {BASE} then net_e4 else 0 end)::bigint as v0, sum(case when year(d) = {NOW} then net_e4 else 0 end)::bigint as v1 from sales group by 1)"


@query("bennet_pvm", f"""{_PVM}, p as (select *, coalesce(v0 / nullif(q0, 0), v1 / nullif(q1, 0)) as p0, coalesce(v1 / nullif(q1, 0), v0 / nullif(q0, 0)) as p1, sum(q0) over () as t0, sum(q1) over () as t1 from g)
    select round(sum((p1 - p0) * (q0 + q1) / 2) / 10000, 4) as price, round(sum((p0 + p1) / 2 * (q0 / t0 + q1 / t1) / 2 * (t1 - t0)) / 10000, 4) as own_volume, round(sum((p0 + p1) / 2 * (t0 + t1) / 2 * (q1 / t1 - q0 / t0)) / 10000, 4) as mix, round((sum(v1) - sum(v0))::double / 10000, 4) as total from p""")
def bennet_pvm(spark: SparkSession, sf: str) -> DataFrame:
    """Price, own volume and mix, which add up to the change; a missing price is the other period's."""
    at = lambda y, c: F.sum(F.when(F.year("d") == y, F.col(c)).otherwise(0))
    g = sales(spark, sf).groupBy("category").agg(at(BASE, "units").alias("q0"), at(NOW, "units").alias("q1"), at(BASE, "net_e4").alias("v0"), at(NOW, "net_e4").alias("v1"))
    own = lambda v, q: F.col(v) / F.nullif(F.col(q), F.lit(0))
    p = g.withColumns({"p0": F.coalesce(own("v0", "q0"), own("v1", "q1")), "p1": F.coalesce(own("v1", "q1"), own("v0", "q0")), "t0": F.sum("q0").over(Window.partitionBy()), "t1": F.sum("q1").over(Window.partitionBy())})
    mean = F.expr("(p0 + p1) / 2")
    return p.agg(
        F.round(F.sum(F.expr("(p1 - p0) * (q0 + q1) / 2")) / 10000, 4).alias("price"),
        F.round(F.sum(mean * F.expr("(q0 / t0 + q1 / t1) / 2 * (t1 - t0)")) / 10000, 4).alias("own_volume"),
        F.round(F.sum(mean * F.expr("(t0 + t1) / 2 * (q1 / t1 - q0 / t0)")) / 10000, 4).alias("mix"),
        F.round((F.sum("v1") - F.sum("v0")) / 10000.0, 4).alias("total"),
    )


@query("ols_regr", f"{FACTS} select sales_channel, count(*) as n, round(regr_slope(net_e4 / 10000.0::double, units), 4) as slope, round(regr_intercept(net_e4 / 10000.0::double, units), 2) as intercept, round(regr_r2(net_e4 / 10000.0::double, units), 6) as r2 from sales group by 1")
def ols_regr(spark: SparkSession, sf: str) -> DataFrame:
    y = F.col("net_e4") / 10000.0
    return sales(spark, sf).groupBy("sales_channel").agg(F.count(F.lit(1)).alias("n"), F.round(F.regr_slope(y, "units"), 4).alias("slope"), F.round(F.regr_intercept(y, "units"), 2).alias("intercept"), F.round(F.regr_r2(y, "units"), 6).alias("r2"))


_PANEL = f"{FACTS}, w as (select d, max(case when series = 'purchase' then y end) as y, max(case when series = 'click' then y end) as x from daily_events group by d), c as (select d, y - avg(y) over () as y, x - avg(x) over () as x from w), b as (select sum(x * y) / sum(x * x) as beta, sum(x * x) as sxx, count(*) as n from c), u as (select d, x, y - beta * x as u, n, sxx, beta from c, b)"


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """d, y, x, centred: purchases and clicks by day; beta, sxx and n beside them, u the residual."""
    e = daily_events(spark, sf)
    pick = lambda s: F.max(F.when(F.col("series") == s, F.col("y")))
    w = e.groupBy("d").agg(pick("purchase").alias("y"), pick("click").alias("x"))
    c = w.select("d", (F.col("y") - F.avg("y").over(Window.partitionBy())).alias("y"), (F.col("x") - F.avg("x").over(Window.partitionBy())).alias("x"))
    c = c.withColumns({"sxx": F.sum(F.col("x") * F.col("x")).over(Window.partitionBy()), "n": F.count(F.lit(1)).over(Window.partitionBy())})
    return c.withColumn("beta", F.sum(F.col("x") * F.col("y")).over(Window.partitionBy()) / F.col("sxx")).withColumn("u", F.col("y") - F.col("beta") * F.col("x"))


@query("hac_se", f"{_PANEL}, h as (select *, x * u as g, lag(x * u, 1) over (order by d) as g1, lag(x * u, 2) over (order by d) as g2, lag(x * u, 3) over (order by d) as g3 from u) select round(max(beta), 6) as beta, round(sqrt(sum(g * g) + 2 * (0.75 * sum(g * g1) + 0.5 * sum(g * g2) + 0.25 * sum(g * g3))) / max(sxx), 6) as hac_se, max(n)::int as n from h")
def hac_se(spark: SparkSession, sf: str) -> DataFrame:
    """Newey-West error of a slope: lagged products with Bartlett weights, three lags for thirty days."""
    lags = 3
    h = panel(spark, sf).withColumn("g", F.col("x") * F.col("u"))
    h = h.withColumns({f"g{k}": F.lag("g", k).over(Window.orderBy("d")) for k in range(1, lags + 1)})
    meat = F.sum(F.col("g") * F.col("g")) + 2 * sum(((1 - k / (lags + 1)) * F.sum(F.col("g") * F.col(f"g{k}")) for k in range(1, lags + 1)), F.lit(0.0))
    return h.agg(F.round(F.max("beta"), 6).alias("beta"), F.round(F.sqrt(meat) / F.max("sxx"), 6).alias("hac_se"), F.max("n").cast("int").alias("n"))


@query("diagnostics", f"{_PANEL}, l as (select *, lag(u, 1) over (order by d) as u1, lag(u, 2) over (order by d) as u2, u * u as v from u) select round(sum((u - u1) * (u - u1)) / sum(u * u), 6) as durbin_watson, round(max(n) * (max(n) + 2) * (pow(sum(u * u1) / sum(u * u), 2) / (max(n) - 1) + pow(sum(u * u2) / sum(u * u), 2) / (max(n) - 2)), 6) as ljung_box_2, round(max(n) * regr_r2(v, x), 6) as breusch_pagan from l")
def diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.orderBy("d")
    r = panel(spark, sf).withColumns({"u1": F.lag("u", 1).over(order), "u2": F.lag("u", 2).over(order), "v": F.col("u") * F.col("u")})
    n, uu = F.max("n"), F.sum("v")
    rho = lambda k: F.pow(F.sum(F.col("u") * F.col(f"u{k}")) / uu, 2) / (n - k)
    step = F.col("u") - F.col("u1")
    return r.agg(F.round(F.sum(step * step) / uu, 6).alias("durbin_watson"), F.round(n * (n + 2) * (rho(1) + rho(2)), 6).alias("ljung_box_2"), F.round(n * F.regr_r2("v", "x"), 6).alias("breusch_pagan"))


@query("vif_corr", f"{FACTS}, w as (select d, max(case when series = 'click' then y end) as a, max(case when series = 'view' then y end) as b, max(case when series = 'signup' then y end) as c from daily_events group by d) select round(corr(a, b), 6) as r_ab, round(corr(a, c), 6) as r_ac, round(corr(b, c), 6) as r_bc, round((1 - pow(corr(b, c), 2)) / (1 + 2 * corr(a, b) * corr(a, c) * corr(b, c) - pow(corr(a, b), 2) - pow(corr(a, c), 2) - pow(corr(b, c), 2)), 6) as vif_a from w")
def vif_corr(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda s, n: F.max(F.when(F.col("series") == s, F.col("y"))).alias(n)
    w = daily_events(spark, sf).groupBy("d").agg(pick("click", "a"), pick("view", "b"), pick("signup", "c"))
    r = w.agg(F.corr("a", "b").alias("ab"), F.corr("a", "c").alias("ac"), F.corr("b", "c").alias("bc"))
    det = F.expr("1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc")
    return r.select(*[F.round(c, 6).alias(f"r_{c}") for c in ("ab", "ac", "bc")], F.round(F.expr("1 - bc * bc") / det, 6).alias("vif_a"))


@query("naive_elasticity", f"{FACTS}, w as (select sku, date_trunc('quarter', d)::date as q, ln(sum(units)) as lu, ln(sum(net_e4) / sum(units)) as lp from sales group by all), x as (select *, lu - avg(lu) over (partition by sku) as du, lp - avg(lp) over (partition by sku) as dp from w) select round(regr_slope(lu, lp), 5) as naive, round(sum(dp * du) / sum(dp * dp), 5) as within_sku, count(*) as n from x")
def naive_elasticity(spark: SparkSession, sf: str) -> DataFrame:
    """Elasticity across everything, and within products, where what sets their prices apart drops out."""
    w = sales(spark, sf).groupBy("sku", F.trunc("d", "quarter").alias("q")).agg(F.log(F.sum("units")).alias("lu"), F.log(F.sum("net_e4") / F.sum("units")).alias("lp"))
    by = Window.partitionBy("sku")
    x = w.withColumns({"du": F.col("lu") - F.avg("lu").over(by), "dp": F.col("lp") - F.avg("lp").over(by)})
    return x.agg(F.round(F.regr_slope("lu", "lp"), 5).alias("naive"), F.round(F.sum(F.col("dp") * F.col("du")) / F.sum(F.col("dp") * F.col("dp")), 5).alias("within_sku"), F.count(F.lit(1)).alias("n"))


@query("event_study_did", f"{FACTS}, g as (select shift, region = 'ASIA' as treated, d >= date '1998-01-01' + shift as post, sum(net_e4)::bigint as v, count(distinct d) as days from sales, (select unnest([-120, -60, 0, 60])::int as shift) where d between date '1998-01-01' + shift - 60 and date '1998-01-01' + shift + 59 group by all), m as (select shift, treated, post, v / days / 10000 as m from g) select shift, round(sum(case when treated then 1 else -0.25 end * case when post then m else -m end), 4) as did from m group by shift")
def event_study_did(spark: SparkSession, sf: str) -> DataFrame:
    """Difference in differences of daily means, against the other regions' mean, at the event and at placebo dates."""
    day = F.lit("1998-01-01").cast("date")
    s = sales(spark, sf).withColumn("shift", F.explode(F.array(*[F.lit(k) for k in (-120, -60, 0, 60)])))
    at = F.date_add(day, F.col("shift"))
    s = s.where(F.col("d").between(F.date_add(at, F.lit(-60)), F.date_add(at, F.lit(59))))
    g = s.groupBy("shift", (F.col("region") == "ASIA").alias("treated"), (F.col("d") >= at).alias("post")).agg((F.sum("net_e4") / F.count_distinct("d") / 10000).alias("m"))
    sign = F.when(F.col("treated"), 1.0).otherwise(-0.25) * F.when(F.col("post"), F.col("m")).otherwise(-F.col("m"))
    return g.groupBy("shift").agg(F.round(F.sum(sign), 4).alias("did"))


@query("interval_lag", f"{FACTS}, a as (select t, y from daily_events where series = 'purchase'), b as (select t, y from daily_events where series = 'click') select a.t, round(a.y, 2) as y, count(b.t) as n, round(sum(b.y), 2) as drivers from a left join b on b.t between a.t - 7 and a.t - 2 group by a.t, a.y")
def interval_lag(spark: SparkSession, sf: str) -> DataFrame:
    """A driver's sum over the days between its longest and shortest lag, from one window over both series."""
    e = daily_events(spark, sf).groupBy("t").agg(F.max(F.when(F.col("series") == "purchase", F.col("y"))).alias("y"), F.max(F.when(F.col("series") == "click", F.col("y"))).alias("x"))
    w = Window.orderBy("t").rangeBetween(-7, -2)
    return e.withColumns({"n": F.count("x").over(w), "drivers": F.sum("x").over(w)}).where("y is not null").select("t", F.round("y", 2).alias("y"), "n", F.round("drivers", 2).alias("drivers"))


@query("launch_curve", f"{FACTS}, f as (select sku, min(d) as f from sales group by 1), l as (select s.sku, date_diff('day', f, d) // 28 as period, sum(units)::bigint as u from sales s join f on s.sku = f.sku where date_diff('day', f, d) < 336 group by all), v as (select sku, max(case when period = 0 then u end) as first from l group by 1) select period, round(median(u), 4) as mid, round(quantile_cont(u, 0.1), 4) as low, round(quantile_cont(u, 0.9), 4) as high, round(median(u / first), 6) as velocity, count(*) as n from l join v using (sku) group by period")
def launch_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Products aligned on their first day: band and speed of the launch by period of four weeks."""
    s = sales(spark, sf)
    first = s.groupBy("sku").agg(F.min("d").alias("f"))
    day = F.datediff("d", "f")
    launched = s.join(first, "sku").where(day < 336).groupBy("sku", F.floor(day / 28).alias("period")).agg(F.sum("units").alias("u"))
    launched = launched.withColumn("first", F.max(F.when(F.col("period") == 0, F.col("u"))).over(Window.partitionBy("sku")))
    q = lambda x: F.round(F.expr(f"percentile(u, {x})"), 4)
    return launched.groupBy("period").agg(q(0.5).alias("mid"), q(0.1).alias("low"), q(0.9).alias("high"), F.round(F.median(F.col("u") / F.col("first")), 6).alias("velocity"), F.count(F.lit(1)).alias("n"))


@query("sparse_route", f"{FACTS} select sku, count(distinct d) as n_days, case when count(distinct d) < 28 then 'pooled' when count(distinct d) < 56 then 'weekly' else 'full' end as route from sales group by sku")
def sparse_route(spark: SparkSession, sf: str) -> DataFrame:
    n = F.count_distinct("d")
    return sales(spark, sf).groupBy("sku").agg(n.alias("n_days"), F.when(n < 28, "pooled").when(n < 56, "weekly").otherwise("full").alias("route"))


_MOVES = f"{FACTS}, m as (select region, date_trunc('month', d)::date as month, sum(net_e4)::bigint as v from sales group by all), c as (select region, month, v, avg(v) over w as base, stddev(v) over w as sd, count(*) over w as n from m window w as (partition by region order by month rows between 12 preceding and 1 preceding)), moves as (select region, month, round((v - base) / 10000, 6) as impact, round((v - base) / base, 8) as pct, round((v - base) / nullif(sd, 0), 6) as z from c where n = 12)"


def moves(spark: SparkSession, sf: str) -> DataFrame:
    """region, month, impact, pct, z of each month against the twelve before."""
    m = sales(spark, sf).groupBy("region", F.trunc("d", "month").alias("month")).agg(F.sum("net_e4").alias("v"))
    w = Window.partitionBy("region").orderBy("month").rowsBetween(-12, -1)
    c = m.withColumns({"base": F.avg("v").over(w), "sd": F.stddev("v").over(w), "n": F.count("v").over(w)}).where("n = 12")
    gap = F.col("v") - F.col("base")
    return c.select("region", "month", F.round(gap / 10000, 6).alias("impact"), F.round(gap / F.col("base"), 8).alias("pct"), F.round(gap / F.nullif(F.col("sd"), F.lit(0.0)), 6).alias("z"))


@query("materiality_gate", f"{_MOVES} select *, abs(z) >= 1.5 and abs(pct) >= 0.1 as material from moves")
def materiality_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Both statistically and commercially large."""
    return moves(spark, sf).withColumn("material", (F.abs("z") >= 1.5) & (F.abs("pct") >= 0.1))


@query("severity_gate", f"{_MOVES} select region, month, impact, case when abs(z) < 1.5 then 'log_only' when abs(pct) < 0.1 then 'below_floor' else 'investigate' end as verdict from moves")
def severity_gate(spark: SparkSession, sf: str) -> DataFrame:
    verdict = F.when(F.abs("z") < 1.5, "log_only").when(F.abs("pct") < 0.1, "below_floor").otherwise("investigate")
    return moves(spark, sf).select("region", "month", "impact", verdict.alias("verdict"))


@query("priority_rank", f"{_MOVES} select region, month, round(abs(impact) * 1.5, 3) as priority, dense_rank() over (order by round(abs(impact), 2) desc) as place, round(percent_rank() over (order by round(abs(impact), 2) desc, region, month), 8) as pct_rank from moves order by priority desc, region, month limit 25")
def priority_rank(spark: SparkSession, sf: str) -> DataFrame:
    """The feed: the first twenty-five by impact times the tier's weight."""
    size = F.round(F.abs("impact"), 2)
    m = moves(spark, sf).withColumns({"place": F.dense_rank().over(Window.orderBy(size.desc())).cast("long"), "pct_rank": F.round(F.percent_rank().over(Window.orderBy(size.desc(), "region", "month")), 8)})
    return m.select("region", "month", F.round(F.abs("impact") * 1.5, 3).alias("priority"), "place", "pct_rank").orderBy(F.desc("priority"), "region", "month").limit(25)


@query("coverage", _adtributor_sql([(d,) for d in DIMS]) + " select dims, round(sum(ep), 6) as explained, least(1.0, greatest(0.0, round(sum(ep), 6))) as coverage from adtributor group by dims")
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    c = adtributor_1d(spark, sf).groupBy("dims").agg(F.round(F.sum("ep"), 6).alias("explained"))
    return c.withColumn("coverage", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("explained"))))


@query("mahalanobis")
def mahalanobis(spark: SparkSession, sf: str) -> DataFrame:
    """Joint distance of a day's clicks, views and signups from the month's robust centre."""
    pick = lambda s, n: F.max(F.when(F.col("series") == s, F.col("y"))).alias(n)
    w = daily_events(spark, sf).groupBy("d").agg(pick("click", "a"), pick("view", "b"), pick("signup", "c")).na.drop().withColumn("month", F.trunc("d", "month"))
    return w.groupBy("month").applyInPandas(stats.mahalanobis, "month date, d date, distance double")


@query("feedback_rollup", "select event_type as verdict, user_id % 5 as kpi, count(*) as n, round(count(*) / sum(count(*)) over (partition by user_id % 5), 8) as share from events group by event_type, user_id % 5")
def feedback_rollup(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "events").groupBy(F.col("event_type").alias("verdict"), (F.col("user_id") % 5).alias("kpi")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("kpi")), 8))


@query("driver_agreement")
def driver_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """What weekly revenue of a region follows: price, discount and breadth of the range, by two estimators that must agree."""
    week = F.floor(F.datediff("d", F.lit("1995-01-02").cast("date")) / 7).cast("int")
    w = sales(spark, sf).groupBy("region", week.alias("t")).agg(
        F.log(F.sum("units") + 1.0).alias("y"), F.log(F.sum("net_e4") / 10000.0 / F.greatest(F.sum("units"), F.lit(1)) + 1).alias("price"), (F.avg("discount_e4") / 10000.0).alias("discount"), F.log(F.count_distinct("sku") + 1.0).alias("breadth")
    )
    return w.groupBy("region").applyInPandas(stats.drivers, "region string, driver string, beta double, hac_se double, gls_beta double, rho double, vif double, agree boolean, collinear boolean")


@query("count_bands", f"{FACTS}, c as (select category, d, count(*) as n from sales group by all), m as (select category, avg(n) as mean, var_samp(n) as v from c group by 1) select c.category, round(mean, 6) as mean, any_value(v) > 1.2 * mean as overdispersed, round(greatest(0.0, mean - 1.96 * sqrt(case when any_value(v) > 1.2 * mean then any_value(v) else mean end)), 4) as low, round(mean + 1.96 * sqrt(case when any_value(v) > 1.2 * mean then any_value(v) else mean end), 4) as high, count(*) filter (n > mean + 1.96 * sqrt(case when v > 1.2 * mean then v else mean end)) as above from c join m on c.category = m.category group by c.category, mean")
def count_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Bands of daily counts: Poisson, or negative binomial where counts vary more than that allows; no logarithm."""
    c = sales(spark, sf).groupBy("category", "d").agg(F.count(F.lit(1)).alias("n"))
    m = c.groupBy("category").agg(F.avg("n").alias("mean"), F.var_samp("n").alias("v"))
    m = m.withColumn("over", F.col("v") > 1.2 * F.col("mean")).withColumn("half", 1.96 * F.sqrt(F.when(F.col("over"), F.col("v")).otherwise(F.col("mean"))))
    out = c.join(m, "category").groupBy("category", "mean", "over", "half").agg(F.count_if(F.col("n") > F.col("mean") + F.col("half")).alias("above"))
    low = F.greatest(F.lit(0.0), F.col("mean") - F.col("half"))
    return out.select("category", F.round("mean", 6).alias("mean"), F.col("over").alias("overdispersed"), F.round(low, 4).alias("low"), F.round(F.col("mean") + F.col("half"), 4).alias("high"), "above")
