"""Detection on time series: scales, recurrences in closed form, conformal p-values, false-discovery control.

Everything here is a window or an aggregation by series, so one exchange by series serves a whole scan. Recurrences
are closed forms over running sums and minima, not loops over rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tidemark.registry import query
from tidemark.session import written
from tidemark.sources.tables import FACTS, daily_events, daily_sales, sales, table


def by_series() -> WindowSpec:
    return Window.partitionBy("series")


def ordered() -> WindowSpec:
    return by_series().orderBy("t")


def past() -> WindowSpec:
    return ordered().rowsBetween(Window.unboundedPreceding, -1)


def upto() -> WindowSpec:
    return ordered().rowsBetween(Window.unboundedPreceding, 0)


#: z-scores by series, as the following queries' SQL begins.
_Z = f"{FACTS}, z as (select series, t, d, y, (y - avg(y) over (partition by series)) / stddev(y) over (partition by series) as z from daily_events)"


def z_scores(series: DataFrame) -> DataFrame:
    return series.withColumn("z", (F.col("y") - F.avg("y").over(by_series())) / F.stddev("y").over(by_series()))


def with_cusum(df: DataFrame, z: str = "z", k: float = 0.5) -> DataFrame:
    """``df`` with c_plus and c_minus, by series in the order of t."""
    out = df.withColumns({"__p": F.sum(F.col(z) - k).over(upto()), "__m": F.sum(-F.col(z) - k).over(upto())})
    return out.withColumns({"c_plus": F.col("__p") - F.least(F.lit(0.0), F.min("__p").over(upto())), "c_minus": F.col("__m") - F.least(F.lit(0.0), F.min("__m").over(upto()))}).drop("__p", "__m")


@query("cusum", f"{_Z}, s as (select *, sum(z - 0.5) over w as p, sum(-z - 0.5) over w as m from z window w as (partition by series order by t)) select series, t, round(p - least(0, min(p) over w), 6) + 0 as c_plus, round(m - least(0, min(m) over w), 6) + 0 as c_minus from s window w as (partition by series order by t)")
def cusum_query(spark: SparkSession, sf: str) -> DataFrame:
    c = with_cusum(z_scores(daily_events(spark, sf)))
    return c.select("series", "t", (F.round("c_plus", 6) + 0).alias("c_plus"), (F.round("c_minus", 6) + 0).alias("c_minus"))


def with_ar1(df: DataFrame, y: str = "y") -> DataFrame:
    """``df`` with phi, the slope of y on its lag, and e, the one-step innovation of the centred series."""
    r = df.withColumn("__r", F.col(y) - F.avg(y).over(by_series())).withColumn("__l", F.lag("__r").over(ordered()))
    r = r.withColumn("phi", F.regr_slope("__r", "__l").over(by_series()))
    return r.withColumn("e", F.col("__r") - F.col("phi") * F.col("__l")).drop("__r", "__l")


@query("ar1_innov", f"{FACTS}, r as (select series, t, y - avg(y) over (partition by series) as r from daily_events), l as (select *, lag(r) over (partition by series order by t) as l from r) select series, t, round(regr_slope(r, l) over (partition by series), 6) as phi, round(r - regr_slope(r, l) over (partition by series) * l, 4) as e from l")
def ar1_innov(spark: SparkSession, sf: str) -> DataFrame:
    return with_ar1(daily_events(spark, sf)).select("series", "t", F.round("phi", 6).alias("phi"), F.round("e", 4).alias("e"))


#: Days of a block of a decayed sum, and the share of a value that is left when it no longer counts.
BLOCK, NOTHING = 128, 1e-17


def decayed_sum(df: DataFrame, x: str, decay: float, out: str, strict: bool = False) -> DataFrame:
    """``df`` with ``out``: the sum of decay^(t - u) x_u over u up to t (before t, if strict), by series.

    Weights are taken from the beginning of each block, so no power grows with t; the totals of as many blocks before are
    carried in as hold values of which more than NOTHING is left. ``decay`` lies between 0 and 1.
    """
    if not 0 < decay < 1:
        raise ValueError(f"a decay of {decay} doesn't fade")
    blocks = math.ceil(math.log(NOTHING) / math.log(decay) / BLOCK) + 1
    own = Window.partitionBy("series", "__b").orderBy("t").rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    before = lambda m: F.sum("__x").over(by_series().orderBy("__b").rangeBetween(-m, -m))
    b = df.withColumn("__b", F.floor(F.col("t") / BLOCK)).withColumn("__x", F.col(x) * F.pow(F.lit(decay), -(F.col("t") - F.col("__b") * BLOCK)))
    carried = sum((F.coalesce(before(m), F.lit(0.0)) * decay ** (m * BLOCK) for m in range(1, blocks + 1)), F.lit(0.0))
    b = b.withColumns({"__own": F.coalesce(F.sum("__x").over(own), F.lit(0.0)), "__far": carried})
    return b.withColumn(out, (F.col("__own") + F.col("__far")) * F.pow(F.lit(decay), F.col("t") - F.col("__b") * BLOCK)).drop("__b", "__x", "__own", "__far")


#: A scale is no less than this share of the series' MAD.
FLOOR = 0.25


@query("ewma_scale", f"{_Z}, m as (select series, 1.4826 * median(abs(z)) as mad from z group by 1), s as (select a.series, a.t, sum(0.06 * b.z * b.z * pow(0.94, a.t - 1 - b.t)) as v from z a left join z b on a.series = b.series and b.t < a.t group by a.series, a.t) select s.series, t, round(greatest(sqrt(coalesce(v, 0)), {FLOOR} * mad), 6) as sigma from s join m using (series)")
def ewma_scale(spark: SparkSession, sf: str) -> DataFrame:
    """sigma_t^2 = .94 sigma_{t-1}^2 + .06 e_{t-1}^2 over the strict past, and never below a share of the MAD."""
    z = z_scores(daily_events(spark, sf)).withColumn("e2", 0.06 * F.col("z") * F.col("z") / 0.94)
    mad = z.groupBy("series").agg((1.4826 * F.median(F.abs("z"))).alias("mad"))
    s = decayed_sum(z, "e2", 0.94, "v", strict=True).join(mad, "series")
    return s.select("series", "t", F.round(F.greatest(F.sqrt("v"), FLOOR * F.col("mad")), 6).alias("sigma"))


@query("adstock", f"{FACTS} select a.series, a.t, round(sum(b.y * pow(0.5, (a.t - b.t) / 3.0)), 4) as adstock from daily_events a join daily_events b on a.series = b.series and b.t <= a.t group by a.series, a.t")
def adstock(spark: SparkSession, sf: str) -> DataFrame:
    """Geometric carry-over with a half-life of three days."""
    return decayed_sum(daily_events(spark, sf), "y", 0.5 ** (1 / 3), "adstock").select("series", "t", F.round("adstock", 4).alias("adstock"))


@query("robust_mad", f"{FACTS}, m as (select series, isodow(d) as dow, median(y) as m from daily_events group by all) select series, dow, round(m, 6) as med, round(median(abs(y - m)) * 1.4826, 6) as mad from daily_events join m using (series) where isodow(d) = dow group by series, dow, m")
def robust_mad(spark: SparkSession, sf: str) -> DataFrame:
    """Median and MAD by series and weekday: the floor of a scale."""
    e = daily_events(spark, sf).withColumn("dow", (F.weekday("d") + 1).cast("long"))
    m = e.groupBy("series", "dow").agg(F.median("y").alias("m"))
    return e.join(m, ["series", "dow"]).groupBy("series", "dow", "m").agg((F.median(F.abs(F.col("y") - F.col("m"))) * 1.4826).alias("mad")).select("series", "dow", F.round("m", 6).alias("med"), F.round("mad", 6).alias("mad"))


#: Days that a p-value is taken from, and MADs from the median beyond which a day is no clean one.
CLEAN, FAR = 250, 3


def with_conformal(df: DataFrame, score: str = "s", clean: str = "clean", window: int = CLEAN) -> DataFrame:
    """``df`` with n_cal and p = (1 + #{past scores at least as large}) / (n + 1), over the last ``window`` clean rows before.

    ``clean`` says which rows may calibrate others: anomalies stay out, so one doesn't hide the next.
    """
    counted = df.withColumn("__c", F.coalesce(F.count(F.when(F.col(clean), 1)).over(past()), F.lit(0)))  # clean rows before this one
    last = by_series().orderBy("__c").rangeBetween(-window, -1)
    out = counted.withColumn("__past", F.collect_list(F.when(F.col(clean), F.col(score))).over(last)).withColumn("n_cal", F.size("__past"))
    return out.withColumn("p", (1 + F.size(F.filter("__past", lambda x: x >= F.col(score)))) / (F.col("n_cal") + 1)).drop("__past", "__c")


def with_clean(df: DataFrame, y: str = "y") -> DataFrame:
    """``df`` with clean: whether a row lies within ``FAR`` MADs of its series' median."""
    m = df.groupBy("series").agg(F.median(y).alias("__m"))
    d = df.join(m, "series").withColumn("__d", F.round(F.abs(F.col(y) - F.col("__m")), 6))
    mad = d.groupBy("series").agg(F.round(F.median("__d") * 1.4826 * FAR, 6).alias("__l"))
    return d.join(mad, "series").withColumn("clean", F.col("__d") <= F.col("__l")).drop("__m", "__d", "__l")


_P = f"""{_Z}, md as (select series, median(y) as m from daily_events group by 1), dv as (select series, t, round(abs(y - m), 6) as dv from daily_events join md using (series)), li as (select series, round(median(dv) * 1.4826 * {FAR}, 6) as l from dv group by 1),
  s as (select series, t, d, round(abs(z), 9) as s, dv <= l as clean from z join dv using (series, t) join li using (series)), cc as (select *, count(*) filter (clean) over (partition by series order by t rows between unbounded preceding and 1 preceding) as c from s),
  p as (select a.series, a.t, count(b.s) as n_cal, round((1 + count(*) filter (b.s >= a.s)) / (count(b.s) + 1), 8) as p from cc a left join cc b on a.series = b.series and b.clean and b.c between a.c - {CLEAN} and a.c - 1 group by a.series, a.t, a.s)"""


@query("conformal_p", f"{_P} select * from p")
def conformal_p(spark: SparkSession, sf: str) -> DataFrame:
    z = with_clean(z_scores(daily_events(spark, sf))).withColumn("s", F.round(F.abs("z"), 9))
    return with_conformal(z).select("series", "t", F.col("n_cal").cast("long").alias("n_cal"), F.round("p", 8).alias("p"))


def bh_reject(df: DataFrame, p: str, by: list[str], order: list[str], q: float = 0.05) -> DataFrame:
    """``df`` with reject: whether p is among the k smallest of its scan, k the largest with p_k <= q k / m."""
    w = Window.partitionBy(*by)
    ranked = df.withColumns({"__k": F.row_number().over(w.orderBy(p, *order)), "__n": F.count(F.lit(1)).over(w)})
    passing = F.max(F.when(F.col(p) <= q * F.col("__k") / F.col("__n"), F.col("__k"))).over(w)
    return ranked.withColumn("__top", F.coalesce(passing, F.lit(0))).withColumn("reject", F.col("__k") <= F.col("__top")).drop("__k", "__n", "__top")


@query("bh_fdr", f"{_P}, r as (select series, t, p, row_number() over (partition by t order by p, series) as k, count(*) over (partition by t) as m from p) select series, t, p, k <= coalesce(max(case when p <= 0.2 * k / m then k end) over (partition by t), 0) as reject from r")
def bh_fdr(spark: SparkSession, sf: str) -> DataFrame:
    p = conformal_p(spark, sf).drop("n_cal")
    return bh_reject(p, "p", ["t"], ["series"], 0.2)


@query("persistence_islands", f"{FACTS}, m as (select region, d, sum(net_e4)::bigint as v from sales group by all), f as (select region, d, v > avg(v) over (partition by region) as up from m), g as (select region, d, date_diff('day', date '1990-01-01', d) - row_number() over (partition by region order by d) as g from f where up) select region, min(d) as first_day, max(d) as last_day, count(*) as days from g group by region, g having count(*) >= 3")
def persistence_islands(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of three or more days in a row above the mean."""
    m = sales(spark, sf).groupBy("region", "d").agg(F.sum("net_e4").alias("v"))
    up = m.withColumn("up", F.col("v") > F.avg("v").over(Window.partitionBy("region"))).where("up")
    island = F.datediff("d", F.lit("1990-01-01").cast("date")) - F.row_number().over(Window.partitionBy("region").orderBy("d"))
    return up.withColumn("g", island).groupBy("region", "g").agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.count(F.lit(1)).alias("days")).where("days >= 3").drop("g")


@query("trailing_8w", f"{FACTS}, w as (select region, date_trunc('week', d)::date as wk, sum(units)::bigint as units from sales group by all) select region, wk, units, round(avg(units) over w, 6) as base, count(*) over w as n from w window w as (partition by region order by wk rows between 8 preceding and 1 preceding)")
def trailing_8w(spark: SparkSession, sf: str) -> DataFrame:
    w = sales(spark, sf).groupBy("region", F.trunc("d", "week").alias("wk")).agg(F.sum("units").alias("units"))
    frame = Window.partitionBy("region").orderBy("wk").rowsBetween(-8, -1)
    return w.select("region", "wk", "units", F.round(F.avg("units").over(frame), 6).alias("base"), F.count(F.lit(1)).over(frame).alias("n"))


@query("range_frame", f"{FACTS}, m as (select region, d, sum(units)::bigint as units from sales group by all) select region, d, sum(units) over (partition by region order by d range between interval 13 days preceding and current row)::bigint as last_14_days from m")
def range_frame(spark: SparkSession, sf: str) -> DataFrame:
    m = sales(spark, sf).groupBy("region", "d").agg(F.sum("units").alias("units")).withColumn("n", F.unix_date("d"))
    return m.select("region", "d", F.sum("units").over(Window.partitionBy("region").orderBy("n").rangeBetween(-13, 0)).alias("last_14_days"))


@query("stl_classical", f"{FACTS}, tr as (select series, t, d, y, avg(y) over w as trend, count(*) over w as n from daily_events window w as (partition by series order by t rows between 3 preceding and 3 following)), k as (select * from tr where n = 7), se as (select series, isodow(d) as dow, avg(y - trend) as s from k group by all), c as (select series, avg(s) as m from se group by 1) select k.series, t, round(trend, 6) as trend, round(s - m, 6) as seasonal, round(y - trend - (s - m), 6) as remainder from k join se on k.series = se.series and isodow(k.d) = dow join c on c.series = k.series")
def stl_classical(spark: SparkSession, sf: str) -> DataFrame:
    """Centred moving average, weekday index, remainder."""
    frame = ordered().rowsBetween(-3, 3)
    k = daily_events(spark, sf).withColumns({"trend": F.avg("y").over(frame), "n": F.count("y").over(frame), "dow": F.weekday("d")}).where("n = 7")
    se = k.groupBy("series", "dow").agg(F.avg(F.col("y") - F.col("trend")).alias("s"))
    se = se.withColumn("seasonal", F.col("s") - F.avg("s").over(by_series())).drop("s")
    out = k.join(se, ["series", "dow"])
    return out.select("series", "t", F.round("trend", 6).alias("trend"), F.round("seasonal", 6).alias("seasonal"), F.round(F.col("y") - F.col("trend") - F.col("seasonal"), 6).alias("remainder"))


@query("changepoint", f"{FACTS}, s as (select series, t, d, sum(y - m) over (partition by series order by t) as c, m from (select *, avg(y) over (partition by series) as m from daily_events)) select series, arg_max(d, (round(abs(c), 6), -t)) as changepoint_date, round(max(abs(c)), 4) as deviation from s group by series")
def changepoint(spark: SparkSession, sf: str) -> DataFrame:
    """Where the running deviation from the mean is largest: the level's most likely shift."""
    s = daily_events(spark, sf).withColumn("x", F.col("y") - F.avg("y").over(by_series())).withColumn("c", F.sum("x").over(upto()))
    return s.groupBy("series").agg(F.max_by("d", F.struct(F.round(F.abs("c"), 6), -F.col("t"))).alias("changepoint_date"), F.round(F.max(F.abs("c")), 4).alias("deviation"))


@query("acf_lags", f"{FACTS}, c as (select series, t, y - avg(y) over (partition by series) as x from daily_events), l as (select a.series, k, sum(a.x * b.x) as num from c a join (select unnest(range(1, 11))::int as k) on true join c b on a.series = b.series and b.t = a.t - k group by all) select l.series, k, round(num / v, 6) as acf from l join (select series, sum(x * x) as v from c group by 1) v using (series)")
def acf_lags(spark: SparkSession, sf: str) -> DataFrame:
    """Autocorrelation at lags 1 to 10, from lags side by side in one pass."""
    c = daily_events(spark, sf).withColumn("x", F.col("y") - F.avg("y").over(by_series()))
    lagged = c.select("series", "x", *[F.lag("x", k).over(ordered()).alias(f"l{k}") for k in range(1, 11)])
    sums = lagged.groupBy("series").agg(F.sum(F.col("x") * F.col("x")).alias("v"), *[F.sum(F.col("x") * F.col(f"l{k}")).alias(f"c{k}") for k in range(1, 11)])
    return sums.select("series", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.round(F.col(f"c{k}") / F.col("v"), 6).alias("acf")) for k in range(1, 11)])).alias("a")).select("series", "a.k", "a.acf")


@query("fourier_terms", "select d, round(sin(2 * pi() * n / 365.25), 8) + 0 as s1, round(cos(2 * pi() * n / 365.25), 8) + 0 as c1, round(sin(4 * pi() * n / 365.25), 8) + 0 as s2, round(cos(4 * pi() * n / 365.25), 8) + 0 as c2 from (select d, date_diff('day', date '1995-01-01', d) as n from (select distinct cast(o_orderdate as date) as d from orders))")
def fourier_terms(spark: SparkSession, sf: str) -> DataFrame:
    n = F.datediff("d", F.lit("1995-01-01").cast("date"))
    d = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return d.select("d", *[(F.round(f(2 * k * math.pi * n / 365.25), 8) + 0).alias(f"{name}{k}") for k in (1, 2) for name, f in (("s", F.sin), ("c", F.cos))])


@query("periodogram", f"{FACTS}, c as (select series, t, y - avg(y) over (partition by series) as x, count(*) over (partition by series) as n from daily_events), f as (select series, k, sum(x * cos(2 * pi() * k * t / n)) as a, sum(x * sin(2 * pi() * k * t / n)) as b, max(n) as n from c, (select unnest(range(1, 16))::int as k) group by all) select series, k, round((a * a + b * b) / n, 3) as power from f")
def periodogram(spark: SparkSession, sf: str) -> DataFrame:
    """Power at each whole frequency, all frequencies of a series in one pass over its rows."""
    c = daily_events(spark, sf).withColumns({"x": F.col("y") - F.avg("y").over(by_series()), "n": F.count("y").over(by_series())})
    angle = lambda k: 2 * math.pi * k * F.col("t") / F.col("n")
    sums = c.groupBy("series").agg(F.max("n").alias("n"), *[g for k in range(1, 16) for g in (F.sum(F.col("x") * F.cos(angle(k))).alias(f"a{k}"), F.sum(F.col("x") * F.sin(angle(k))).alias(f"b{k}"))])
    power = [F.struct(F.lit(k).alias("k"), F.round((F.col(f"a{k}") * F.col(f"a{k}") + F.col(f"b{k}") * F.col(f"b{k}")) / F.col("n"), 3).alias("power")) for k in range(1, 16)]
    return sums.select("series", F.explode(F.array(*power)).alias("p")).select("series", "p.k", "p.power")


@query("intermittency", f"{FACTS}, s as (select sku, count(distinct d) as active from sales group by 1), l as (select date_diff('day', min(d), max(d)) + 1 as days from sales) select sku, round(1 - active / days, 8) as zero_fraction, 1 - active / days > 0.4 as intermittent from s, l")
def intermittency(spark: SparkSession, sf: str) -> DataFrame:
    """Share of days, from the first to the last on which anything was sold, without a sale."""
    s = sales(spark, sf)
    days = s.agg((F.datediff(F.max("d"), F.min("d")) + 1).alias("days"))  # one row
    active = s.groupBy("sku").agg(F.count_distinct("d").alias("active")).crossJoin(days)
    none = 1 - F.col("active") / F.col("days")
    return active.select("sku", F.round(none, 8).alias("zero_fraction"), (none > 0.4).alias("intermittent"))


@query("realism_cv", f"{FACTS}, m as (select avg(y) as m, stddev_pop(y) as s from daily_sales) select round(max(s) / max(m), 6) as cv, round(avg(pow((y - m) / s, 3)), 4) as skew from daily_sales, m")
def realism_cv(spark: SparkSession, sf: str) -> DataFrame:
    d = daily_sales(spark, sf)
    return d.agg(F.round(F.stddev_pop("y") / F.avg("y"), 6).alias("cv"), F.round(F.skewness("y"), 4).alias("skew"))


@query("benford", "select digit, n, round(n / sum(n) over (), 8) as share, round(log10(1 + 1.0 / digit), 8) as expected from (select substr(cast(cast(round(o_totalprice * 100) as bigint) as varchar), 1, 1)::int as digit, count(*) as n from orders where o_totalprice > 0 group by 1)")
def benford(spark: SparkSession, sf: str) -> DataFrame:
    digit = F.substring(F.round(F.col("o_totalprice") * 100).cast("long").cast("string"), 1, 1).cast("int")
    g = table(spark, sf, "orders").where("o_totalprice > 0").groupBy(digit.alias("digit")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("digit", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 8).alias("share"), F.round(F.log10(1 + 1 / F.col("digit")), 8).alias("expected"))


@query("ks_uniform", f"{_P}, r as (select series, p, row_number() over (partition by series order by p, t) as k, count(*) over (partition by series) as n from p where t >= 10) select series, round(max(greatest(k / n - p, p - (k - 1) / n)), 8) as ks from r group by series")
def ks_uniform(spark: SparkSession, sf: str) -> DataFrame:
    """Largest gap between the p-values' distribution and the uniform one."""
    p = conformal_p(spark, sf).where("t >= 10")
    r = p.withColumns({"k": F.row_number().over(by_series().orderBy("p", "t")), "n": F.count(F.lit(1)).over(by_series())})
    return r.groupBy("series").agg(F.round(F.max(F.greatest(F.col("k") / F.col("n") - F.col("p"), F.col("p") - (F.col("k") - 1) / F.col("n"))), 8).alias("ks"))


@query("psi_drift", "with b as (select value, ntile(10) over (order by value, event_id) as decile from events where cast(ts as date) < date '2024-01-16'), e as (select decile, max(value) as top from b group by 1), c as (select event_type, (select count(*) + 1 from e where e.top < events.value and decile < 10) as decile from events where cast(ts as date) >= date '2024-01-16'), s as (select event_type, decile, count(*) as n from c group by event_type, decile), tot as (select event_type, count(*) as total from c group by event_type), a as (select tot.event_type, d.decile, greatest(coalesce(n / total, 0), 0.0001) as share from tot cross join (select unnest(range(1, 11)) as decile) d left join s on s.event_type = tot.event_type and s.decile = d.decile) select event_type, round(sum((share - 0.1) * ln(share / 0.1)), 6) as psi from a group by 1")
def psi_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Shift of each type's values over the deciles of the reference period."""
    e = table(spark, sf, "events").withColumn("late", F.to_date("ts") >= F.lit("2024-01-16").cast("date"))
    bounds = tile_tops(e.where("not late").select("value"), "value", 10).where("tile < 10").agg(F.array_sort(F.collect_list("top")).alias("tops"))  # nine numbers
    c = e.where("late").crossJoin(F.broadcast(bounds)).withColumn("decile", F.size(F.filter("tops", lambda x: x < F.col("value"))) + 1)
    counts = c.groupBy("event_type").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("decile") == k).alias(f"n{k}") for k in range(1, 11)])
    share = lambda k: F.greatest(F.col(f"n{k}") / F.col("total"), F.lit(0.0001))
    total = sum(((share(k) - 0.1) * F.log(share(k) / 0.1) for k in range(1, 11)), F.lit(0.0))
    return counts.select("event_type", F.round(total, 6).alias("psi"))


def tile_tops(df: DataFrame, value: str, tiles: int, pieces: int = 4096) -> DataFrame:
    """tile, top: the greatest value of each of ``tiles`` runs of equal numbers of rows in the order of ``value``.

    Exact, without a sort of all rows in one task: equal values are counted, values fall into pieces of the range between
    the least and the greatest, whose counts are few, and only within the pieces that hold a top are values ordered.
    """
    v = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("rows"))  # one row
    piece = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (pieces - 1))).otherwise(0)
    v = written(v.crossJoin(F.broadcast(ends)).withColumn("piece", piece), "counted-values")
    by_piece = v.groupBy("piece", "rows").agg(F.sum("n").alias("m"))
    by_piece = by_piece.withColumn("upto", F.sum("m").over(Window.partitionBy("rows").orderBy("piece")))  # a row a piece at most
    k = F.explode(F.sequence(F.lit(1), F.lit(tiles)))
    goal = F.col("tile") * F.floor(F.col("rows") / tiles) + F.least(F.col("tile"), F.col("rows") % tiles)
    held = by_piece.withColumn("tile", k).withColumn("goal", goal).where("goal > upto - m and goal <= upto").select("piece", "tile", "goal", (F.col("upto") - F.col("m")).alias("below"))
    upto = F.sum("n").over(Window.partitionBy("piece").orderBy("v"))
    inside = v.join(held.select("piece").distinct(), "piece", "left_semi").withColumn("upto", upto)
    return inside.join(held, "piece").where("goal - below > upto - n and goal - below <= upto").select("tile", F.col("v").alias("top"))


@query("whiten")
def whiten(spark: SparkSession, sf: str) -> DataFrame:
    """One-step innovations of each series, of the shortest memory up to seven days that leaves no correlation."""
    from tidemark.functions import stats

    return daily_events(spark, sf).groupBy("series").applyInPandas(stats.whiten, "series string, t int, p int, ljung_box double, e double")
