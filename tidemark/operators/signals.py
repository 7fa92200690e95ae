"""Six signals of every monthly movement, from detection, attribution, estimation, data, evidence and narrative.

All come from one cube of sales by month, region, category and segment, from the fulfilment feed and from documents;
none is drawn. Money is summed in whole ten-thousandths, so gaps are exact: a month's gap is twelve times its value
less the sum of the twelve months before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.rng import uniform, uniform_sql
from tidemark.operators.evidence import numbers, numbers_sql, unmatched, unmatched_sql
from tidemark.session import work_dir, written
from tidemark.sources.tables import FACTS, fulfilment, sales, table

SIGNALS = tuple(f"c{k}" for k in range(1, 7))
ALPHA = 0.05
#: Draws of the bootstrap, and past movements that a p-value is taken from.
DRAWS, PAST = 40, 250
#: A month's axis: months since the start of this year. Documents are spread over so many of them.
ORIGIN, MONTHS = 1995, 80
_CELL = ("region", "category", "segment")


def month_index(d: Column) -> Column:
    return (F.year(d) - ORIGIN) * 12 + F.month(d) - 1


def monthly_cube(spark: SparkSession, sf: str) -> DataFrame:
    """region, category, segment, k (month), v, units, days (a bit for each day with sales): one row for each cell of the axes."""
    s = sales(spark, sf).groupBy(*_CELL, month_index(F.col("d")).alias("k")).agg(F.sum("net_e4").alias("v"), F.sum("units").alias("units"), F.bit_or(F.call_function("shiftleft", F.lit(1), F.day("d") - 1)).alias("days"))
    s = written(s, "monthly-cube")
    axes = s.select(*_CELL).distinct().crossJoin(s.select("k").distinct())  # few cells, few months
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("v", "units", "days")}
    return axes.join(s, [*_CELL, "k"], "left").withColumns(zero)


def _gap(cube: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, k, v, gap: twelve times the value less the twelve months before; months without twelve before are left out."""
    w = Window.partitionBy(*keys).orderBy("k").rangeBetween(-12, -1)
    g = cube.groupBy(*keys, "k").agg(F.sum("v").alias("v"))
    return g.withColumns({"before": F.sum("v").over(w), "n": F.count("v").over(w)}).where("n = 12").select(*keys, "k", "v", "before", (12 * F.col("v") - F.col("before")).alias("gap"))


def _detection(moves: DataFrame) -> DataFrame:
    """p, c1: how rare the movement is among the region's earlier ones."""
    past = F.collect_list("s").over(Window.partitionBy("region").orderBy("k").rowsBetween(-PAST, -1))
    p = (1 + F.size(F.filter("past", lambda x: x >= F.col("s")))) / (F.size("past") + 1)
    out = moves.withColumn("past", past).withColumn("p", F.round(p, 8)).drop("past")
    return out.withColumn("c1", F.round(F.greatest(F.lit(0.0), 1 - F.col("p") / ALPHA), 6))


def _attribution(cube: DataFrame) -> DataFrame:
    """region, k, win, coverage, c2: how often the leading category leads when its cells are weighted anew, and how much three explain."""
    cells = _gap(cube, _CELL)
    share = cells.groupBy("region", "k", "category").agg(F.sum("gap").alias("gap"))
    total = Window.partitionBy("region", "k")
    share = share.withColumn("total", F.sum("gap").over(total)).withColumn("ep", F.col("gap") / F.nullif(F.col("total"), F.lit(0)))
    share = share.withColumn("rk", F.row_number().over(total.orderBy(F.desc("ep"), "category")))
    lead = share.groupBy("region", "k").agg(F.max(F.when(F.col("rk") == 1, F.col("category"))).alias("lead"), F.max(F.signum("total")).alias("sign"), F.sum(F.when(F.col("rk") <= 3, F.col("ep"))).alias("explained"))
    drawn = cells.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))))
    weight = F.floor(-F.log(1 - uniform("win", "draw", *_CELL, "k")) * 1000000).cast("decimal(20,0)")
    money = F.floor(F.col("gap") / 120000.0).cast("decimal(18,0)")
    won = drawn.groupBy("region", "k", "draw", "category").agg(F.sum(weight * money).alias("w")).join(lead, ["region", "k"])
    first = won.groupBy("region", "k", "draw", "lead").agg(F.max_by("category", F.struct((F.col("w") * F.col("sign").cast("int")).alias("w"), F.col("category").alias("c"))).alias("first"))
    win = first.groupBy("region", "k").agg(F.round(F.count_if(F.col("first") == F.col("lead")) / DRAWS, 6).alias("win"))
    out = win.join(lead, ["region", "k"]).withColumn("coverage", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("explained", F.lit(0.0)))), 6))
    return out.select("region", "k", "win", "coverage", "lead", F.round(F.col("win") * F.col("coverage"), 9).alias("c2"))


def _data(spark: SparkSession, sf: str, cube: DataFrame) -> DataFrame:
    """region, k, complete, reconciled, c4: days with data, and whether sales and fulfilment agree on the month's units."""
    days = cube.groupBy("region", "k").agg(F.bit_count(F.bit_or("days")).alias("days"))
    last = F.day(F.last_day(F.make_date(F.floor(F.col("k") / 12).cast("int") + ORIGIN, (F.col("k") % 12 + 1).cast("int"), F.lit(1))))
    ordered = fulfilment(spark, sf).groupBy(month_index(F.col("d")).alias("k")).agg(F.sum("ordered").alias("ordered"))
    sold = cube.groupBy("k").agg(F.sum("units").alias("units"))
    agree = sold.join(ordered, "k", "left").select("k", F.coalesce(F.abs(F.col("ordered") - F.col("units")) <= 0.05 * F.col("units"), F.lit(False)).alias("reconciled"))
    out = days.withColumn("complete", F.round(F.col("days") / last, 6)).join(agree, "k")
    return out.select("region", "k", "complete", "reconciled", F.when(F.col("reconciled"), F.col("complete")).otherwise(0.0).alias("c4"))


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    """region, k, stories, c5: what independent sources say in a month, each once and with its fullest story, times how dense
    stories are in that month against the year before. A month without stories has no row.

    Documents carry neither region nor day; draws keyed by their ids place them, as a corpus with such fields would be.
    """
    p = F.round(0.05 + 0.15 * F.least(F.lit(1.0), F.coalesce("n_chars", F.lit(0)) / 2000.0), 6)
    place = (F.floor(5 * uniform("region", "doc_id")).alias("r_regionkey"), F.floor(MONTHS * uniform("month", "doc_id")).cast("int").alias("k"))
    d = table(spark, sf, "documents").select(*place, F.coalesce("source", F.lit("")).alias("source"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("story"), p.alias("p"))
    told = written(d.groupBy("r_regionkey", "k", "source", "story").agg(F.max("p").alias("p")), "stories")
    stories = told.groupBy("r_regionkey", "k").agg(F.count_distinct("story").alias("stories"))
    sources = told.groupBy("r_regionkey", "k", "source").agg(F.max("p").alias("p")).groupBy("r_regionkey", "k").agg((1 - F.exp(F.sum(F.log(1 - F.col("p"))))).alias("any_of"))
    usual = F.avg("stories").over(Window.partitionBy("r_regionkey").orderBy("k").rangeBetween(-12, -1))
    g = sources.join(stories, ["r_regionkey", "k"]).withColumn("density", F.least(F.lit(1.0), F.col("stories") / F.coalesce(usual, F.col("stories"))))
    c5 = F.round(F.col("any_of") * F.col("density"), 6)
    return g.join(table(spark, sf, "region"), "r_regionkey").select(F.col("r_name").alias("region"), "k", "stories", c5.alias("c5"))


def claim(pct: Column, impact: Column) -> Column:
    """The claim that is told: a signed share in percent and what it amounts to in lakh, to one digit each."""
    one = lambda x: F.format_string("%.1f", F.floor(x * 10 + 0.5) / 10)
    return F.concat(F.lit("moved by "), one(pct * 100), F.lit("% ("), one(impact / 100000), F.lit(" lakh)"))


def borne_out(told: Column, bundle: Column) -> Column:
    """The share of a text's numbers that the bundle's (value, unit) bear out; a text without numbers says nothing wrong."""
    said = numbers(told)
    return F.when(F.size(said) == 0, 1.0).otherwise(1 - F.size(unmatched(said, bundle)) / F.size(said))


#: Where the signals of an application's inputs were written.
_WRITTEN: dict[tuple, str] = {}
_INPUTS = ("lineitem", "orders", "customer", "part", "supplier", "nation", "region", "documents")


def six_signals(spark: SparkSession, sf: str) -> DataFrame:
    """As ``compute_signals``: written once for an application and its input files, and read by all that ask for them."""
    key = (spark.sparkContext.applicationId, sf, *(f for t in _INPUTS for f in sorted(table(spark, sf, t).inputFiles())))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_WRITTEN.get(key, "/nowhere"))
    if key not in _WRITTEN or not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        _WRITTEN[key] = work_dir(spark, "signals")
        compute_signals(spark, sf).write.parquet(_WRITTEN[key])
    return spark.read.parquet(_WRITTEN[key])


def compute_signals(spark: SparkSession, sf: str) -> DataFrame:
    """region, month, impact, pct, z, p, lead, reconciled, stories, held, c1 to c6; held: whether the next month moved the same way, null if there is none."""
    cube = written(monthly_cube(spark, sf), "cube")
    m = _gap(cube, ("region",))
    own = Window.partitionBy("region").orderBy("k")
    year = own.rangeBetween(-12, -1)
    sd = F.stddev("v").over(year)
    g = cube.groupBy("region", "k").agg(F.sum("v").alias("v")).select("region", "k", F.round(sd, 4).alias("sd"))
    m = m.join(g, ["region", "k"]).withColumn("z", F.round(F.col("gap") / 12 / F.nullif(F.col("sd"), F.lit(0.0)), 6)).withColumn("s", F.round(F.abs(F.coalesce("z", F.lit(0.0))), 6))
    m = _detection(m)
    err = F.abs(F.col("gap")) / 12 / F.nullif(F.col("v"), F.lit(0))
    m = m.withColumns({"err": err, "earlier": F.count("k").over(own.rowsBetween(Window.unboundedPreceding, -1))}).withColumn("mape", F.avg("err").over(own.rowsBetween(-12, -1)))
    m = m.withColumn("c3", F.round(F.greatest(F.lit(0.0), 1 - 2 * F.coalesce("mape", F.lit(0.5))) * F.least(F.lit(1.0), F.col("earlier") / 24.0), 6))
    held = F.signum("gap") == F.signum(F.lead("gap").over(own))
    m = m.withColumns({"pct": F.round(F.col("gap") / F.nullif(F.col("before"), F.lit(0)), 8), "impact": F.round(F.col("gap") / 120000, 6), "held": held})
    m = m.join(_attribution(cube), ["region", "k"]).join(_data(spark, sf, cube), ["region", "k"]).join(_evidence(spark, sf), ["region", "k"], "left")
    bundle = F.array(F.struct((F.col("pct") * 100).alias("value"), F.lit("%").alias("unit")), F.struct(F.col("impact").alias("value"), F.lit("").alias("unit")))
    right = borne_out(claim(F.col("pct"), F.col("impact")), bundle)  # a digit may round away what a number says
    month = F.make_date(F.floor(F.col("k") / 12).cast("int") + ORIGIN, (F.col("k") % 12 + 1).cast("int"), F.lit(1))
    return m.select(
        "region", month.alias("month"), "impact", "pct", "z", "p", "lead", "reconciled", F.coalesce("stories", F.lit(0)).alias("stories"), "held",
        "c1", "c2", "c3", F.col("c4"), F.coalesce("c5", F.lit(0.0)).alias("c5"), F.round(F.coalesce(right, F.lit(0.0)), 6).alias("c6"),
    )


#: The claim in SQL.
CLAIM_SQL = "'moved by ' || printf('%.1f', floor(pct * 100 * 10 + 0.5) / 10) || '% (' || printf('%.1f', floor(impact / 100000 * 10 + 0.5) / 10) || ' lakh)'"
#: The same for a SQL engine, as s.
SIGNALS_SQL = f"""{FACTS}, cb0 as (select region, category, segment, (year(d) - {ORIGIN}) * 12 + month(d) - 1 as k, sum(net_e4)::bigint as v, sum(units)::bigint as units from sales group by all),
ax as (select * from (select distinct region, category, segment from cb0) cross join (select distinct k from cb0)),
cb as (select ax.*, coalesce(v, 0)::bigint as v, coalesce(units, 0)::bigint as units from ax left join cb0 using (region, category, segment, k)),
m0 as (select region, k, sum(v)::bigint as v from cb group by all),
m1 as (select *, sum(v) over w as before, count(*) over w as n, round(stddev(v) over w, 4) as sd from m0 window w as (partition by region order by k range between 12 preceding and 1 preceding)),
m2 as (select region, k, v, before::bigint as before, (12 * v - before)::bigint as gap, sd from m1 where n = 12),
m3 as (select *, round(gap / 12 / nullif(sd, 0), 6) as z, round(abs(coalesce(round(gap / 12 / nullif(sd, 0), 6), 0)), 6) as s, row_number() over (partition by region order by k) as i from m2),
m4 as (select a.region, a.k, any_value(a.z) as z, any_value(a.gap) as gap, any_value(a.v) as v, any_value(a.before) as before, any_value(a.i) as i, round((1 + count(*) filter (b.s >= a.s)) / (count(b.s) + 1), 8) as p
  from m3 a left join m3 b on a.region = b.region and b.i < a.i and b.i >= a.i - {PAST} group by a.region, a.k),
m5 as (select *, abs(gap) / 12 / nullif(v, 0) as err from m4),
m6 as (select *, avg(err) over (partition by region order by k rows between 12 preceding and 1 preceding) as mape, sign(gap) = sign(lead(gap) over (partition by region order by k)) as held from m5),
g0 as (select *, sum(v) over w as before, count(*) over w as n from cb window w as (partition by region, category, segment order by k range between 12 preceding and 1 preceding)),
gc as (select region, category, segment, k, (12 * v - before)::bigint as gap from g0 where n = 12),
sh as (select *, sum(gap) over (partition by region, k) as total from (select region, k, category, sum(gap)::bigint as gap from gc group by all)),
sr as (select *, gap / nullif(total, 0) as ep, row_number() over (partition by region, k order by gap / nullif(total, 0) desc nulls last, category) as rk from sh),
ld as (select region, k, max(case when rk = 1 then category end) as lead_, max(sign(total)) as sg, sum(case when rk <= 3 then ep end) as explained from sr group by all),
dr as (select *, floor(-ln(1 - {uniform_sql('win', 'draw', *_CELL, 'k')}) * 1000000)::hugeint * floor(gap / 120000.0::double)::hugeint as x from gc, (select unnest(range(0, {DRAWS}))::int as draw)),
wn as (select dr.region, dr.k, draw, category, sum(x) * any_value(sg)::int as w from dr join ld on dr.region = ld.region and dr.k = ld.k group by all),
fs as (select region, k, draw, arg_max(category, (w, category)) as first_ from wn group by all),
atr as (select ld.region, ld.k, any_value(lead_) as lead_, round(count(*) filter (first_ = lead_) / {DRAWS}, 6) as win, round(least(1.0, greatest(0.0, coalesce(any_value(explained), 0))), 6) as coverage from fs join ld on fs.region = ld.region and fs.k = ld.k group by all),
dy as (select region, (year(d) - {ORIGIN}) * 12 + month(d) - 1 as k, count(distinct d) as days, any_value(day(last_day(d))) as len from sales group by all),
od as (select (year(d) - {ORIGIN}) * 12 + month(d) - 1 as k, sum(ordered)::bigint as ordered from fulfilment group by all),
rc as (select k, coalesce(abs(ordered - units) <= 0.05 * units, false) as reconciled from (select k, sum(units)::bigint as units from cb group by k) left join od using (k)),
td as materialized (select floor(5 * {uniform_sql('region', 'doc_id')})::bigint as rk, floor({MONTHS} * {uniform_sql('month', 'doc_id')})::int as k, coalesce(source, '') as source, coalesce(text, '') as story, max(round(0.05 + 0.15 * least(1.0, coalesce(n_chars, 0) / 2000.0::double), 6)) as p from documents group by all),
so as (select rk, k, 1 - exp(sum(ln(1 - p))) as any_of from (select rk, k, source, max(p) as p from td group by all) group by all),
st as (select rk, k, count(distinct story) as stories from td group by all),
dn as (select so.rk, so.k, stories, any_of, least(1.0, stories / coalesce(avg(stories) over (partition by so.rk order by so.k range between 12 preceding and 1 preceding), stories)) as density from so join st on so.rk = st.rk and so.k = st.k),
ev as (select r_name as region, k, stories, round(any_of * density, 6) as c5 from dn join region on r_regionkey = rk),
s0 as (select m6.region, m6.k, round(gap / 120000, 6) as impact, round(gap / nullif(m6.before, 0), 8) as pct, z, p, lead_, reconciled, coalesce(stories, 0) as stories, held,
  round(greatest(0.0, 1 - p / {ALPHA}), 6) as c1, round(win * coverage, 9) as c2, round(greatest(0.0, 1 - 2 * coalesce(mape, 0.5)) * least(1.0, (i - 1) / 24.0::double), 6) as c3,
  case when reconciled then coalesce(round(days / len, 6), 0) else 0.0::double end as c4, coalesce(c5, 0) as c5
  from m6 join atr on m6.region = atr.region and m6.k = atr.k left join dy on dy.region = m6.region and dy.k = m6.k join rc on rc.k = m6.k left join ev on ev.region = m6.region and ev.k = m6.k),
s1 as (select *, {numbers_sql(CLAIM_SQL)} as told from s0),
s as (select region, make_date({ORIGIN} + k // 12, k % 12 + 1, 1) as month, impact, pct, z, p, lead_ as lead, reconciled, stories, held, c1, c2, c3, c4, c5,
  round(1 - len({unmatched_sql('told', "[{'value': pct * 100, 'unit': '%'}, {'value': impact, 'unit': ''}]")}) / len(told), 6) as c6 from s1)"""
