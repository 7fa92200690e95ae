"""Cause sets over several dimensions, and how far a second sample of the leaves would name them again.

Segments are all combinations of at most ``max_dims`` dimensions' values, from one aggregation of the leaf cube with
grouping sets. A cause set is filled greedily with the segment that explains most for its surprise, of those that share
no leaf with one that is chosen already, until enough of the movement is explained. Leaves name the segments that they
lie in, so what overlaps is found by joins, exactly, and cubes of many scopes (years here) are covered at once. Each
cause says along which other dimensions its price moved against all of its parts (Simpson's paradox).

The bootstrap gives each leaf a number of copies that depends on its keys and the draw alone, and sends all draws through
the same grouping sets. It compares whole rankings: the first segment, the first three in order, and each one's place.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.rng import uniform, uniform_sql
from tidemark.operators.attribution import DIMS, surprise
from tidemark.registry import query
from tidemark.session import written
from tidemark.sources.tables import FACTS, sales

#: Rows that a segment needs, causes at most, explained share that is enough, and share that a cause must explain.
MIN_OBS, MOST, ENOUGH, LEAST = 30, 4, 0.67, 0.02
DRAWS, PLACES = 40, 3


def yearly_cube(spark: SparkSession, sf: str) -> DataFrame:
    """y, dimensions, a and f (this year's and last year's net revenue in ten-thousandths), ua and uf (units), n (rows of both)."""
    s = sales(spark, sf).groupBy(F.year("d").alias("year"), *DIMS).agg(F.sum("net_e4").alias("v"), F.sum("units").alias("u"), F.count(F.lit(1)).alias("n"))
    s = written(s, "years")
    at = lambda shift: s.withColumn("y", F.col("year") + shift).select("y", *DIMS, *[F.when(F.lit(shift == k), F.col(c)).otherwise(0).alias(x) for k, c, x in ((0, "v", "a"), (1, "v", "f"), (0, "u", "ua"), (1, "u", "uf"))], "n")
    years = s.agg((F.min("year") + 1).alias("low"), F.max("year").alias("high"))  # one row
    both = at(0).union(at(1)).join(years, F.col("y").between(F.col("low"), F.col("high"))).drop("low", "high")
    return written(both.groupBy("y", *DIMS).agg(*[F.sum(c).alias(c) for c in ("a", "f", "ua", "uf", "n")]), "yearly-cube")


def _sets(dims: tuple[str, ...], max_dims: int) -> list[tuple[str, ...]]:
    return [c for k in range(1, max_dims + 1) for c in combinations(dims, k)]


def _key(dims: tuple[str, ...]) -> Column:
    """The name of a segment: its dimensions and their values."""
    return F.concat(F.lit("+".join(dims) + "="), F.concat_ws("+", *dims))


def segments(cube: DataFrame, by: tuple[str, ...], dims: tuple[str, ...] = DIMS, max_dims: int = 2) -> DataFrame:
    """by, dims, key, n, ep, surprise, score of every segment with enough rows."""
    sets = _sets(dims, max_dims)
    g = cube.groupingSets([[*by, *s] for s in sets], *by, *dims).agg(F.sum("a").alias("a"), F.sum("f").alias("f"), F.sum("n").alias("n"), F.grouping_id().alias("id"))
    name = F.concat_ws("+", *[F.when(F.col(d).isNotNull(), F.lit(d)) for d in dims])
    g = g.select(*by, name.alias("dims"), F.concat(name, F.lit("="), F.concat_ws("+", *dims)).alias("key"), "a", "f", "n")
    own = Window.partitionBy(*by, "dims")
    ta, tf = F.sum("a").over(own), F.sum("f").over(own)
    g = g.withColumns({"ep": F.round((F.col("a") - F.col("f")) / F.nullif(ta - tf, F.lit(0)), 8), "surprise": F.round(surprise(F.col("f") / F.nullif(tf, F.lit(0)), F.col("a") / F.nullif(ta, F.lit(0))), 10)})
    return g.where(F.col("n") >= MIN_OBS).withColumn("score", F.round(F.col("ep") * F.col("surprise"), 12))


def _in_segments(leaves: DataFrame, by: tuple[str, ...], dims: tuple[str, ...], max_dims: int) -> DataFrame:
    """Each leaf once for every segment that it lies in, under the segment's key."""
    return leaves.withColumn("key", F.explode(F.array(*[_key(s) for s in _sets(dims, max_dims)])))


def cause_sets(cube: DataFrame, by: tuple[str, ...], dims: tuple[str, ...] = DIMS, max_dims: int = 2, most: int = MOST) -> DataFrame:
    """by, rk, key, ep, score, explained (by it and those before), reversed: the causes of each scope, none sharing a leaf.

    reversed names the dimensions along which all parts of the segment changed their price against the segment's own.
    """
    found = written(segments(cube, by, dims, max_dims).where(F.col("ep") >= LEAST).select(*by, "dims", "key", "ep", "score"), "segments")
    leaves = written(_in_segments(cube, by, dims, max_dims), "leaves-in-segments")
    place = [*by, *dims]
    left, chosen = found, None
    for rk in range(1, most + 1):  # a round names one more cause of every scope
        order = [F.desc("score"), F.length("dims"), "key"]
        first = left.withColumn("o", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("o = 1").select(*by, F.lit(rk).alias("rk"), "key", "ep", "score")
        if chosen is not None:
            so_far = chosen.groupBy(*by).agg(F.sum("ep").alias("so_far"))
            first = first.join(so_far.where(F.col("so_far") < ENOUGH).select(*by), list(by), "left_semi")
        first = written(first, "cause")
        chosen = first if chosen is None else chosen.union(first)
        covered = leaves.join(first.select(*by, "key"), [*by, "key"], "left_semi").select(*place)
        refused = leaves.join(covered, place, "left_semi").select(*by, "key").distinct()
        left = written(left.join(refused, [*by, "key"], "left_anti"), "segments-left")
    parts = leaves.join(chosen.select(*by, "key"), [*by, "key"])
    named = F.split(F.element_at(F.split("key", "="), 1), "[+]")
    other = F.filter(F.array(*[F.struct(F.lit(d).alias("along"), F.col(d).alias("value")) for d in dims]), lambda x: ~F.array_contains(named, x["along"]))
    sums = lambda rows, *keys: rows.groupBy(*by, "key", *keys).agg(*[F.sum(c).alias(c) for c in ("a", "f", "ua", "uf")]).withColumn("dr", F.col("a") / F.nullif("ua", F.lit(0)) - F.col("f") / F.nullif("uf", F.lit(0)))
    child = sums(parts.withColumn("x", F.explode(other)).select("*", "x.along", "x.value"), "along", "value").where("dr is not null")
    whole = sums(parts).select(*by, "key", F.col("dr").alias("whole"))
    turned = child.join(whole, [*by, "key"]).groupBy(*by, "key", "along").agg(F.bool_and(F.signum("dr") * F.signum("whole") < 0).alias("turned")).where("turned")
    turned = turned.groupBy(*by, "key").agg(F.array_join(F.sort_array(F.collect_set("along")), ",").alias("reversed"))  # a name a dimension
    explained = F.round(F.sum("ep").over(Window.partitionBy(*by).orderBy("rk").rowsBetween(Window.unboundedPreceding, 0)), 8)
    out = chosen.withColumn("explained", explained).join(turned, [*by, "key"], "left")
    return out.select(*by, "rk", "key", "ep", "score", "explained", F.coalesce("reversed", F.lit("")).alias("reversed"))


_YEARS = f"""{FACTS}, s as materialized (select year(d)::int as year, region, category, segment, sales_channel, sum(net_e4)::bigint as v, sum(units)::bigint as u, count(*) as n from sales group by all),
  lim as (select min(year) + 1 as low, max(year) as high from s),
  cube as materialized (select y, region, category, segment, sales_channel, sum(a)::bigint as a, sum(f)::bigint as f, sum(ua)::bigint as ua, sum(uf)::bigint as uf, sum(n)::bigint as n from (select year as y, * exclude (year), v as a, 0 as f, u as ua, 0 as uf from s union all select year + 1, * exclude (year), 0, v, 0, u from s), lim where y between low and high group by all)"""


def _segments_sql(by: str, cube: str, sets: list[tuple[str, ...]]) -> str:
    """CTE seg: as ``segments``."""
    union = " union all ".join(f"select {by}, '{'+'.join(s)}' as dims, '{'+'.join(s)}=' || {' || chr(43) || '.join(s)} as key, sum(a)::bigint as a, sum(f)::bigint as f, sum(n)::bigint as n from {cube} group by {by}, {', '.join(s)}" for s in sets)
    return f"""g as ({union}), t as (select *, sum(a) over (partition by {by}, dims)::bigint as ta, sum(f) over (partition by {by}, dims)::bigint as tf from g),
  e as (select *, round((a - f) / nullif(ta - tf, 0), 8) as ep, f / nullif(tf, 0) as p, a / nullif(ta, 0) as q from t where n >= {MIN_OBS}),
  j as (select *, round(0.5 * (case when p > 0 then p * ln(2 * p / (p + q)) else 0 end + case when q > 0 then q * ln(2 * q / (p + q)) else 0 end), 10) as surprise from e),
  seg as materialized (select {by}, dims, key, n, ep, surprise, round(ep * surprise, 12) as score from j)"""


def _causes_sql() -> str:
    sets = _sets(DIMS, 2)
    keys = ", ".join(f"'{'+'.join(s)}=' || {' || chr(43) || '.join(s)}" for s in sets)
    leaf = ", ".join(DIMS)
    out = [_YEARS, _segments_sql("y", "cube", sets), f"lk as materialized (select *, unnest([{keys}]) as key from cube)", f"l0 as materialized (select y, dims, key, ep, score from seg where ep >= {LEAST})"]
    for r in range(1, MOST + 1):
        go_on = "" if r == 1 else f" and y in (select y from ({' union all '.join(f'select * from c{k}' for k in range(1, r))}) group by y having sum(ep) < {ENOUGH})"
        out.append(f"c{r} as materialized (select y, {r} as rk, key, ep, score from (select *, row_number() over (partition by y order by score desc, length(dims), key) as o from l{r - 1}) where o = 1{go_on})")
        out.append(f"l{r} as materialized (select * from l{r - 1} where (y, key) not in (select y, key from lk where (y, {leaf}) in (select y, {leaf} from lk where (y, key) in (select y, key from c{r}))))")
    out.append(f"ch as materialized ({' union all '.join(f'select * from c{k}' for k in range(1, MOST + 1))})")
    rate = "sum(a)::bigint / nullif(sum(ua)::bigint, 0) - sum(f)::bigint / nullif(sum(uf)::bigint, 0)"
    out.append("pt as materialized (select lk.* from lk where (y, key) in (select y, key from ch))")
    out.append(f"wh as (select y, key, {rate} as whole from pt group by all)")
    out.append(f"cd as ({' union all '.join(f'select y, key, {chr(39)}{d}{chr(39)} as along, {rate} as dr from pt where not list_contains(string_split(string_split(key, {chr(39)}={chr(39)})[1], {chr(39)}+{chr(39)}), {chr(39)}{d}{chr(39)}) group by y, key, {d}' for d in DIMS)})")
    out.append("tn as (select y, key, along from cd join wh using (y, key) where dr is not null group by y, key, along having bool_and(sign(dr) * sign(whole) < 0))")
    return ", ".join(out) + " select y, rk, key, ep, score, round(sum(ep) over (partition by y order by rk), 8) as explained, coalesce((select string_agg(along, ',' order by along) from tn where tn.y = ch.y and tn.key = ch.key), '') as reversed from ch"


@query("cause_sets", _causes_sql())
def cause_sets_query(spark: SparkSession, sf: str) -> DataFrame:
    """What explains each year's revenue against the year before, over regions, categories, segments and channels."""
    return cause_sets(yearly_cube(spark, sf), ("y",))


def copies(u: Column) -> Column:
    """How often a leaf is drawn, in a sample of as many leaves as there are: Poisson with mean 1, from a uniform draw."""
    steps = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(8)]
    return reduce(lambda a, b: a + b, [F.when(u >= s, 1).otherwise(0) for s in steps])


def bootstrap_ranking(cube: DataFrame, by: tuple[str, ...], dims: tuple[str, ...] = DIMS, max_dims: int = 2, draws: int = DRAWS) -> DataFrame:
    """by, dims, key, rk, wins, kept, ranking: for each of the first PLACES segments of each set of dimensions how often
    it takes its own place, how often it is among the first, and how often all of them come in the same order."""
    order = Window.partitionBy(*by, "draw", "dims").orderBy(F.desc("score"), "key")
    drawn = cube.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws)))).withColumn("w", F.when(F.col("draw") == 0, 1).otherwise(copies(uniform("leaf", "draw", *by, *dims))))
    drawn = drawn.where("w > 0").select(*by, "draw", *dims, *[(F.col(c) * F.col("w")).alias(c) for c in ("a", "f", "n")])
    ranked = segments(drawn, (*by, "draw"), dims, max_dims).withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= PLACES)
    ranked = written(ranked.select(*by, "draw", "dims", "key", "rk"), "ranked-draws")
    true = ranked.where("draw = 0").select(*by, "dims", "key", "rk")
    other = ranked.where("draw > 0").withColumnRenamed("rk", "place")
    met = true.join(other, [*by, "dims", "key"], "left")
    one = met.groupBy(*by, "dims", "key", "rk").agg(F.count_if(F.col("place") == F.col("rk")).alias("wins"), F.count("place").alias("kept"))
    whole = true.groupBy(*by, "dims").agg(F.count(F.lit(1)).alias("places"))
    same = met.where("place = rk").groupBy(*by, "dims", "draw").agg(F.count(F.lit(1)).alias("right")).join(whole, [*by, "dims"]).where("right = places").groupBy(*by, "dims").agg(F.count(F.lit(1)).alias("same"))
    share = lambda c: F.round(F.coalesce(c, F.lit(0)) / draws, 4)
    out = one.join(same, [*by, "dims"], "left")
    return out.select(*by, "dims", "key", F.col("rk").cast("int").alias("rk"), share("wins").alias("wins"), share("kept").alias("kept"), share("same").alias("ranking"))


_STEPS = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(8)]
_BOOT = f"""{_YEARS}, dw as (select c.y, draw, {', '.join(f'c.{d}' for d in DIMS)}, a, f, n, {uniform_sql('leaf', 'draw', 'y', *DIMS)} as u from cube c, (select unnest(range(0, {DRAWS + 1}))::int as draw)),
  db as materialized (select y, draw, {', '.join(DIMS)}, a * w as a, f * w as f, n * w as n from (select *, case when draw = 0 then 1 else {' + '.join(f'(u >= {s!r}::double)::int' for s in _STEPS)} end as w from dw) where w > 0),
  {_segments_sql('y, draw', 'db', _sets(DIMS, 2))}, rk as (select y, draw, dims, key, row_number() over (partition by y, draw, dims order by score desc, key) as rk from seg),
  tr as (select * from rk where draw = 0 and rk <= {PLACES}), ot as (select y, draw, dims, key, rk as place from rk where draw > 0 and rk <= {PLACES}),
  mt as (select tr.y, tr.dims, tr.key, tr.rk, ot.draw, place from tr left join ot on tr.y = ot.y and tr.dims = ot.dims and tr.key = ot.key),
  wp as (select y, dims, count(*) as places from tr group by all), rg as (select y, dims, draw, count(*) as right_ from mt where place = rk group by all),
  sm as (select y, dims, count(*) as same from rg join wp using (y, dims) where right_ = places group by all)
  select y, dims, key, rk::int as rk, round(count(*) filter (place = rk) / {DRAWS}, 4) as wins, round(count(place) / {DRAWS}, 4) as kept, round(coalesce(any_value(same), 0) / {DRAWS}, 4) as ranking from mt left join sm using (y, dims) group by y, dims, key, rk"""


@query("bootstrap_ranking", _BOOT)
def bootstrap_ranking_query(spark: SparkSession, sf: str) -> DataFrame:
    """How stable each year's rankings of segments are when the leaves are drawn anew."""
    return bootstrap_ranking(yearly_cube(spark, sf), ("y",))
