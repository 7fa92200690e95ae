"""From landed batches to conformed tables: stamps, checks, quarantine, versions, completeness and reconciliation."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.registry import query
from tidemark.session import work_dir, written
from tidemark.sources.tables import FACTS, fulfilment, iso_week, marketing, sales, table

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def load(spark: SparkSession, path: str, schema: T.StructType | str, source_format: str = "parquet", **options: str) -> DataFrame:
    """A source by its contract: declared schema, nothing inferred."""
    return spark.read.format(source_format).schema(schema).options(**options).load(path)


@query("scan_contract", "select event_id, event_type, value from events where value >= 100 and event_type in ('click', 'view')")
def scan_contract(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, f"{sf}/events.parquet", EVENT_SCHEMA)
    return e.where("value >= 100 and event_type in ('click', 'view')").select("event_id", "event_type", "value")


_MANIFESTS = [
    '{"source_id": "martech", "batch_id": "b1", "covers": {"grain": "week", "periods": ["2026-W01", "2026-W02"]}, "supersedes": [], "row_count": 900, "schema_version": 1}',
    '{"source_id": "martech", "batch_id": "b2", "covers": {"grain": "week", "periods": ["2026-W02"]}, "supersedes": ["b1"], "row_count": 450, "schema_version": 2}',
    '{"source_id": "oms", "batch_id": "b3", "covers": {"grain": "day", "periods": ["2026-01-05"]}, "supersedes": [], "row_count": 31000, "schema_version": 1}',
]
MANIFEST = "source_id string, batch_id string, covers struct<grain:string,periods:array<string>>, supersedes array<string>, row_count bigint, schema_version int"


@query("manifest_parse", "select m->>'source_id' as source_id, m->>'batch_id' as batch_id, m->'covers'->>'grain' as grain, unnest(from_json(m->'covers'->'periods', '[\"VARCHAR\"]')) as period, json_array_length(m->'supersedes')::int as n_superseded, (m->>'row_count')::bigint as row_count from (values " + ", ".join(f"('{m}'::json)" for m in _MANIFESTS) + ") t(m)")
def manifest_parse(spark: SparkSession, sf: str) -> DataFrame:
    m = spark.createDataFrame([(x,) for x in _MANIFESTS], "m string").select(F.from_json("m", MANIFEST).alias("m")).select("m.*")
    return m.select("source_id", "batch_id", F.col("covers.grain").alias("grain"), F.explode("covers.periods").alias("period"), F.size("supersedes").alias("n_superseded"), "row_count")


def row_hash(*columns: str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]), 256)


@query("row_hash", "select l_orderkey, l_linenumber, sha256(concat_ws('|', l_orderkey::varchar, l_linenumber::varchar, l_partkey::varchar, l_suppkey::varchar, l_returnflag)) as row_hash from lineitem")
def row_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", row_hash("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").alias("row_hash"))


@query("bronze_stamp", "select o_orderkey, 'oms-' || strftime(o_orderdate, '%Y%m') as batch_id, timestamp '2026-01-01 04:00:00' as received_at, 1 as schema_version, 'orders.parquet' as source_file from orders")
def bronze_stamp(spark: SparkSession, sf: str) -> DataFrame:
    """Rows as landed, with batch, time of arrival, file and schema version."""
    o = load(spark, f"{sf}/orders.parquet", table(spark, sf, "orders").schema)
    name = F.regexp_extract(F.input_file_name(), "([^/]+[.]parquet)(?:/[^/]*)?$", 1)
    return o.select("o_orderkey", F.concat(F.lit("oms-"), F.date_format("o_orderdate", "yyyyMM")).alias("batch_id"), F.lit("2026-01-01 04:00:00").cast("timestamp_ntz").alias("received_at"), F.lit(1).alias("schema_version"), name.alias("source_file"))


_RULES = {"late_ship": "l_shipdate < o_orderdate", "deep_discount": "l_discount > 0.08", "large": "l_quantity > 45"}


@query("dq_quarantine", "select l_orderkey, l_linenumber, concat_ws(',', case when l_shipdate < o_orderdate then 'late_ship' end, case when l_discount > 0.08 then 'deep_discount' end, case when l_quantity > 45 then 'large' end) as reasons from lineitem join orders on l_orderkey = o_orderkey where l_shipdate < o_orderdate or l_discount > 0.08 or l_quantity > 45")
def dq_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Failing rows with all their reasons; none is dropped."""
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    reasons = F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(name)) for name, rule in _RULES.items()]))
    return joined.withColumn("r", reasons).where(F.size("r") > 0).select("l_orderkey", "l_linenumber", F.array_join("r", ",").alias("reasons"))


@query("dq_ranges", "select event_type, count(*) as n, count(*) filter (value is null or value < 0 or value > 300) as out_of_range, round(count(*) filter (value is null or value < 0 or value > 300) / count(*), 8) as fraction from events group by 1")
def dq_ranges(spark: SparkSession, sf: str) -> DataFrame:
    bad = F.col("value").isNull() | (F.col("value") < 0) | (F.col("value") > 300)
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("out_of_range"), F.round(F.avg(bad.cast("int")), 8).alias("fraction"))


@query("dq_expectations", "select d, n, errors, n between 20 and 2000 as row_count_ok, clicks <= views as clicks_ok, round(zero / n, 8) as zero_fraction from (select cast(ts as date) as d, count(*) as n, count(*) filter (event_type = 'click') as clicks, count(*) filter (event_type = 'view') as views, count(*) filter (event_type = 'error') as errors, count(*) filter (value < 1) as zero from events group by 1)")
def dq_expectations(spark: SparkSession, sf: str) -> DataFrame:
    """All table expectations in one pass."""
    g = table(spark, sf, "events").groupBy(F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") == "view").alias("views"), F.count_if(F.col("value") < 1).alias("zero"))
    return g.select("d", "n", "errors", F.col("n").between(20, 2000).alias("row_count_ok"), (F.col("clicks") <= F.col("views")).alias("clicks_ok"), F.round(F.col("zero") / F.col("n"), 8).alias("zero_fraction"))


@query("dedup_rowhash", "select l_orderkey, l_linenumber, count(*) as copies, min(l_partkey) as first_part from lineitem group by all")
def dedup_rowhash(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each hash of the key; copies delivered under another batch fall together."""
    hashed = table(spark, sf, "lineitem").withColumn("h", row_hash("l_orderkey", "l_linenumber"))
    return hashed.groupBy("h").agg(F.min("l_orderkey").alias("l_orderkey"), F.min("l_linenumber").alias("l_linenumber"), F.count(F.lit(1)).alias("copies"), F.min("l_partkey").alias("first_part")).drop("h")


@query("supersede_latest", "select l_orderkey, l_linenumber, l_partkey, l_shipdate from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, l_partkey desc, l_suppkey desc, l_extendedprice desc) as rn from lineitem) where rn = 1")
def supersede_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The newest version of each key; older ones stay in bronze. The greatest row combines before the shuffle."""
    newest = F.max(F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")).alias("v")
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(newest).select("l_orderkey", "l_linenumber", "v.l_partkey", "v.l_shipdate")


@query("idempotent_anti", "select event_id, event_type from events where cast(ts as date) not in (select distinct cast(ts as date) from events where event_id % 7 = 0 and value > 150)")
def idempotent_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of batches (days) that the registry doesn't know yet."""
    e = table(spark, sf, "events").withColumn("batch", F.to_date("ts"))
    registry = e.where("event_id % 7 = 0 and value > 150").select("batch").distinct()
    return e.join(registry, "batch", "left_anti").select("event_id", "event_type")


_THEN = "cast(round(case when l_linenumber = 1 then l_extendedprice * 0.98 else l_extendedprice end * 100) as bigint)"


@query("restatement_diff", f"with b as (select l_suppkey, sum({_THEN})::bigint as v from lineitem group by 1), n as (select l_suppkey, sum(cast(round(l_extendedprice * 100) as bigint))::bigint as v from lineitem group by 1) select l_suppkey, b.v as believed_then, n.v as believed_now from b join n using (l_suppkey) where b.v <> n.v")
def restatement_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Aggregates that a restated batch changed: versions compared as sets, then side by side."""
    li = table(spark, sf, "lineitem")
    then = li.groupBy("l_suppkey").agg(F.sum(F.round(F.when(F.col("l_linenumber") == 1, F.col("l_extendedprice") * 0.98).otherwise(F.col("l_extendedprice")) * 100).cast("long")).alias("v"))
    now = li.groupBy("l_suppkey").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("v"))
    return then.exceptAll(now).withColumnRenamed("v", "believed_then").join(now.withColumnRenamed("v", "believed_now"), "l_suppkey")


_COMPLETE = "select event_type, cast(ts as date) as d, count(*) as n from events group by all"


@query("watermark_prefix", f"with c0 as ({_COMPLETE}), h as (select event_type, median(n) / 2 as half from c0 group by 1), f as (select min(d) as start from c0), c as (select event_type, d from c0 join h using (event_type) where n >= half), g as (select event_type, d, row_number() over (partition by event_type order by d) as rn, date_diff('day', start, d) as k from c, f) select event_type, max(d) as watermark, count(*) as n_days from g where k = rn - 1 group by event_type")
def watermark_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """Each source's watermark: the last of the unbroken run of complete periods from the start of all sources.

    A day is complete with half as many rows as the source has on a median day.
    """
    c = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    half = c.groupBy("event_type").agg((F.median("n") / 2).alias("half"))
    start = c.agg(F.min("d").alias("start"))  # one row
    full = c.join(half, "event_type").where("n >= half").crossJoin(start)
    run = full.withColumn("rn", F.row_number().over(Window.partitionBy("event_type").orderBy("d"))).where(F.datediff("d", "start") == F.col("rn") - 1)
    return run.groupBy("event_type").agg(F.max("d").alias("watermark"), F.count(F.lit(1)).alias("n_days"))


@query("late_recompute", f"{FACTS} select date_trunc('month', d)::date as month, region, sum(net_e4)::bigint as net_e4 from sales group by all")
def late_recompute(spark: SparkSession, sf: str) -> DataFrame:
    """Gold by month: written without the rows of a late batch, then only the months that the batch touches are written again."""
    s = sales(spark, sf).withColumn("month", F.trunc("d", "month"))
    gold = lambda rows: rows.groupBy("month", "region").agg(F.sum("net_e4").alias("net_e4")).repartition("month")
    path = work_dir(spark, "gold")
    late = F.col("order_id") % 400 == 0
    gold(s.where(~late)).write.partitionBy("month").parquet(path)
    touched = s.where(late).select("month").distinct()
    gold(s.join(touched, "month", "left_semi")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    return spark.read.schema("region string, net_e4 long, month date").parquet(path).select("month", "region", "net_e4")


@query("run_ledger", """with b as (select count(*) as n from events), s as (select count(*) as n from (select distinct event_id from events where value between 0 and 300)), g as (select count(*) as n from (select distinct event_type, cast(ts as date) from events where value between 0 and 300))
    select 'bronze' as stage, b.n as rows_in, b.n as rows_out, 'ok' as status from b union all select 'silver', b.n, s.n, 'ok' from b, s union all select 'gold', s.n, g.n, 'ok' from s, g union all select 'publish', g.n, 0, 'failed: ValueError' from g""")
def run_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Stages of a run with rows in and out and how each ended; a stage that fails is on record too."""

    def publish(df: DataFrame) -> DataFrame:
        raise ValueError("no target is declared")

    stages = [
        ("bronze", lambda _: table(spark, sf, "events").select("event_id", "ts", "event_type", "value")),
        ("silver", lambda df: df.where("value between 0 and 300").dropDuplicates(["event_id"])),
        ("gold", lambda df: df.groupBy("event_type", F.to_date("ts").alias("d")).agg(F.sum("value").alias("v"))),
        ("publish", publish),
    ]
    return run_stages(spark, stages, work_dir(spark, "runs")).select("stage", "rows_in", "rows_out", "status")


_RUN = "k int, stage string, rows_in long, rows_out long, status string, ms long, bytes long, gb_seconds double"


def run_stages(spark: SparkSession, stages: list[tuple[str, Callable[[DataFrame | None], DataFrame]]], path: str) -> DataFrame:
    """The ledger at ``path`` after the stages, each of which gets what its predecessor wrote: rows, status, milliseconds, bytes
    written, and what it costs in GB of these times seconds. A row is written when its stage ends, well or not."""
    df, n = None, None
    for k, (name, stage) in enumerate(stages):
        began, size = time.perf_counter(), 0
        try:
            df = written(stage(df), f"run-{name}")
            out, status = df.count(), "ok"
            for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
                at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                size += at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
        except ValueError as e:
            out, status = 0, f"failed: {type(e).__name__}"
        ms = int(1000 * (time.perf_counter() - began))
        row = [(k, name, out if n is None else n, out, status, ms, size, round(size / 1e9 * ms / 1000, 9))]
        spark.createDataFrame(row, _RUN).write.mode("append").parquet(path)
        n = out
    return spark.read.schema(_RUN).parquet(path)


@query("freshness_status", "select event_type, max(ts) as last_ts, case when date_diff('second', max(ts), timestamp '2024-01-31 00:00:00') / 3600.0 <= 0.5 then 'green' when date_diff('second', max(ts), timestamp '2024-01-31 00:00:00') / 3600.0 <= 1 then 'amber' else 'red' end as status from events group by 1")
def freshness_status(spark: SparkSession, sf: str) -> DataFrame:
    age = F.timestamp_diff("SECOND", F.max("ts"), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")) / 3600.0
    status = F.when(age <= 0.5, "green").when(age <= 1, "amber").otherwise("red")
    return table(spark, sf, "events").groupBy("event_type").agg(F.max("ts").alias("last_ts"), status.alias("status"))


@query("reconcile", f"{FACTS}, a as (select region, sum(ordered)::bigint as a from fulfilment group by 1), b as (select region, sum(units)::bigint as b from sales group by 1) select coalesce(a.region, b.region) as region, a, b, round(abs(a - b) / nullif(b, 0), 8) as gap, coalesce(abs(a - b) / nullif(b, 0) > 0.05, true) as breach from a full join b on a.region = b.region")
def reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Two sources' measures side by side; beyond the tolerance, or missing on a side, attribution is blocked."""
    a = fulfilment(spark, sf).groupBy("region").agg(F.sum("ordered").alias("a"))
    b = sales(spark, sf).groupBy("region").agg(F.sum("units").alias("b"))
    gap = F.abs(F.col("a") - F.col("b")) / F.nullif(F.col("b"), F.lit(0))
    return a.join(b, "region", "full").select("region", "a", "b", F.round(gap, 8).alias("gap"), F.coalesce(gap > 0.05, F.lit(True)).alias("breach"))


_FX = [("1995-01-01", 31.4), ("1996-02-15", 36.6), ("1997-07-01", 35.8), ("1999-01-10", 42.5), ("2000-06-01", 44.7)]


@query("asof_fx", "with fx as (select d::date as d, rate from (values " + ", ".join(str(x) for x in _FX) + ") t(d, rate)) select o_orderkey, rate, round(o_totalprice * rate, 4) as inr from (select o_orderkey, o_totalprice, cast(o_orderdate as date) as d from orders) o asof left join fx on o.d >= fx.d")
def asof_fx(spark: SparkSession, sf: str) -> DataFrame:
    """The last rate at or before each order's day; an order before the first rate has none.

    Rates become ranges, whose days are the equi key: a range join without a scan of all rates for each order.
    """
    fx = spark.createDataFrame(_FX, "d string, rate double").withColumn("d", F.to_date("d"))
    o = table(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate"))
    last = o.agg(F.max("day").alias("last"))  # one row
    until = F.coalesce(F.lead("d").over(Window.orderBy("d")), F.date_add("last", 1))
    days = fx.crossJoin(last).withColumn("until", until).where("d < until").withColumn("day", F.explode(F.sequence("d", F.date_sub("until", 1)))).select("day", "rate")
    return o.join(days, "day", "left").select("o_orderkey", "rate", F.round(F.col("o_totalprice") * F.col("rate"), 4).alias("inr"))


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], on: str, value: str) -> DataFrame:
    """``left`` with the ``value`` of the last row of ``right`` with equal keys at or before ``on``; ties: the greatest.

    Both sides are put in one order and the last value carried on, one exchange by the keys.
    """
    both = left.withColumn("__v", F.lit(None).cast(right.schema[value].dataType)).withColumn("__l", F.lit(1)).unionByName(
        right.select(*keys, on, F.col(value).alias("__v"), F.lit(0).alias("__l")), allowMissingColumns=True
    )
    w = Window.partitionBy(*keys).orderBy(on, "__l", "__v").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("__v", ignorenulls=True).over(w)).where("__l = 1").drop("__v", "__l")


@query("asof_events", "select e.event_id, p.value as last_purchase from (select event_id, user_id, ts from events where event_type = 'click') e asof left join (select user_id, ts, value from events where event_type = 'purchase') p on e.user_id = p.user_id and e.ts >= p.ts")
def asof_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    clicks, bought = e.where("event_type = 'click'").select("event_id", "user_id", "ts"), e.where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("last_purchase"))
    return asof_join(clicks, bought, ["user_id"], "ts", "last_purchase").select("event_id", "last_purchase")


@query("scd_range_join", f"{FACTS}, h as (select p_partkey as sku, 'old' as grp, date '1990-01-01' as f, date '1998-01-01' as u from part union all select p_partkey, case when p_size > 25 then 'big' else 'small' end, date '1998-01-01', date '9999-12-31' from part) select grp, category, sum(units)::bigint as units from sales join h on sales.sku = h.sku and d >= f and d < u group by all")
def scd_range_join(spark: SparkSession, sf: str) -> DataFrame:
    """Each sale meets the version of its product that was valid on its day."""
    p = table(spark, sf, "part")
    version = lambda grp, a, b: p.select("p_partkey", grp.alias("grp"), F.lit(a).cast("date").alias("valid_from"), F.lit(b).cast("date").alias("valid_to"))
    history = version(F.lit("old"), "1990-01-01", "1998-01-01").unionByName(version(F.when(F.col("p_size") > 25, "big").otherwise("small"), "1998-01-01", "9999-12-31"))
    s = sales(spark, sf)
    return s.join(history, (s.sku == history.p_partkey) & (s.d >= history.valid_from) & (s.d < history.valid_to)).groupBy("grp", "category").agg(F.sum("units").alias("units"))


@query("tz_normalise", "select cast(ts + interval 330 minute as date) as ist_day, count(*) as n, count(*) filter (cast(ts + interval 330 minute as date) <> cast(ts as date)) as moved from events group by 1")
def tz_normalise(spark: SparkSession, sf: str) -> DataFrame:
    """A feed stamped in UTC, by its canonical local day."""
    local = F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Kolkata"))
    return table(spark, sf, "events").groupBy(local.alias("ist_day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(local != F.to_date("ts")).alias("moved"))


@query("gap_detect", "select user_id, d as last_day, date_diff('day', d, nxt)::int as gap from (select user_id, d, lead(d) over (partition by user_id order by d) as nxt from (select distinct user_id, cast(ts as date) as d from events where event_type = 'purchase')) where date_diff('day', d, nxt) > 5")
def gap_detect(spark: SparkSession, sf: str) -> DataFrame:
    days = table(spark, sf, "events").where("event_type = 'purchase'").select("user_id", F.to_date("ts").alias("d")).distinct()
    gap = F.datediff(F.lead("d").over(Window.partitionBy("user_id").orderBy("d")), F.col("d"))
    return days.withColumn("gap", gap).where("gap > 5").select("user_id", F.col("d").alias("last_day"), "gap")


_JUMP = "select event_type as series, cast(ts as date) as d, sum(cast(round(value * 100) as bigint) * case when event_type = 'view' and cast(ts as date) >= date '2024-01-20' then 100 else 1 end)::bigint as v from events group by all"


@query("unit_jump", f"with s as ({_JUMP}), m as (select series, d, v, median(v) over (partition by series order by d rows between 7 preceding and 1 preceding) as m, count(*) over (partition by series order by d rows between 7 preceding and 1 preceding) as n from s) select series, d, round(v / m, 6) as ratio from m where n = 7 and (v / m >= 20 or v / m <= 0.05)")
def unit_jump(spark: SparkSession, sf: str) -> DataFrame:
    """Days on which a series leaves its trailing median by the factor of a changed unit."""
    changed = F.when((F.col("event_type") == "view") & (F.to_date("ts") >= F.lit("2024-01-20").cast("date")), 100).otherwise(1)
    s = table(spark, sf, "events").groupBy(F.col("event_type").alias("series"), F.to_date("ts").alias("d")).agg(F.sum(F.round(F.col("value") * 100).cast("long") * changed).alias("v"))
    w = Window.partitionBy("series").orderBy("d").rowsBetween(-7, -1)
    m = s.withColumn("seen", F.array_sort(F.collect_list("v").over(w))).withColumns({"m": F.get("seen", F.lit(3)), "n": F.size("seen")})
    ratio = F.col("v") / F.col("m")
    return m.where((F.col("n") == 7) & ((ratio >= 20) | (ratio <= 0.05))).select("series", "d", F.round(ratio, 6).alias("ratio"))


@query("union_versions", "select event_id, value, props, null::varchar as source from events where event_id % 2 = 0 union all by name select event_id, value, event_type as source, null::varchar as props from events where event_id % 2 = 1")
def union_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of two schema versions, by name; columns that a version lacks are null."""
    e = table(spark, sf, "events")
    v1, v2 = e.where("event_id % 2 = 0").select("event_id", "value", "props"), e.where("event_id % 2 = 1").select("event_id", "value", F.col("event_type").alias("source"))
    return v1.unionByName(v2, allowMissingColumns=True)


@query("coverage_left", "select p_brand, count(*) as n, count(price) as matched, round(count(price) / count(*), 8) as coverage from part left join (select p_partkey as sku, p_retailprice * 1.02 as price from part where p_partkey % 10 < 6) c on p_partkey = sku group by 1")
def coverage_left(spark: SparkSession, sf: str) -> DataFrame:
    """A feed that covers about sixty of a hundred products, and how far."""
    p = table(spark, sf, "part")
    feed = p.where("p_partkey % 10 < 6").select(F.col("p_partkey").alias("sku"), (F.col("p_retailprice") * 1.02).alias("price"))
    return p.join(feed, F.col("p_partkey") == F.col("sku"), "left").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.count("price").alias("matched"), F.round(F.count("price") / F.count(F.lit(1)), 8).alias("coverage"))


@query("json_props", "select event_type, (props->>'k')::int % 10 as k, count(*) as n from events group by all")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"] % 10
    return table(spark, sf, "events").groupBy("event_type", k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("restatement_open", "select iso_week, media_channel, spend_e2, iso_week in ('2024-W03', '2024-W04', '2024-W05') as restatement_open from (" + FACTS + " select * from marketing)")
def restatement_open(spark: SparkSession, sf: str) -> DataFrame:
    """Weeks within fourteen days of the newest data may be described, not attributed."""
    days = table(spark, sf, "events").select(F.to_date("ts").alias("d"), iso_week(F.to_date("ts")).alias("iso_week")).groupBy("iso_week").agg(F.max("d").alias("d"))
    is_open = days.select("iso_week", (F.col("d") > F.date_sub(F.max("d").over(Window.partitionBy()), 14)).alias("restatement_open"))
    return marketing(spark, sf).join(is_open, "iso_week").select("iso_week", "media_channel", "spend_e2", "restatement_open")


@query("snapshot_positions", f"{FACTS} select warehouse, date_trunc('month', d)::date as month, arg_min(ordered, (d, sku, ordered)) as opening, arg_max(ordered, (d, sku, ordered)) as closing, sum(ordered)::bigint as moved from fulfilment group by all")
def snapshot_positions(spark: SparkSession, sf: str) -> DataFrame:
    f = fulfilment(spark, sf)
    order = F.struct("d", "sku", "ordered")
    return f.groupBy("warehouse", F.trunc("d", "month").alias("month")).agg(F.min_by("ordered", order).alias("opening"), F.max_by("ordered", order).alias("closing"), F.sum("ordered").alias("moved"))


@query("calendar_spine", "select d, dayofweek(d) in (0, 6) as weekend, strftime(d, '%G-W%V') as iso_week, extract(year from d - interval 3 month)::int as fiscal_year, (((month(d) + 8) % 12) // 3 + 1)::int as fiscal_quarter from (select unnest(generate_series(timestamp '2023-09-01', timestamp '2026-08-31', interval 1 day))::date as d)")
def calendar_spine(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.range(1).select(F.explode(F.sequence(F.lit("2023-09-01").cast("date"), F.lit("2026-08-31").cast("date"))).alias("d"))
    quarter = F.floor((F.month("d") + 8) % 12 / 3) + 1
    return d.select("d", F.dayofweek("d").isin(1, 7).alias("weekend"), iso_week(F.col("d")).alias("iso_week"), F.year(F.add_months("d", -3)).alias("fiscal_year"), quarter.cast("int").alias("fiscal_quarter"))


@query("calendar_gapfill", "with l as (select min(cast(ts as date)) as a, max(cast(ts as date)) as b from events), s as (select user_id, d from (select distinct user_id from events) cross join (select unnest(generate_series(a::timestamp, b::timestamp, interval 1 day))::date as d from l)), f as (select user_id, cast(ts as date) as d, count(*) as n from events group by all) select s.user_id, s.d, coalesce(n, 0)::bigint as n, n is null as gap from s left join f using (user_id, d)")
def calendar_gapfill(spark: SparkSession, sf: str) -> DataFrame:
    """Every user has every day from the first to the last of all; days without rows are marked, not left out."""
    e = table(spark, sf, "events").withColumn("d", F.to_date("ts"))
    ends = e.agg(F.min("d").alias("a"), F.max("d").alias("b"))  # one row
    spine = e.select("user_id").distinct().crossJoin(ends).select("user_id", F.explode(F.sequence("a", "b")).alias("d"))
    return spine.join(e.groupBy("user_id", "d").agg(F.count(F.lit(1)).alias("n")), ["user_id", "d"], "left").select("user_id", "d", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("gap"))


_HASH = "cast(('0x' || substr(md5(concat_ws('|', 'arrivals', source, d::varchar)), 1, 8)) as bigint) / 4294967296.0::double"


@query("arrival_schedule", f"with s as (select source, hour, unnest(generate_series(timestamp '2024-01-01', timestamp '2024-03-31', interval 1 day))::date as d from (values ('oms', 2), ('wms', 5), ('martech', 6)) t(source, hour)), u as (select *, {_HASH} as u from s where source <> 'martech' or isodow(d) = 1) select source, d, d + to_hours(hour) + to_minutes(floor(u * 45)::int) as due, u < 0.05 as fails from u")
def arrival_schedule(spark: SparkSession, sf: str) -> DataFrame:
    """When each source's next file is due: its hour, a jitter and a roll for failure that depend on its keys alone."""
    s = spark.createDataFrame([("oms", 2), ("wms", 5), ("martech", 6)], "source string, hour int")
    s = s.withColumn("d", F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-03-31").cast("date")))).where((F.col("source") != "martech") | (F.weekday("d") == 0))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("arrivals"), "source", F.col("d").cast("string"))), 1, 8), 16, 10).cast("long") / 4294967296.0
    s = s.withColumn("u", u)
    due = F.expr("cast(d as timestamp_ntz) + make_dt_interval(0, hour, cast(floor(u * 45) as int), 0)")
    return s.select("source", "d", due.alias("due"), (F.col("u") < 0.05).alias("fails"))


_MODE = "timestamp '2026-01-01 00:00:00'"


@query("arrival_modes", f"""with s as (select source, hour, unnest(generate_series(timestamp '2024-01-01', timestamp '2024-03-31', interval 1 day))::date as d from (values ('oms', 2), ('wms', 5), ('martech', 6)) t(source, hour)), u as (select source, d, d + to_hours(hour) as due from s where source <> 'martech' or isodow(d) = 1),
    m as (select *, row_number() over (partition by source order by due) as k, min(due) over (partition by source) as first_ from u)
    select source, d, due as live, {_MODE} + to_seconds(date_diff('second', first_, due) // 43200) as replay, {_MODE} + to_seconds(k - 1) as backfill, case when source = 'wms' and due between timestamp '2024-02-01' and timestamp '2024-02-10 12:00:00' then timestamp '2024-02-10 12:00:00' else due end as paused from m""")
def arrival_modes(spark: SparkSession, sf: str) -> DataFrame:
    """When each file comes: live at its hour; replayed at two seconds a day; backfilled one after the other; held while a source is paused."""
    s = spark.createDataFrame([("oms", 2), ("wms", 5), ("martech", 6)], "source string, hour int")
    s = s.withColumn("d", F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-03-31").cast("date")))).where((F.col("source") != "martech") | (F.weekday("d") == 0))
    s = s.withColumn("due", F.expr("cast(d as timestamp_ntz) + make_dt_interval(0, hour)"))
    own = Window.partitionBy("source")
    m = s.withColumns({"k": F.row_number().over(own.orderBy("due")), "first": F.min("due").over(own)})
    begin, resumed = "timestamp_ntz'2026-01-01 00:00:00'", "timestamp_ntz'2024-02-10 12:00:00'"
    return m.select(
        "source", "d", F.col("due").alias("live"), F.expr(f"{begin} + make_dt_interval(0, 0, 0, timestampdiff(SECOND, first, due) div 43200)").alias("replay"),
        F.expr(f"{begin} + make_dt_interval(0, 0, 0, k - 1)").alias("backfill"), F.expr(f"case when source = 'wms' and due between timestamp_ntz'2024-02-01 00:00:00' and {resumed} then {resumed} else due end").alias("paused"),
    )
