"""Fact tables bound to the star schema: sales, fulfilment and marketing.

Money is held in whole ten-thousandths, so sums are exact and don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def iso_week(d: Column) -> Column:
    """YYYY-Www of ISO 8601."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), d), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))


def fiscal_year(d: Column) -> Column:
    """The year in which a fiscal year from April to March began."""
    return F.year(F.add_months(d, -3))


def money(x: Column, scale: int = 10000) -> Column:
    return F.round(x * scale).cast("long")


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation key, nation, region; the planner broadcasts it by its size."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order line: when, what, where, through which channel, how much.

    Orders meet their customers and places first, so lines, the most rows of all, travel once by order and once by product.
    """
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    customers, parts = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part")
    net = money(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    buyers = customers.join(geography(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
    placed = orders.join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    return (
        lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("line"),
            F.col("l_partkey").alias("sku"),
            F.col("p_type").alias("category"),
            "region",
            "nation",
            F.col("o_orderpriority").alias("sales_channel"),
            F.col("c_mktsegment").alias("segment"),
            F.to_date("o_orderdate").alias("d"),
            F.col("l_quantity").cast("long").alias("units"),
            net.alias("net_e4"),
            F.when(F.col("l_returnflag") == "R", net).otherwise(0).cast("long").alias("ret_e4"),
            money(F.col("l_discount")).alias("discount_e4"),
            money(F.col("p_retailprice") * F.col("l_quantity")).alias("cost_e4"),
        )
    )


def fulfilment(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders, suppliers = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "supplier")
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(geography(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.to_date("o_orderdate").alias("d"),
            F.col("l_suppkey").alias("warehouse"),
            "region",
            F.col("l_partkey").alias("sku"),
            F.col("s_name").alias("supplier_name"),
            F.col("l_quantity").cast("long").alias("ordered"),
            F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(0).cast("long").alias("shipped_ok"),
        )
    )


def marketing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """iso_week, media_channel, spend_e2, attributed_e2: hundredths spent and attributed."""
    e = table(spark, sf_dir, "events").select(iso_week(F.to_date("ts")).alias("iso_week"), F.col("event_type").alias("media_channel"), money(F.col("value"), 100).alias("v"))
    spent = F.col("media_channel").isin("click", "view")
    return e.groupBy("iso_week", "media_channel").agg(
        F.sum(F.when(spent, F.col("v")).otherwise(0)).alias("spend_e2"), F.sum(F.when(F.col("media_channel") == "purchase", F.col("v")).otherwise(0)).alias("attributed_e2")
    )


def daily_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """d, y: net revenue by day, in money."""
    return sales(spark, sf_dir).groupBy("d").agg((F.sum("net_e4") / 10000.0).alias("y"))


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, t, d, y: value by event type and day, with t the day's number from 0."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), F.to_date("ts").alias("d"), money(F.col("value"), 100).alias("v"))
    return e.groupBy("series", "d").agg((F.sum("v") / 100.0).alias("y")).withColumn("t", F.datediff("d", F.lit("2024-01-01").cast("date")))


#: The same facts for a SQL engine; queries' SQL begins with it.
FACTS = """with sales as (
  select l_orderkey as order_id, l_linenumber as line, l_partkey as sku, p_type as category, r_name as region, n_name as nation,
    o_orderpriority as sales_channel, c_mktsegment as segment, cast(o_orderdate as date) as d, cast(l_quantity as bigint) as units,
    cast(round(l_extendedprice * (1 - l_discount) * 10000) as bigint) as net_e4,
    case when l_returnflag = 'R' then cast(round(l_extendedprice * (1 - l_discount) * 10000) as bigint) else 0 end as ret_e4,
    cast(round(l_discount * 10000) as bigint) as discount_e4, cast(round(p_retailprice * l_quantity * 10000) as bigint) as cost_e4
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
    join region on n_regionkey = r_regionkey join part on l_partkey = p_partkey
), fulfilment as (
  select cast(o_orderdate as date) as d, l_suppkey as warehouse, r_name as region, l_partkey as sku, s_name as supplier_name,
    cast(l_quantity as bigint) as ordered, case when l_linestatus = 'F' then cast(l_quantity as bigint) else 0 end as shipped_ok
  from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
    join region on n_regionkey = r_regionkey
), marketing as (
  select strftime(ts, '%G-W%V') as iso_week, event_type as media_channel,
    cast(sum(case when event_type in ('click', 'view') then cast(round(value * 100) as bigint) else 0 end) as bigint) as spend_e2,
    cast(sum(case when event_type = 'purchase' then cast(round(value * 100) as bigint) else 0 end) as bigint) as attributed_e2
  from events group by all
), daily_sales as (select d, cast(sum(net_e4) as bigint) / 10000.0::double as y from sales group by d
), daily_events as (
  select event_type as series, cast(ts as date) as d, cast(sum(cast(round(value * 100) as bigint)) as bigint) / 100.0::double as y,
    cast(date_diff('day', date '2024-01-01', cast(ts as date)) as int) as t
  from events group by event_type, cast(ts as date)
)
"""
