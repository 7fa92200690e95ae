"""A watermark for each source, kept by a stream, that goes back when a period is restated.

Deliveries say for each row its source, its period (a day), the version of the period and how many rows that version
has in all. A period is complete when its newest version has arrived whole. A source's watermark is the last of the
unbroken run of complete periods, from the first period of all sources on; a version that has arrived in part takes it
back to the day before, and the periods behind it are open again until the version is whole.

What gold says of a source's week is a bundle with a hash; when a restated day or a moved watermark changes it, a new
version supersedes the last one, and both stay on record.

Each micro-batch writes its rows, the progress by source, period and version (that of the batch before, plus its own),
the watermarks that follow, and gold of the periods that it touches. All of these lie in folders named by the batch or
are overwritten by period, so a batch that is tried again leaves the same tables. Only progress, a row a version, is
carried on; rows are read again for touched periods alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.registry import query
from tidemark.session import work_dir
from tidemark.sources.tables import money, table

DELIVERY = "source string, period date, version int, declared long, value long"
_PROGRESS = "source string, period date, version int, arrived long, declared long"
_MARKS = "source string, watermark date, rewound boolean, reopened int"
_INSIGHTS = "source string, week date, version int, n long, value long, final_days int, watermark date, bundle string, previous string"


def newest(progress: DataFrame) -> DataFrame:
    """source, period, version, complete: the newest version of each period."""
    last = progress.groupBy("source", "period").agg(F.max(F.struct("version", "arrived", "declared")).alias("x"))
    return last.select("source", "period", "x.version", (F.col("x.arrived") >= F.col("x.declared")).alias("complete"))


def watermarks(progress: DataFrame) -> DataFrame:
    """source, watermark: null while the first period is open."""
    start = progress.agg(F.min("period").alias("start"))  # one row
    seen = newest(progress)
    place = F.row_number().over(Window.partitionBy("source").orderBy("period"))
    run = seen.where("complete").crossJoin(start).withColumn("place", place).where(F.datediff("period", "start") == F.col("place") - 1)
    return seen.select("source").distinct().join(run.groupBy("source").agg(F.max("period").alias("watermark")), "source", "left")


class Ledger:
    """Tables of a stream of deliveries, under one folder of the shared storage."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def path(self, name: str, epoch: int | None = None) -> str:
        return f"{self.root}/{name}" + (f"/epoch={epoch}" if epoch is not None else "")

    def read(self, name: str, schema: str, epoch: int) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name, epoch)) if epoch >= 0 else self.spark.createDataFrame([], schema)

    def apply(self, batch: DataFrame, epoch: int) -> None:
        """What ``foreachBatch`` calls; micro-batches are numbered from 0 without gaps."""
        batch.select("source", "version", "value", "period").repartition("period").write.mode("overwrite").partitionBy("period").parquet(self.path("rows", epoch))
        own = batch.groupBy("source", "period", "version").agg(F.count(F.lit(1)).alias("arrived"), F.max("declared").alias("declared"))
        both = self.read("progress", _PROGRESS, epoch - 1).unionByName(own)
        both.groupBy("source", "period", "version").agg(F.sum("arrived").alias("arrived"), F.max("declared").alias("declared")).write.mode("overwrite").parquet(self.path("progress", epoch))
        progress = self.read("progress", _PROGRESS, epoch)
        before = self.read("marks", _MARKS, epoch - 1).select("source", F.col("watermark").alias("before"))
        back = F.col("before").isNotNull() & (F.col("watermark").isNull() | (F.col("watermark") < F.col("before")))
        start = progress.agg(F.date_sub(F.min("period"), 1).alias("none"))  # one row
        marks = watermarks(progress).join(before, "source", "left").crossJoin(start)
        reopened = F.when(back, F.datediff("before", F.coalesce("watermark", "none"))).otherwise(0)
        marks.select("source", "watermark", back.alias("rewound"), reopened.alias("reopened")).write.mode("overwrite").parquet(self.path("marks", epoch))
        self._gold(newest(progress), own)
        self._insights(epoch)

    def _gold(self, versions: DataFrame, touched: DataFrame) -> None:
        """Periods that the batch touches, computed again from the rows of their newest versions."""
        rows = self.spark.read.schema("source string, version int, value long, epoch int, period date").parquet(self.path("rows"))
        rows = rows.join(touched.select("period").distinct(), "period", "left_semi").join(versions.drop("complete"), ["source", "period", "version"])
        gold = rows.groupBy("source", "period").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).repartition("period")
        gold.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(self.path("gold"))

    def _insights(self, epoch: int) -> None:
        """A source's week as a bundle with a hash of what it says; a bundle that says something else is a new version, which
        names the one that it supersedes. The table has each week's newest version, the log has those of each batch."""
        g = self.gold(epoch).join(self.marks(epoch).select("source", "watermark"), "source")
        g = g.groupBy("source", F.trunc("period", "week").alias("week")).agg(F.sum("n").alias("n"), F.sum("value").alias("value"), F.count_if("final").cast("int").alias("final_days"), F.max("watermark").alias("watermark"))
        bundle = F.sha2(F.concat_ws("|", "source", F.col("week").cast("string"), "n", "value", "final_days"), 256)
        before = self.read("insights", _INSIGHTS, epoch - 1)
        old = before.select("source", "week", F.col("version").alias("v"), F.col("bundle").alias("said"))
        g = g.withColumn("bundle", bundle).join(old, ["source", "week"], "left")
        new = g.where(~F.col("bundle").eqNullSafe(F.col("said"))).select("source", "week", (F.coalesce("v", F.lit(0)) + 1).alias("version"), "n", "value", "final_days", "watermark", "bundle", F.col("said").alias("previous"))
        new.write.mode("overwrite").parquet(self.path("log", epoch))
        new = self.read("log", _INSIGHTS, epoch)
        before.join(new.select("source", "week"), ["source", "week"], "left_anti").unionByName(new).write.mode("overwrite").parquet(self.path("insights", epoch))

    def run(self, landing: str) -> int:
        """Take in all files that are new in ``landing``; the last micro-batch's number."""
        stream = self.spark.readStream.schema(DELIVERY).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(landing)
        q = stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", self.path("checkpoint")).trigger(availableNow=True).start()
        q.awaitTermination()
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path("marks"))
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(at)
        return max(int(f.getPath().getName().removeprefix("epoch=")) for f in found)

    def marks(self, epoch: int) -> DataFrame:
        return self.read("marks", _MARKS, epoch)

    def chain(self) -> DataFrame:
        """All versions of all bundles, and the batch of each."""
        return self.spark.read.schema(f"{_INSIGHTS}, epoch int").parquet(self.path("log"))

    def gold(self, epoch: int) -> DataFrame:
        """source, period, n, value, final: whether the period lies at or before its source's watermark."""
        gold = self.spark.read.schema("source string, n long, value long, period date").parquet(self.path("gold"))
        final = F.coalesce(F.col("period") <= F.col("watermark"), F.lit(False))
        return gold.join(self.marks(epoch).select("source", "watermark"), "source").select("source", "period", "n", "value", final.alias("final"))


#: Days that the first and the second run end before; days that the second run restates in part and the third in full.
FIRST, SECOND, FROM, TO = 20, 25, 7, 13


def deliveries(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of ``events`` as three runs would bring them: run, source, period, version, declared, value."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("source"), F.to_date("ts").alias("period"), "event_id", money(F.col("value"), 100).alias("value"))
    said = e.groupBy("source", "period").agg(F.count(F.lit(1)).alias("declared"))
    e = e.join(said, ["source", "period"]).crossJoin(e.agg(F.min("period").alias("start")))  # one row
    t = F.datediff("period", "start")
    plain = e.select(F.when(t < FIRST, 1).when(t < SECOND, 2).otherwise(3).alias("run"), "source", "period", F.lit(1).alias("version"), "declared", "value")
    again = e.where(t.between(FROM, TO)).select(F.when(F.col("event_id") % 2 == 0, 2).otherwise(3).alias("run"), "source", "period", F.lit(2).alias("version"), "declared", (F.col("value") + 5).alias("value"))
    return plain.union(again)


def three_runs(spark: SparkSession, sf: str) -> tuple[Ledger, list[int]]:
    root = work_dir(spark, "ledger")
    d, ledger, epochs = deliveries(spark, sf), Ledger(spark, root), []
    for run in (1, 2, 3):
        d.where(F.col("run") == run).drop("run").write.parquet(f"{root}/landing/run{run}")
        epochs.append(ledger.run(f"{root}/landing"))
    return ledger, epochs


_SQL = f"""with e as (select event_type as source, cast(ts as date) as period, event_id, cast(round(value * 100) as bigint) as value, date_diff('day', min(cast(ts as date)) over (), cast(ts as date)) as t from events),
  dl as (select source, period, 1 as version, case when t < {FIRST} then 1 when t < {SECOND} then 2 else 3 end as run, value from e union all select source, period, 2, case when event_id % 2 = 0 then 2 else 3 end, value + 5 from e where t between {FROM} and {TO}),
  dc as (select source, period, count(*) as declared from e group by all), runs as (select unnest([1, 2, 3]) as r),
  ar as (select r, source, period, version, count(*) as n, sum(value)::bigint as value from dl join runs on run <= r group by all),
  nw as (select r, source, period, max(version) as version from ar group by all),
  cp as (select nw.r, nw.source, nw.period from nw join ar using (r, source, period, version) join dc using (source, period) where n >= declared),
  st as (select r, min(period) as s from nw group by r),
  rn as (select cp.*, row_number() over (partition by cp.r, source order by period) - 1 as rn, date_diff('day', s, period) as k from cp join st using (r)),
  wm as (select x.r, x.source, s, max(case when rn = k then rn.period end) as watermark from (select distinct r, source from nw) x join st using (r) left join rn on rn.r = x.r and rn.source = x.source group by all)"""


@query("watermark_rewind", f"{_SQL}, l as (select *, lag(watermark) over (partition by source order by r) as before from wm) select r::int as run, source, watermark, before is not null and (watermark is null or watermark < before) as rewound, case when before is not null and (watermark is null or watermark < before) then date_diff('day', coalesce(watermark, s - 1), before) else 0 end::int as reopened from l")
def watermark_rewind(spark: SparkSession, sf: str) -> DataFrame:
    """Each source's watermark after three runs of one stream: the second restates a week in part, the third completes it."""
    ledger, epochs = three_runs(spark, sf)
    out = None
    for run, epoch in enumerate(epochs, 1):
        one = ledger.marks(epoch).select(F.lit(run).alias("run"), "source", "watermark", "rewound", "reopened")
        out = one if out is None else out.union(one)
    return out


@query("watermark_gold", f"{_SQL} select source, period, ar.n, ar.value, coalesce(period <= watermark, false) as final from nw join ar using (r, source, period, version) join wm using (r, source) where r = 3")
def watermark_gold(spark: SparkSession, sf: str) -> DataFrame:
    """Gold by source and day after the same runs, as restated, and which days are final."""
    ledger, epochs = three_runs(spark, sf)
    return ledger.gold(epochs[-1])


@query("insight_chain", f"""{_SQL}, gd as (select r, source, period, ar.n, ar.value, coalesce(period <= watermark, false) as final from nw join ar using (r, source, period, version) join wm using (r, source)),
  wk as (select r, source, date_trunc('week', period)::date as week, sum(n)::bigint as n, sum(value)::bigint as value, count(*) filter (final)::int as final_days from gd group by all),
  hs as (select *, sha256(concat_ws('|', source, week, n, value, final_days)) as bundle from wk), lg as (select *, lag(bundle) over (partition by source, week order by r) as previous from hs)
  select r::int as run, source, week, row_number() over (partition by source, week order by r)::int as version, n, value, final_days, bundle, previous from lg where bundle is distinct from previous""")
def insight_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Each source's weeks as they were told after each run of the same stream, every version with the one it supersedes."""
    ledger, epochs = three_runs(spark, sf)
    run = sum((F.when(F.col("epoch") > e, 1).otherwise(0) for e in epochs), F.lit(1))
    return ledger.chain().select(run.alias("run"), "source", "week", "version", "n", "value", "final_days", "bundle", "previous")
