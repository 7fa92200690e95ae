"""Freshness of sources by timers in event time: a source turns amber and red although nothing of it arrives.

Each source keeps its newest mark and its status. A row sets a timer for the moment at which the source would turn
amber; that timer sets the one for red. The watermark of the whole stream, which other sources' rows move, fires them.
Control rows pause a source, which stops its clock, and resume it. Gaps between rows of one batch are told as the timers
would have told them, so what is told doesn't depend on how rows fall into batches; rows behind the watermark are
dropped. State is four values a source, whatever the stream's length.

Event time has timers but no time to live, which Spark gives to processing time alone; state is bounded without it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.registry import query
from tidemark.session import work_dir
from tidemark.sources.tables import table

#: Milliseconds without a row after which a source is amber, and red; how late rows may be.
AMBER_MS, RED_MS, LATE_MS = 90 * 60_000, 180 * 60_000, 60_000
MARKS, TOLD = "source string, at_ms long, kind string", "source string, at_ms long, status string"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Clock(StatefulProcessor):
    """The clock of one source. A mark is a row ('data') or a control row ('pause', 'resume')."""

    def __init__(self, amber: int = AMBER_MS, red: int = RED_MS):
        self.limits = [(amber, "amber"), (red, "red")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("clock", "at_ms long, status string, paused boolean")

    def _told(self, key: tuple, rows: list[tuple[int, str]]) -> pd.DataFrame:
        return pd.DataFrame({"source": [key[0]] * len(rows), "at_ms": [a for a, _ in rows], "status": [s for _, s in rows]})

    def _next(self, at: int, status: str) -> int | None:
        """When the status would get worse."""
        return {"green": at + self.limits[0][0], "amber": at + self.limits[1][0]}.get(status)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        at, status, paused = self.state.get() if self.state.exists() else (None, None, False)
        out = []
        marks = pd.concat(list(rows)).sort_values(["at_ms", "kind"])
        for now, kind in zip(marks["at_ms"].tolist(), marks["kind"].tolist(), strict=True):
            for limit, name in self.limits if at is not None and not paused else []:
                if now > at + limit and (name, status) in (("amber", "green"), ("red", "green"), ("red", "amber")):
                    out.append((at + limit, name))
                    status = name
            if kind == "pause":
                out.append((now, "paused"))
                status, paused = "paused", True
            elif kind == "resume" or (status != "green" and not paused):
                out.append((now, "green"))
                status, paused = "green", False
            at = now if at is None else max(at, now)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not paused and (due := self._next(at, status)) is not None:
            self.handle.registerTimer(due)
        self.state.update((at, status, paused))
        if out:
            yield self._told(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        at, status, paused = self.state.get()
        due = expiredTimerInfo.getExpiryTimeInMs()
        if paused or self._next(at, status) != due:
            return
        out = []
        while due is not None and due <= timerValues.getCurrentWatermarkInMs():  # the watermark may have passed both limits
            status = {"green": "amber", "amber": "red"}[status]
            out.append((due, status))
            due = self._next(at, status)
        if due is not None:
            self.handle.registerTimer(due)
        self.state.update((at, status, paused))
        yield self._told(key, out)

    def close(self) -> None:
        pass


def tell(spark: SparkSession, landing: str, root: str, amber: int = AMBER_MS, red: int = RED_MS) -> None:
    """Take in all files that are new in ``landing`` (MARKS) and add what changes to ``root``/told."""
    marks = spark.readStream.schema(MARKS).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(landing)
    marks = marks.withColumn("ts", F.timestamp_millis("at_ms")).withWatermark("ts", f"{LATE_MS} milliseconds")
    told = marks.groupBy("source").transformWithStateInPandas(Clock(amber, red), outputStructType=TOLD, outputMode="Update", timeMode="EventTime")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/told/epoch={epoch}")

    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)  # timers need it
    try:
        told.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_STORE, before)


def told(spark: SparkSession, root: str) -> DataFrame:
    """source, at_ms, status: all changes so far."""
    return spark.read.schema(f"{TOLD}, epoch int").parquet(f"{root}/told").select("source", "at_ms", "status")


#: The first source, by name, is paused from the start of this day of the table to the start of that one.
PAUSE, RESUME = 10, 12


def marks(spark: SparkSession, sf: str) -> DataFrame:
    """source, at_ms, kind, slice: rows of ``events`` with a pause of one source, cut into three slices of ten days."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("source"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    ends = e.agg((F.floor(F.min("at_ms") / 86_400_000) * 86_400_000).alias("start"), F.min("source").alias("first"))  # one row
    rows = e.crossJoin(ends).select("source", "at_ms", F.lit("data").alias("kind"), "start")
    control = ends.select(F.col("first").alias("source"), F.explode(F.array(F.struct(F.lit(PAUSE).alias("d"), F.lit("pause").alias("kind")), F.struct(F.lit(RESUME).alias("d"), F.lit("resume").alias("kind")))).alias("x"), "start")
    both = rows.union(control.select("source", (F.col("start") + F.col("x.d") * 86_400_000).cast("long"), "x.kind", "start"))
    return both.select("source", "at_ms", "kind", F.least(F.lit(2), F.floor((F.col("at_ms") - F.col("start")) / 864_000_000)).cast("int").alias("slice"))


@query(
    "freshness_timers",
    f"""with e as (select event_type as source, (epoch_us(ts) // 1000)::bigint as at_ms from events), s as (select min(at_ms) // 86400000 * 86400000 as start, min(source) as first_, max(at_ms) as last_ from e),
  m as (select source, at_ms, 'data' as kind from e union all select first_, start + {PAUSE} * 86400000, 'pause' from s union all select first_, start + {RESUME} * 86400000, 'resume' from s),
  p as (select *, coalesce(last_value(case when kind <> 'data' then kind end ignore nulls) over (partition by source order by at_ms, kind rows between unbounded preceding and current row), '') = 'pause' as paused, lead(at_ms) over w as next_at, lead(kind) over w as next_kind, row_number() over w as rn from m window w as (partition by source order by at_ms, kind)),
  c as (select p.*, last_ from p, s),
  late as (select source, at_ms + g.ms as at_ms, g.status from c, (values ({AMBER_MS}, 'amber'), ({RED_MS}, 'red')) g(ms, status) where not paused and case when next_at is null then last_ - {LATE_MS} >= at_ms + g.ms else next_at > at_ms + g.ms end),
  up as (select source, next_at as at_ms, 'green' as status from c where next_kind = 'data' and not paused and next_at > at_ms + {AMBER_MS})
  select source, at_ms, status from late union all select * from up union all select source, at_ms, 'green' from c where (rn = 1 and kind = 'data') or kind = 'resume' union all select source, at_ms, 'paused' from c where kind = 'pause'""",
)
def freshness_timers(spark: SparkSession, sf: str) -> DataFrame:
    """Every change of every source's freshness, as timers tell it over three runs of one stream."""
    root, m = work_dir(spark, "freshness"), marks(spark, sf)
    for k in range(3):
        m.where(F.col("slice") == k).drop("slice").write.parquet(f"{root}/landing/slice{k}")
        tell(spark, f"{root}/landing", root)
    return told(spark, root)
