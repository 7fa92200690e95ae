"""Data as it arrives: files to bronze, rollups in event time, and a state machine of freshness."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.registry import query
from tidemark.session import work_dir

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event files as a stream, in event time that watermarks understand."""
    s = spark.readStream.schema(EVENTS).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 8).parquet(f"{sf_dir}/events.parquet*")
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_table(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """What a stream yields for all files there are, as written in the shared folder."""
    spark = stream.sparkSession
    out = work_dir(spark, "stream")
    schema = stream.schema

    def write(batch: DataFrame, epoch: int) -> None:
        # a batch that is tried again overwrites its own folder
        batch.write.mode("overwrite").parquet(f"{out}/data/epoch={epoch}")
        if each:
            each(batch, epoch)

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    told = T.StructType([*schema.fields, T.StructField("epoch", T.IntegerType())])
    if not _exists(spark, f"{out}/data"):
        return spark.createDataFrame([], told)  # no file, so no batch
    return spark.read.schema(told).parquet(f"{out}/data")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


@query("stream_ingest", "select distinct event_id, ts, event_type, value from events")
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Files to bronze: duplicates within the watermark go, rows carry their batch."""
    s = event_stream(spark, sf).withWatermark("ts", "40 days").dropDuplicatesWithinWatermark(["event_id"])
    return run_to_table(s.select("event_id", "ts", "event_type", "value")).select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type", "value")


def _complete(stream: DataFrame) -> DataFrame:
    """The last state of an aggregation that is told whole at each trigger."""
    told = run_to_table(stream, "complete")
    last = told.agg(F.max("epoch").alias("last"))
    return told.join(F.broadcast(last), F.col("epoch") == F.col("last")).drop("epoch", "last")


@query("stream_tumbling", "select date_trunc('week', ts)::date as week, event_type, count(*) as n, sum(cast(round(value * 100) as bigint))::bigint as v from events group by all")
def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    """Weeks from Monday: the epoch was a Thursday, so windows start four days later."""
    w = F.window("ts", "7 days", None, "4 days")
    g = event_stream(spark, sf).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("v"))
    return _complete(g.select(F.to_date("w.start").alias("week"), "event_type", "n", "v"))


@query("stream_sliding", "select w, count(*) as n, count(*) filter (event_type = 'error') as errors from (select event_type, unnest([date_trunc('hour', ts) - case when minute(ts) < 30 then interval 30 minute else interval 0 minute end, date_trunc('hour', ts) + case when minute(ts) < 30 then interval 0 minute else interval 30 minute end]) as w from events) group by w")
def stream_sliding(spark: SparkSession, sf: str) -> DataFrame:
    """Error counts of each hour, every half hour."""
    g = event_stream(spark, sf).groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return _complete(g.select(F.col("w.start").cast("timestamp_ntz").alias("w"), "n", "errors"))


@query("stream_session", "with g as (select user_id, ts, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 6 hour then 1 when lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as new from events), s as (select user_id, ts, sum(new) over (partition by user_id order by ts) as k from g) select user_id, min(ts) as first_ts, count(*) as n from s group by user_id, k")
def stream_session(spark: SparkSession, sf: str) -> DataFrame:
    """Bursts of a user's events with less than six hours between them."""
    g = event_stream(spark, sf).withWatermark("ts", "40 days").groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.min("ts").alias("first_ts"), F.count(F.lit(1)).alias("n"))
    return _complete(g.select("user_id", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), "n"))


#: Seconds of a slot; slots without rows after which a source is amber, and red; slots in which late rows are still taken.
SLOT, AMBER, RED, HORIZON = 1800, 3, 6, 48 * 60


def _gaps(at: np.ndarray) -> tuple[int, int]:
    gaps = np.diff(at)
    return int(((gaps > AMBER) & (gaps <= RED)).sum()), int((gaps > RED).sum())


def _freshness(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """The slots in which a source was seen, as a bitmap: a late row that fills a gap takes its breach back.

    What lies more than HORIZON slots behind the newest one is settled: its gaps and slots are kept as numbers, and rows
    that come for it afterwards change nothing.
    """
    first, bits, amber, red, slots = state.get if state.exists else (0, b"", 0, 0, 0)
    seen = set((first + np.flatnonzero(np.unpackbits(np.frombuffer(bits, dtype=np.uint8)))).tolist()) if bits else set()
    for f in frames:
        seen |= {x for x in (f["at"] // SLOT).tolist() if not slots or x >= first}
    at = np.array(sorted(seen), dtype=np.int64)
    old = max(0, int((at <= at[-1] - HORIZON).sum()) - 1)  # the last of them stays, as a gap begins with it
    if old:
        more = _gaps(at[: old + 1])
        amber, red, slots, at = amber + more[0], red + more[1], slots + old, at[old:]
    marks = np.zeros(int(at[-1] - at[0]) + 1, dtype=bool)
    marks[at - at[0]] = True
    state.update((int(at[0]), np.packbits(marks).tobytes(), amber, red, slots))
    more = _gaps(at)
    yield pd.DataFrame({"event_type": [key[0]], "last_at": [int(at[-1]) * SLOT], "amber": [amber + more[0]], "red": [red + more[1]], "slots": [slots + len(at)]})


@query("freshness_state", f"with e as (select distinct event_type, floor(epoch(ts) / {SLOT})::bigint as slot from events), l as (select *, slot - lag(slot) over (partition by event_type order by slot) as gap from e), g as (select event_type, max(slot) * {SLOT} as last_at, count(*) filter (gap > {AMBER} and gap <= {RED}) as amber, count(*) filter (gap > {RED}) as red, count(*) as slots from l group by event_type), c as (select max(slot) as now_ from e) select event_type, last_at, amber, red, slots, case when now_ - last_at / {SLOT} > {RED} then 'red' when now_ - last_at / {SLOT} > {AMBER} then 'amber' else 'green' end as status from g, c")
def freshness_state(spark: SparkSession, sf: str) -> DataFrame:
    """Per source: newest slot, how often it went amber and red, and its status against the newest of all, kept as state across batches."""
    s = event_stream(spark, sf).select("event_type", F.col("ts").cast("long").alias("at"))
    told = s.groupBy("event_type").applyInPandasWithState(_freshness, "event_type string, last_at long, amber long, red long, slots long", "first long, bits binary, amber long, red long, slots long", "update", "NoTimeout")
    rows = run_to_table(told, "update")
    last = rows.groupBy("event_type").agg(F.max_by(F.struct("last_at", "amber", "red", "slots"), "epoch").alias("x")).select("event_type", "x.*")
    behind = (F.max("last_at").over(Window.partitionBy()) - F.col("last_at")) / SLOT  # a row a source
    return last.withColumn("status", F.when(behind > RED, "red").when(behind > AMBER, "amber").otherwise("green"))
