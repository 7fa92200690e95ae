"""Defects as transforms of clean feeds, and the operators that find them.

Each injector takes a feed and returns it damaged in one way, by keyed draws, so the damage is known; each detector
counts what it finds. ``pathology_report`` holds one against the other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.rng import uniform
from tidemark.operators.evidence import pii_mask
from tidemark.registry import query
from tidemark.session import written
from tidemark.sources.tables import table

Transform = Callable[[DataFrame], DataFrame]
DECLARED = ("event_id", "d", "event_type", "value", "batch_id", "ts")


def feed(spark: SparkSession, sf: str) -> DataFrame:
    """A clean daily feed: event_id, d, event_type, value, batch_id, ts in local time."""
    d = F.to_date("ts")
    return table(spark, sf, "events").select("event_id", d.alias("d"), "event_type", "value", F.date_format(d, "yyyyMMdd").alias("batch_id"), "ts")


def _day(x: str):
    return F.lit(x).cast("date")


def duplicate_batch(df: DataFrame) -> DataFrame:
    return df.unionByName(df.where(F.col("d") == _day("2024-01-10")))


def copied_rows(df: DataFrame) -> DataFrame:
    return df.unionByName(df.where(uniform("copy", "event_id") < 0.02).withColumn("batch_id", F.lit("again")))


def missing_days(df: DataFrame) -> DataFrame:
    return df.where(~F.col("d").between(_day("2024-01-12"), _day("2024-01-14")))


def renamed_column(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("value", "amount")


def changed_unit(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.when(F.col("d") >= _day("2024-01-20"), F.col("value") * 100).otherwise(F.col("value")))


def null_spike(df: DataFrame) -> DataFrame:
    hit = F.col("d").between(_day("2024-01-15"), _day("2024-01-17")) & (uniform("null", "event_id") < 0.4)
    return df.withColumn("value", F.when(~hit, F.col("value")))


def unknown_members(df: DataFrame) -> DataFrame:
    return df.withColumn("event_type", F.when(uniform("member", "event_id") < 0.03, F.lit("mystery")).otherwise(F.col("event_type")))


def restated(df: DataFrame) -> DataFrame:
    again = df.where(F.col("d") >= _day("2024-01-25")).withColumns({"value": F.round(F.col("value") * 1.05, 2), "batch_id": F.concat("batch_id", F.lit("-r"))})
    return df.unionByName(again)


def late_rows(df: DataFrame) -> DataFrame:
    return df.withColumn("batch_id", F.when(uniform("late", "event_id") < 0.05, F.date_format(F.date_add("d", 3), "yyyyMMdd")).otherwise(F.col("batch_id")))


def regime_break(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.when(F.col("d") >= _day("2024-01-16"), F.col("value") * 1.8).otherwise(F.col("value")))


def bulk_order(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.when(F.col("event_id") == 500, F.lit(1e6)).otherwise(F.col("value")))


def out_of_range(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.when(uniform("range", "event_id") < 0.01, -F.col("value")).otherwise(F.col("value")))


def utc_stamps(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.expr("ts - interval 330 minutes"))


def foreign_currency(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.when(F.col("event_type") == "purchase", F.round(F.col("value") / 83, 4)).otherwise(F.col("value")))


def changed_definition(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.when(F.col("d") >= _day("2024-01-16"), F.round(F.col("value") * 1.18, 2)).otherwise(F.col("value")))


def short_history(df: DataFrame) -> DataFrame:
    return df.where((F.col("event_type") != "signup") | (F.col("d") >= _day("2024-01-25")))


def intermittent(df: DataFrame) -> DataFrame:
    return df.where((F.col("event_type") != "error") | (F.day("d") % 3 == 0))


def moved_member(df: DataFrame) -> DataFrame:
    return df.withColumn("event_type", F.when((F.col("event_type") == "view") & (F.col("d") >= _day("2024-01-21")), F.lit("click")).otherwise(F.col("event_type")))


def partial_coverage(df: DataFrame) -> DataFrame:
    return df.where((F.col("d") < _day("2024-01-20")) | (uniform("cover", "event_id") < 0.6))


def _count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("found"))


def find_duplicate_batches(df: DataFrame) -> DataFrame:
    """Days of which every row came twice under one batch."""
    once = df.groupBy("batch_id", "event_id").agg(F.count(F.lit(1)).alias("n"))
    return _count(once.groupBy("batch_id").agg(F.min("n").alias("least")).where("least > 1"))


def find_copied_rows(df: DataFrame) -> DataFrame:
    return _count(df.groupBy("event_id").agg(F.count_distinct("batch_id").alias("n"), F.count_distinct("value").alias("v")).where("n > 1 and v = 1"))


def find_gaps(df: DataFrame) -> DataFrame:
    days = df.select("d").distinct().withColumn("gap", F.datediff(F.lead("d").over(Window.orderBy("d")), "d"))  # one row a day
    return days.where("gap > 1").agg(F.coalesce(F.sum(F.col("gap") - 1), F.lit(0)).alias("found"))


def find_drift(df: DataFrame) -> DataFrame:
    changed = len(set(df.columns) ^ set(DECLARED))
    return df.sparkSession.range(1).select(F.lit(changed).cast("long").alias("found"))


def _daily(df: DataFrame) -> DataFrame:
    w = Window.orderBy("d").rowsBetween(-7, -1)
    s = df.groupBy("d").agg(F.sum("value").alias("v"), F.avg(F.col("value").isNull().cast("int")).alias("nulls"))
    return s.withColumns({"before": F.avg("v").over(w), "n": F.count("v").over(w)}).where("n = 7")


def find_unit_jumps(df: DataFrame) -> DataFrame:
    return _count(_daily(df).where("v / before > 20"))


def find_null_spikes(df: DataFrame) -> DataFrame:
    return _count(_daily(df).where("nulls > 0.2"))


def find_unknown(df: DataFrame) -> DataFrame:
    return _count(df.where(~F.col("event_type").isin("click", "view", "purchase", "signup", "error")))


def find_restated(df: DataFrame) -> DataFrame:
    return _count(df.groupBy("event_id").agg(F.count_distinct("value").alias("v")).where("v > 1"))


def find_late(df: DataFrame) -> DataFrame:
    return _count(df.where(F.datediff(F.to_date("batch_id", "yyyyMMdd"), "d") > 1))


def find_break(df: DataFrame) -> DataFrame:
    """1 if the running deviation from the mean peaks above what noise would reach."""
    every = Window.partitionBy()
    s = df.groupBy("d").agg(F.sum("value").alias("v")).withColumn("x", (F.col("v") - F.avg("v").over(every)) / F.stddev("v").over(every))
    c = s.withColumn("c", F.sum("x").over(Window.orderBy("d")))
    return c.agg((F.max(F.abs("c")) / F.sqrt(F.count(F.lit(1))) > 1.6).cast("long").alias("found"))


def find_outliers(df: DataFrame) -> DataFrame:
    return _count(df.where("value > 10000"))


def find_negative(df: DataFrame) -> DataFrame:
    return _count(df.where("value < 0"))


def find_utc(df: DataFrame) -> DataFrame:
    return _count(df.where(F.to_date("ts") < F.to_date("batch_id", "yyyyMMdd")))


def find_foreign(df: DataFrame) -> DataFrame:
    """Members whose mean is a small part of the others' median mean."""
    m = df.groupBy("event_type").agg(F.avg("value").alias("m"))
    return _count(m.crossJoin(m.agg(F.median("m").alias("mid"))).where("m < 0.1 * mid"))


def find_definition(df: DataFrame) -> DataFrame:
    """1 if every member's mean rose by the same share between the halves."""
    late = F.col("d") >= _day("2024-01-16")
    m = df.groupBy("event_type").agg((F.avg(F.when(late, F.col("value"))) / F.avg(F.when(~late, F.col("value")))).alias("r"))
    return m.agg(((F.min("r") > 1.06) & (F.max("r") < 1.3)).cast("long").alias("found"))


def find_short(df: DataFrame) -> DataFrame:
    return _count(df.groupBy("event_type").agg(F.datediff(F.max("d"), F.min("d")).alias("span")).where("span < 14"))


def find_intermittent(df: DataFrame) -> DataFrame:
    days = df.groupBy("event_type").agg(F.count_distinct("d").alias("n"), (F.datediff(F.max("d"), F.min("d")) + 1).alias("span"))
    return _count(days.where("1 - n / span > 0.4"))


def find_moved(df: DataFrame) -> DataFrame:
    """Members that end before the feed does, while it goes on."""
    ends = df.groupBy("event_type").agg(F.max("d").alias("e"))
    return _count(ends.crossJoin(ends.agg(F.max("e").alias("last"))).where("datediff(last, e) > 3"))


def find_low_coverage(df: DataFrame) -> DataFrame:
    """Days with fewer than three quarters of the median day's rows, five or more of them."""
    n = df.groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    low = n.crossJoin(n.agg(F.median("n").alias("m"))).agg(F.count_if(F.col("n") < 0.75 * F.col("m")).alias("k"))
    return low.select(F.when(F.col("k") >= 5, F.col("k")).otherwise(0).alias("found"))


def weekly_cadence(df: DataFrame) -> DataFrame:
    """One member comes in one batch a week, on its Monday."""
    monday = F.date_format(F.trunc("d", "week"), "yyyyMMdd")
    return df.withColumn("batch_id", F.when(F.col("event_type") == "signup", monday).otherwise(F.col("batch_id")))


def weekly_grain(df: DataFrame) -> DataFrame:
    """One member comes as a total a week."""
    week = df.where("event_type = 'view'").groupBy(F.trunc("d", "week").alias("d"), "event_type").agg(F.min("event_id").alias("event_id"), F.sum("value").alias("value"), F.min("batch_id").alias("batch_id"), F.min("ts").alias("ts"))
    return df.where("event_type <> 'view'").unionByName(week.select(*df.columns))


def misspelt_members(df: DataFrame) -> DataFrame:
    return df.withColumn("event_type", F.when(uniform("spelt", "event_id") < 0.02, F.concat(F.substring("event_type", 1, 2), F.substring(F.col("event_type"), F.lit(4), F.lit(50)))).otherwise(F.col("event_type")))


def sparse_launch(df: DataFrame) -> DataFrame:
    """A new member in the last days, like another one."""
    return df.unionByName(df.where((F.col("event_type") == "click") & (F.col("d") >= _day("2024-01-25"))).withColumn("event_type", F.lit("launched")))


def collinear_drivers(df: DataFrame) -> DataFrame:
    """A member whose every day is another one's, but for a factor."""
    return df.where("event_type <> 'view'").unionByName(df.where("event_type = 'click'").withColumns({"event_type": F.lit("view"), "value": F.col("value") * 1.7}))


def reversed_mix(df: DataFrame) -> DataFrame:
    """From the middle on every member's values fall, but the dear one sells five times as often: the mean of all rises."""
    late = F.col("d") >= _day("2024-01-16")
    fall = df.withColumn("value", F.when(late, F.col("value") * 0.9).otherwise(F.col("value")) * F.when(F.col("event_type") == "purchase", 20).otherwise(1))
    return fall.withColumn("k", F.explode(F.when(late & (F.col("event_type") == "purchase"), F.sequence(F.lit(1), F.lit(5))).otherwise(F.array(F.lit(1))))).drop("k")


def find_slow_cadence(df: DataFrame) -> DataFrame:
    """Members whose batches hold several days."""
    b = df.groupBy("event_type", "batch_id").agg(F.count_distinct("d").alias("days"))
    return _count(b.groupBy("event_type").agg(F.median("days").alias("days")).where("days > 3"))


def find_coarse_grain(df: DataFrame) -> DataFrame:
    """Members with rows on Mondays alone, over two weeks or more."""
    w = df.groupBy("event_type").agg(F.bool_and(F.weekday("d") == 0).alias("mondays"), F.count_distinct("d").alias("n"))
    return _count(w.where("mondays and n >= 3"))


def find_misspelt(df: DataFrame) -> DataFrame:
    """Rare members that are an edit or two away from a frequent one."""
    n = df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))  # one row
    often, rare = n.crossJoin(total).where("n > 0.05 * total").select(F.col("event_type").alias("known")), n.crossJoin(total).where("n <= 0.05 * total").select("event_type")
    return _count(rare.join(often, F.levenshtein("event_type", "known").between(1, 2)).select("event_type").distinct())


def find_launch(df: DataFrame) -> DataFrame:
    """Members that begin in the feed's last third."""
    m = df.groupBy("event_type").agg(F.min("d").alias("first"))
    return _count(m.crossJoin(df.agg(F.min("d").alias("low"), F.max("d").alias("high"))).where("datediff(first, low) > 2 * datediff(high, low) / 3"))


def find_collinear(df: DataFrame) -> DataFrame:
    """Pairs of members whose daily totals move as one."""
    t = df.groupBy("event_type", "d").agg(F.sum("value").alias("v"))
    pairs = t.join(t.select("d", F.col("event_type").alias("other"), F.col("v").alias("w")), "d").where("event_type < other")  # a few members
    return _count(pairs.groupBy("event_type", "other").agg(F.corr("v", "w").alias("r")).where("r > 0.98"))


def find_reversal(df: DataFrame) -> DataFrame:
    """1 if every member's mean moved against the mean of all between the halves."""
    late = F.col("d") >= _day("2024-01-16")
    step = F.avg(F.when(late, F.col("value"))) - F.avg(F.when(~late, F.col("value")))
    members = df.groupBy("event_type").agg(step.alias("own"))
    return members.crossJoin(df.agg(step.alias("whole"))).agg(F.bool_and(F.signum("own") * F.signum("whole") < 0).cast("long").alias("found"))


def stories(spark: SparkSession, sf: str) -> DataFrame:
    """A clean corpus: doc_id, source, text; each text once, personal data masked."""
    d = table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("t")).agg(F.min_by(F.struct("doc_id", "source", "text"), "doc_id").alias("x")).select("x.*")
    return d.withColumn("text", pii_mask(F.col("text")))


def syndicated(df: DataFrame) -> DataFrame:
    return df.unionByName(df.where(uniform("copy", "doc_id") < 0.05).withColumns({"source": F.lit("agency"), "doc_id": F.col("doc_id") + 10_000_000}))


def personal_data(df: DataFrame) -> DataFrame:
    said = F.concat("text", F.lit(" write to jo.doe@example.org or call +49 170 5557713"))
    return df.withColumn("text", F.when(uniform("pii", "doc_id") < 0.05, said).otherwise(F.col("text")))


def find_syndicated(df: DataFrame) -> DataFrame:
    return _count(df.groupBy(F.sha2("text", 256)).agg(F.count_distinct("source").alias("n")).where("n > 1"))


def find_personal(df: DataFrame) -> DataFrame:
    return _count(df.where(pii_mask(F.col("text")) != F.col("text")))


CATALOGUE: dict[str, tuple[Transform, Transform]] = {
    "duplicate_batch": (duplicate_batch, find_duplicate_batches),
    "copied_rows": (copied_rows, find_copied_rows),
    "missing_days": (missing_days, find_gaps),
    "renamed_column": (renamed_column, find_drift),
    "changed_unit": (changed_unit, find_unit_jumps),
    "null_spike": (null_spike, find_null_spikes),
    "unknown_members": (unknown_members, find_unknown),
    "restated": (restated, find_restated),
    "late_rows": (late_rows, find_late),
    "regime_break": (regime_break, find_break),
    "bulk_order": (bulk_order, find_outliers),
    "out_of_range": (out_of_range, find_negative),
    "utc_stamps": (utc_stamps, find_utc),
    "foreign_currency": (foreign_currency, find_foreign),
    "changed_definition": (changed_definition, find_definition),
    "short_history": (short_history, find_short),
    "intermittent": (intermittent, find_intermittent),
    "moved_member": (moved_member, find_moved),
    "partial_coverage": (partial_coverage, find_low_coverage),
    "weekly_cadence": (weekly_cadence, find_slow_cadence),
    "weekly_grain": (weekly_grain, find_coarse_grain),
    "misspelt_members": (misspelt_members, find_misspelt),
    "sparse_launch": (sparse_launch, find_launch),
    "collinear_drivers": (collinear_drivers, find_collinear),
    "reversed_mix": (reversed_mix, find_reversal),
}
#: Those of a corpus.
TEXTS: dict[str, tuple[Transform, Transform]] = {"syndicated": (syndicated, find_syndicated), "personal_data": (personal_data, find_personal)}


@query("pathology_report")
def pathology_report(spark: SparkSession, sf: str) -> DataFrame:
    """What each detector finds in the clean feed and in the damaged one."""
    out, events, texts = None, feed(spark, sf), written(stories(spark, sf), "stories")
    for name, (inject, find) in {**CATALOGUE, **TEXTS}.items():
        clean = texts if name in TEXTS else events
        for kind, df in (("clean", clean), ("damaged", inject(clean))):
            row = find(df).select(F.lit(name).alias("defect"), F.lit(kind).alias("feed"), F.col("found").cast("long").alias("found"))
            out = row if out is None else out.unionByName(row)
    return out.groupBy("defect").agg(*[F.max(F.when(F.col("feed") == k, F.col("found"))).alias(k) for k in ("clean", "damaged")])
