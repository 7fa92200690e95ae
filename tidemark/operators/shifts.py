"""Changepoints of many series: pruned dynamic programming by series, and CUSUM alarms that it confirms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.series import with_cusum
from tidemark.registry import query
from tidemark.session import written
from tidemark.sources.tables import sales

#: Points of a segment at least, weight of the penalty, threshold of CUSUM, and weeks within which both must agree.
SHORTEST, WEIGHT, ALARM, NEAR = 4, 3.0, 5.0, 6
_MONDAY = "1995-01-02"


def penalty(y: np.ndarray, weight: float = WEIGHT) -> float:
    """What a changepoint costs: the noise's variance, by the MAD of first differences, times the log of the length."""
    step = np.diff(y)
    sigma = 1.4826 * np.median(np.abs(step - np.median(step))) / np.sqrt(2) if len(step) else 0.0
    return weight * max(float(sigma) ** 2, 1e-12) * np.log(max(len(y), 2))


def pelt(y: np.ndarray, cost_of_one: float, shortest: int = SHORTEST, prune: bool = True) -> list[int]:
    """Beginnings of the segments but the first, for shifts of the mean: the least sum of squares plus a cost for each.

    best[t] is the least cost of the first t points. A beginning that is already worse than best[t] can't be part of a
    better division later on, as no segment costs less than nothing, and is dropped: time grows with the length as long as
    changes do.
    """
    n = len(y)
    total, squares = np.r_[0.0, np.cumsum(y)], np.r_[0.0, np.cumsum(y * y)]
    best, last = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
    best[0] = -cost_of_one
    begins = np.zeros(0, dtype=np.int64)
    for t in range(shortest, n + 1):
        begins = np.append(begins, t - shortest)
        cost = best[begins] + squares[t] - squares[begins] - (total[t] - total[begins]) ** 2 / (t - begins)
        k = int(np.argmin(cost))
        best[t], last[t] = cost[k] + cost_of_one, begins[k]
        if prune:
            begins = begins[cost <= best[t]]
    found, t = [], n
    while t > 0 and n >= shortest:
        t = int(last[t])
        if t > 0:
            found.append(t)
    return found[::-1]


def _shifts(frame: pd.DataFrame) -> pd.DataFrame:
    f = frame.sort_values("t")
    y, t = f["y"].to_numpy(float), f["t"].to_numpy()
    at = pelt(y, penalty(y))
    ends = [0, *at, len(y)]
    mean = [float(y[a:b].mean()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return pd.DataFrame({"series": f["series"].iloc[0], "t": t[at].astype("int32") if at else np.zeros(0, "int32"), "before": np.round(mean[:-1], 4), "after": np.round(mean[1:], 4), "weeks": np.diff(ends)[1:].astype("int64")})


def changepoints(series: DataFrame) -> DataFrame:
    """series, t (first point after a shift), before, after (means), weeks (how long it lasted). series: series, t, y."""
    return series.groupBy("series").applyInPandas(_shifts, "series string, t int, before double, after double, weeks long")


def weekly_by_segment(spark: SparkSession, sf: str) -> DataFrame:
    """series (region and segment), t (week), y: net revenue."""
    t = F.floor(F.datediff("d", F.lit(_MONDAY).cast("date")) / 7).cast("int")
    return sales(spark, sf).groupBy(F.concat_ws("/", "region", "segment").alias("series"), t.alias("t")).agg((F.sum("net_e4") / 10000.0).alias("y"))


def confirmed(series: DataFrame) -> DataFrame:
    """series, t, since, direction, shift: the first week of each run of CUSUM alarms, the week since which sums have grown,
    and the changepoint within NEAR weeks of that, null where there is none.

    Series are put on a robust scale first: their median, and the MAD of their steps.
    """
    own = Window.partitionBy("series").orderBy("t")
    step = series.withColumn("step", F.col("y") - F.lag("y").over(own))
    scale = step.groupBy("series").agg(F.median("y").alias("mid"), (1.4826 / 2**0.5 * F.median(F.abs("step"))).alias("sd"))
    z = series.join(scale, "series").withColumn("z", F.col("y") / F.nullif("sd", F.lit(0.0)) - F.col("mid") / F.nullif("sd", F.lit(0.0))).where("z is not null")
    sides = F.explode(F.array(F.struct(F.lit("up").alias("direction"), F.col("c_plus").alias("c")), F.struct(F.lit("down").alias("direction"), F.col("c_minus").alias("c"))))
    c = with_cusum(z).select("series", "t", sides.alias("x")).select("series", "t", "x.*")
    side = Window.partitionBy("series", "direction").orderBy("t")
    c = c.withColumns({"was": F.coalesce(F.lag("c").over(side), F.lit(0.0)), "since": F.max(F.when(F.col("c") <= 1e-9, F.col("t"))).over(side) + 1})
    first = c.where((F.col("c") > ALARM) & (F.col("was") <= ALARM)).select("series", "t", F.coalesce("since", "t").cast("int").alias("since"), "direction")
    shifts = written(changepoints(series), "shifts")
    near = first.join(shifts.select("series", F.col("t").alias("at"), (F.col("after") > F.col("before")).alias("rises")), "series", "left")
    fits = F.abs(F.col("at") - F.col("since")) <= NEAR
    same = F.col("rises") == (F.col("direction") == "up")
    return near.groupBy("series", "t", "since", "direction").agg(F.min_by("at", F.when(fits & same, F.struct(F.abs(F.col("at") - F.col("since")).alias("d"), F.col("at").alias("at")))).alias("shift"))


@query("pelt_changepoints")
def pelt_changepoints(spark: SparkSession, sf: str) -> DataFrame:
    """Shifts of weekly revenue by region and segment: how many, in which weeks, and between which means."""
    w = written(weekly_by_segment(spark, sf), "weekly")
    found = changepoints(w).groupBy("series").agg(F.sort_array(F.collect_list(F.struct("t", "before", "after"))).alias("shifts"))
    n = w.groupBy("series").agg(F.count(F.lit(1)).alias("weeks"))
    return n.join(found, "series", "left").select("series", "weeks", F.coalesce(F.size("shifts"), F.lit(0)).alias("n_shifts"), F.to_json("shifts").alias("shifts"))


@query("confirmed_shifts")
def confirmed_shifts(spark: SparkSession, sf: str) -> DataFrame:
    """CUSUM alarms of the same series, and the changepoints that confirm them."""
    return confirmed(written(weekly_by_segment(spark, sf), "weekly"))
