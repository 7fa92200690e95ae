"""Mixing sources to target weights by fitting a subset sum to each source's budget.

Documents are counted by source and exact length in words. A source whose target is above its size is taken whole
as often as fits; for the budget that remains, each length gives its proportional share, then the longest lengths
that still fit, and bounded-knapsack dynamic programming over exact lengths fills what is left. Only these counts,
one row for each length of a source, meet in a task. Which documents of a length are taken follows a seeded hash:
each length is dealt into ``BUCKETS`` hash buckets, counts tell how many are needed of each, and rows are ranked
within a bucket, so a length that holds a third of all rows is ranked in pieces.

Defined cases: a null text has size 0; a very long text counts whole, and is one length like others; the null source comes last and is a source like others; a source of size 0
has target 0; rows that share an id are ranked by hash and text hash, and of rows equal in both any may be the ones taken; of sums
equally near to a budget the lower counts; columns of the input named like a result give way to it; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import boxed, materialize, table, unboxed, words

WEIGHTS = (3, 1, 2)
#: Words to take for each word there is.
SHARE = 1.5
#: A source gives at most this many times its words.
MOST = 2
BUCKETS = 1024
#: The dynamic programme fills at least this many words, if there are as many left.
FILL = 4096


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size -> and rank, target: shares by weight, none above ``most`` times its source's size.

    Sources are ordered by the level at which they reach their limit. The level that all others share is the
    highest one that is not reached, as in filling vessels with water.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    n = len(weights)
    w = w.withColumn("weight", F.get(F.array(*[F.lit(float(x)) for x in weights]), F.col("rank") % n)).withColumn("most", most * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    level = (share * F.sum("source_size").over(everything) - (F.sum("most").over(order) - F.col("most"))) / (F.sum("weight").over(everything) - (F.sum("weight").over(order) - F.col("weight")))
    w = w.withColumn("level", level).withColumn("full", F.col("most") <= F.col("weight") * F.col("level"))
    shared = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    return w.withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * shared)).select("source", "rank", "source_size", "target")


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, fill: int = FILL) -> np.ndarray:
    """How many documents of each length to take, so that their words come near ``budget``: exactly, where the
    lengths that are left allow it, and else on the nearer side.

    lengths: distinct, above 0.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    take = counts * budget // total if total else counts * 0  # floors of shares: their sum is within the budget
    left = budget - int((lengths * take).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if left <= fill:
            break
        more = min(int(counts[i] - take[i]), (left - fill) // int(lengths[i]))
        take[i] += more
        left -= more * int(lengths[i])
    if left > 0:
        take = take + _nearest(lengths, counts - take, left)
    if (lengths * take).sum() != budget and budget <= 16 * fill:  # too few documents to keep their shares by length
        again = _nearest(lengths, counts, budget)
        take = min(take, again, key=lambda t: abs(int((lengths * t).sum()) - budget))
    return take


def _nearest(lengths: np.ndarray, counts: np.ndarray, goal: int) -> np.ndarray:
    found = _knapsack(lengths, counts, goal, goal)
    gap = goal - int((lengths * found).sum())
    return _knapsack(lengths, counts, goal + gap - 1, goal) if gap > 1 else found  # a sum above may be nearer


def _knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int, goal: int) -> np.ndarray:
    """The reachable sum of at most ``budget`` that is nearest to ``goal``. Counts are split into powers of two."""
    reached = np.zeros(budget + 1, dtype=bool)
    reached[0] = True
    by = np.full(budget + 1, -1, dtype=np.int64)
    pieces: list[tuple[int, int]] = []
    for i in np.argsort(-lengths, kind="stable"):
        length, n, k = int(lengths[i]), int(min(counts[i], budget // max(1, lengths[i]))), 1
        while n > 0 and not reached[goal]:
            k = min(k, n)
            step = k * length
            if step > budget:
                break
            fresh = np.zeros_like(reached)
            fresh[step:] = reached[:-step]
            fresh &= ~reached
            by[fresh] = len(pieces)
            reached |= fresh
            pieces.append((int(i), k))
            n -= k
            k *= 2
    take = np.zeros(len(lengths), dtype=np.int64)
    sums = np.flatnonzero(reached)
    at = int(sums[np.abs(sums - goal).argmin()])
    while at > 0:
        i, k = pieces[by[at]]
        take[i] += k
        at -= k * int(lengths[i])
    return take


def _fit_source(group: pd.DataFrame) -> pd.DataFrame:
    group = group[group["size"] > 0].sort_values("size")
    target, source_size = float(group["target"].iloc[0]) if len(group) else 0.0, int((group["size"] * group["n"]).sum())
    whole = int(target // source_size) if source_size else 0
    more = fit(group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64), round(target - whole * source_size))
    return pd.DataFrame({"rank": group["rank"], "size": group["size"], "whole": whole, "take": more})


def _mixed(df: DataFrame, ident: str, text: str, source: str, seed: int) -> DataFrame:
    """__row, size, source_size, target, taken."""
    sized = boxed(df).select(
        "__row",
        F.col(f"__row.`{source}`").alias("__source"),
        F.size(words(F.col(f"__row.`{text}`"))).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(f"__row.`{ident}`")).alias("__h"),
        F.xxhash64(F.col(f"__row.`{text}`")).alias("__t"),
    )
    slim = sized.select(F.col("__source").alias("source"), "size", F.pmod("__h", F.lit(BUCKETS)).alias("bucket"))
    buckets = materialize(slim.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("n")), "lengths")
    sources = materialize(targets(buckets.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))), "targets")
    named = buckets.join(sources.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    lengths = named.groupBy("rank", "size", "target").agg(F.sum("n").alias("n"))
    plan = materialize(lengths.groupBy("rank").applyInPandas(_fit_source, "rank int, size long, whole int, take long"), "plan")
    before = F.sum("n").over(Window.partitionBy("rank", "size").orderBy("bucket")) - F.col("n")
    dealt = (
        named.select("rank", "size", "bucket", "n", "source_size", "target", before.alias("before"))
        .join(plan, ["rank", "size"], "left")
        .select("rank", "size", "bucket", "source_size", "target", F.coalesce("whole", F.lit(0)).alias("whole"), F.greatest(F.least(F.coalesce("take", F.lit(0)) - F.col("before"), "n"), F.lit(0)).alias("take"))
    )
    dealt = dealt.select(F.struct("rank", "size", "bucket").alias("__k"), F.struct("source_size", "target", "whole", "take").alias("__d"))
    ranks = sources.select(F.col("source").alias("__s"), F.col("rank").alias("__rank"))
    keyed = sized.join(ranks, F.col("__source").eqNullSafe(F.col("__s"))).withColumn("__bucket", F.pmod("__h", F.lit(BUCKETS)))
    joined = keyed.join(dealt, (F.col("__rank") == F.col("__k.rank")) & (F.col("size") == F.col("__k.size")) & (F.col("__bucket") == F.col("__k.bucket")))
    nth = F.row_number().over(Window.partitionBy("__rank", "size", "__bucket").orderBy("__h", "__t"))
    taken = F.col("size") * (F.col("__d.whole") + F.when(nth <= F.col("__d.take"), 1).otherwise(0))
    return joined.select("__row", "size", F.col("__d.source_size").alias("source_size"), F.col("__d.target").alias("target"), taken.cast("long").alias("taken"))


def mix(df: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0) -> DataFrame:
    """``df`` with size, source_size, target, taken: the words that the mix takes of each document."""
    return unboxed(_mixed(df, ident, text, source, seed), *[F.col(c) for c in ("size", "source_size", "target", "taken")])


def sample_mix(df: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0) -> DataFrame:
    """The rows that a mix makes of ``df``, with its own columns: a document taken twice is there twice."""
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    box = _mixed(df, ident, text, source, seed).select("__row", times.alias("__times")).where("__times > 0")
    return unboxed(box.withColumn("__again", F.explode(F.sequence(F.lit(1), F.col("__times")))).select("__row"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op8_source_mixing": op8_source_mixing}
ORACLES: dict[str, str] = {}
