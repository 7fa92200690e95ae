"""Sharding by histogram sort: splitters are found by counting, then rows move once.

Rows are ordered by a seeded hash of their id and text, so shards are also a global shuffle. Boundaries between
shards are refined round by round: candidate keys split each open interval, one aggregation counts the exact bytes
below all of them, and the interval that holds the target shrinks, until the bytes below the boundary are within
tolerance of the target or the boundary lies between neighbouring keys. Only counts at probes reach the driver, at
most ``PROBES`` for each open boundary, whatever the input. The known cells of the last histogram then give each row
its shard and each cell its first slot, so the one exchange goes by cell, not by shard.

Where rows that are equal in id and text weigh more than the tolerance and hold a boundary, no key can part them.
Then rows are written once with a number, which joins the key, and the boundaries are found among those keys.

Defined cases: a null text has no bytes and CRC 0, like an empty one; a very long text moves as one row, so shards
differ by no more than it; null ids are ids like others; rows that share an id, or a text, are dealt out like any
rows; rows equal in id and text are put next to each other, or dealt out as said above; ties of keys are ordered by id,
CRC and size; columns of the input named like a result give way to it; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import boxed, materialize, table, unboxed

SHARDS = 40
#: Bytes of a row beside its text.
ROW_BYTES = 16
#: Candidate keys in each open interval and round: a power of two.
PROBES = 1024
#: A boundary is good when the bytes below it are within this share of one shard's bytes of its target.
TOLERANCE = 0.001
#: Cells that order rows within shards: at least and at most so many, and about so many bytes in each.
CELLS, MOST_CELLS, CELL_BYTES = 1 << 12, 1 << 24, 64 << 20
#: Keys are whole numbers below this.
KEY_BITS = 62


def sort_key(seed: int, *columns: Column) -> Column:
    """A whole number below 2**KEY_BITS."""
    return F.call_function("shiftrightunsigned", F.xxhash64(F.lit(seed), *columns), F.lit(64 - KEY_BITS))


def text_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def _bytes_by_probe(keyed: DataFrame, intervals: list[tuple[int, int]]) -> dict[tuple[int, int], int]:
    """Bytes of the keys in each of the pieces that PROBES candidate keys cut each interval [low, high) into.

    Intervals don't overlap and are as long as a power of two, so the piece of a key is found by shifts.
    """
    starts = F.array(*[F.lit(a).cast("long") for a, _ in intervals])
    shifts = F.array(*[F.lit(max(0, (b - a).bit_length() - 1 - (PROBES.bit_length() - 1))) for a, b in intervals])
    # intervals are aligned: a key lies in the last one that starts at or below it
    at = F.size(F.filter(starts, lambda s: s <= F.col("key"))) if len(intervals) > 1 else F.when(F.col("key") >= intervals[0][0], 1).otherwise(0)
    ends = F.array(*[F.lit(b).cast("long") for _, b in intervals])
    placed = keyed.withColumn("__i", at - 1).where((F.col("__i") >= 0) & (F.col("key") < F.get(ends, F.col("__i"))))
    piece = F.call_function("shiftright", F.col("key") - F.get(starts, F.col("__i")), F.get(shifts, F.col("__i")))
    counted = placed.groupBy("__i", piece.alias("__p")).agg(F.sum("size").alias("b"))
    return {(r["__i"], r["__p"]): r["b"] for r in counted.collect()}  # at most PROBES rows an interval


def find_splitters(keyed: DataFrame, shards: int, tolerance: float = TOLERANCE) -> tuple[list[int], int, bool]:
    """shards - 1 ascending keys, the bytes of all rows, and whether all boundaries are within tolerance.

    Shard k holds the keys from the k-th of them, as Python counts, up to the next. keyed: key (long, below
    2**KEY_BITS) and size (long).
    """
    top = 1 << KEY_BITS
    first = _bytes_by_probe(keyed, [(0, top)])
    total = sum(first.values())
    if not total:
        return [top] * (shards - 1), 0, True
    goals = [total * (k + 1) / shards for k in range(shards - 1)]
    allowed = tolerance * total / shards
    best: list[tuple[float, int] | None] = [None] * (shards - 1)
    known = {(0, top): (0, {p: b for (_, p), b in first.items()})}  # interval: bytes below it, bytes of its pieces
    where: dict[int, tuple[int, int]] = {k: (0, top) for k in range(shards - 1)}
    while where:
        again: dict[int, tuple[int, int]] = {}
        below: dict[tuple[int, int], int] = {}
        for interval in sorted(set(where.values())):
            base, pieces = known[interval]
            width = max(1, (interval[1] - interval[0]) // PROBES)
            marks, sums = [interval[0]], [base]
            for p in sorted(pieces):
                marks.append(interval[0] + (p + 1) * width)
                sums.append(sums[-1] + pieces[p])
            for k in [k for k, v in where.items() if v == interval]:
                i = max(1, min(len(sums) - 1, bisect_right(sums, goals[k])))  # the goal lies in piece i - 1
                for j in (i - 1, i):
                    off = abs(sums[j] - goals[k])
                    if best[k] is None or off < best[k][0]:
                        best[k] = (off, marks[j])
                if best[k][0] > allowed and width > 1:
                    low = interval[0] + (sorted(pieces)[i - 1]) * width
                    again[k] = (low, low + width)
                    below[low, low + width] = sums[i - 1]
        if again:
            spans = sorted(set(again.values()))
            found = _bytes_by_probe(keyed, spans)
            known = {s: (below[s], {p: b for (i, p), b in found.items() if i == n}) for n, s in enumerate(spans)}
        where = again
    out: list[int] = []
    for b in best:
        out.append(max(b[1], out[-1] if out else 0))
    return out, total, all(b[0] <= allowed for b in best)


def _repeated(keyed: DataFrame, most: float) -> bool:
    """Whether rows of one key weigh more than ``most`` bytes."""
    heaviest = keyed.groupBy("__key").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.max("b")).first()[0]
    return (heaviest or 0) > most


def histogram_sort(df: DataFrame, ident: str = "doc_id", text: str = "text", shards: int = SHARDS, seed: int = 0, tolerance: float = TOLERANCE) -> DataFrame:
    """``df`` with size, text_crc32, shard and slot: shards of near equal bytes, in the order of the sort key.

    The input is read once for each round of probes and once for the exchange.
    """
    t, i = F.col(f"__row.`{text}`"), F.col(f"__row.`{ident}`")

    def keyed_by(box: DataFrame, *more: Column) -> DataFrame:
        crc = F.coalesce(F.crc32(t.cast("binary")), F.lit(0)).cast("long")
        return box.select("__row", sort_key(seed, i, t, *more).alias("__key"), text_bytes(t).alias("size"), crc.alias("text_crc32"))

    keyed = keyed_by(boxed(df))
    splitters, total, good = find_splitters(keyed.select(F.col("__key").alias("key"), "size"), shards, tolerance)
    if not good and _repeated(keyed, tolerance * total / shards):
        keyed = keyed_by(materialize(boxed(df).withColumn("__nth", F.monotonically_increasing_id()), "numbered"), F.col("__nth"))
        splitters, total, _ = find_splitters(keyed.select(F.col("__key").alias("key"), "size"), shards, tolerance)
    points = F.array(*[F.lit(s).cast("long") for s in splitters]) if splitters else F.array().cast("array<bigint>")
    cells = max(CELLS, min(MOST_CELLS, 1 << (total // CELL_BYTES).bit_length()))
    placed = keyed.withColumns(
        {
            "shard": F.size(F.filter(points, lambda s: s <= F.col("__key"))),
            "__cell": F.call_function("shiftright", F.col("__key"), F.lit(KEY_BITS - (cells.bit_length() - 1))).cast("int"),
        }
    )
    counts = placed.groupBy("shard", "__cell").agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.select("shard", "__cell", (F.sum("__n").over(Window.partitionBy("shard").orderBy("__cell")) - F.col("__n")).alias("__start"))
    starts = materialize(starts, "cell-starts", rebalance=True)  # written, so that the planner knows its size
    ranked = placed.withColumn("__rank", F.row_number().over(Window.partitionBy("shard", "__cell").orderBy("__key", i, "text_crc32", "size")))
    slotted = ranked.join(starts, ["shard", "__cell"])
    return unboxed(slotted, F.col("size"), F.col("text_crc32"), F.col("shard"), (F.col("__start") + F.col("__rank") - 1).cast("long").alias("slot"))


def op5_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return histogram_sort(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op5_histogram_sharding": op5_histogram_sharding}
ORACLES: dict[str, str] = {}
