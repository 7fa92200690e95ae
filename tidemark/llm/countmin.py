"""Count-min sketches over all partitions, merged block by block, and read as bitmaps of a fixed size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import tokens

ROWS = 2
#: Cells of a block of the sketch.
BLOCK = 1 << 20
#: Bounds of a row's width.
NARROWEST, WIDEST = 1 << 16, 1 << 27
#: So many sketches of a block meet in one task, level by level of a tree.
FAN_IN = 32
#: Counts stop here.
MOST = 255


def width_for(cells: float) -> int:
    """The power of two at or above ``cells`` within the bounds."""
    return 1 << max(NARROWEST.bit_length() - 1, min(WIDEST.bit_length() - 1, int(cells).bit_length()))


def places(items: np.ndarray, width: int) -> list[np.ndarray]:
    """The cell of each 64-bit item in each row."""
    return [(tokens.scramble(items + np.uint64(tokens.GOLDEN * (r + 1) % (1 << 64))) & np.uint64(width - 1)).astype(np.int64) for r in range(ROWS)]


def _pack(counts: np.ndarray) -> bytes:
    return pa.compress(counts.tobytes(), codec="zstd", asbytes=True)


def _unpack(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, decompressed_size=n, codec="zstd", asbytes=True), dtype=np.uint8)


def _count(items: Callable[[pa.RecordBatch], np.ndarray], width: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((ROWS, width), dtype=np.uint8)
        for batch in tokens.chunks(batches, "text", chunk):
            found = items(batch)
            for r, c in enumerate(places(found, width)):
                cell, n = np.unique(c, return_counts=True)
                counts[r, cell] = np.minimum(counts[r, cell] + np.minimum(n, MOST), MOST)
        size = min(BLOCK, width)
        for r in range(ROWS):
            for b in range(width // size):
                part = counts[r, b * size : (b + 1) * size]
                if part.any():
                    yield pa.RecordBatch.from_pydict({"row": pa.array([r], pa.int32()), "block": pa.array([b], pa.int32()), "counts": [_pack(part)]})

    return run


def _merge(size: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size, dtype=np.uint16)
        for packed in frame["counts"]:
            total += _unpack(packed, size)
            np.minimum(total, MOST, out=total)
        return frame.iloc[:1].assign(counts=[_pack(total.astype(np.uint8))])

    return run


def bitmaps(docs: DataFrame, items: Callable[[pa.RecordBatch], np.ndarray], width: int, levels: tuple[int, ...], chunk: int = tokens.CHUNK) -> list[np.ndarray]:
    """For each level a packed bitmap, one row for each row of the sketch, of the cells counted at least so often.

    docs: text. ``items`` gives the 64-bit items of a batch. Partitions' sketches are merged in a tree, so no task takes
    more than ``FAN_IN`` blocks however many partitions there are. The merged sketch passes the driver block by block.
    """
    kind = "row int, block int, counts binary"
    size = min(BLOCK, width)
    rows = docs.select("text")
    merged = rows.mapInArrow(_count(items, width, chunk), kind).withColumn("part", F.spark_partition_id())
    parts = rows.rdd.getNumPartitions()
    while True:
        parts = -(-parts // FAN_IN)
        merged = merged.withColumn("part", (F.col("part") / FAN_IN).cast("int") if parts > 1 else F.lit(0))
        merged = merged.groupBy("row", "block", "part").applyInPandas(_merge(size), f"{kind}, part int")
        if parts <= 1:
            break
    out = [np.zeros((ROWS, width // 8), dtype=np.uint8) for _ in levels]
    for r in merged.toLocalIterator():
        counts = _unpack(bytes(r["counts"]), size)
        for bits, level in zip(out, levels, strict=True):
            bits[r["row"], r["block"] * (size // 8) : (r["block"] + 1) * (size // 8)] = np.packbits(counts >= level)
    return out


def reached(bits: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Whether the sketch's estimate of each item reaches the bitmap's level; true for all items that do."""
    may = np.ones(len(items), dtype=bool)
    for r, c in enumerate(places(items, bits.shape[1] * 8)):
        may &= (bits[r][c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)
    return may
