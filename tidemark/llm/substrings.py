"""Removal of word windows that a document with a smaller id holds too, behind a count-min sketch.

A window's anchor is the least hash among its pieces of ``PIECE`` words, so equal windows have equal anchors.
First pass: each partition counts its documents' anchors in a count-min sketch and sends it in packed blocks;
blocks merge by adding. As sketches only overestimate, a window whose anchor has a cell counted once is not
repeated. Second pass: the other windows are hashed whole and grouped exactly; no repeated window is lost, and
windows let through in error are found alone. The sketch's width follows the size of the input up to a bound; an
input too large for it only lets more through.

Within a chunk of documents only the first holder of a window goes to the shuffle, later ones are decided there,
so a window that a third of all documents hold makes a row a chunk, not a row a document. Windows whose anchor the
sketch has seen ``HOT`` times or more are compared in two steps: in groups of documents, as many as the root of the
number of chunks, then the first holders of each group, so no task takes all rows of a window.

Defined cases: a null text has no words; a document with a null id is left whole and is no other's original; rows
that share an id don't remove from each other; documents of fewer words than a window are left whole; a very long text
is one chunk by itself, read whole; the result has its own columns alone, so none clash; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import tokens
from tidemark.llm.common import materialize, table
from tidemark.llm.countmin import bitmaps, reached, width_for

WINDOW = 13
PIECE = 5
#: Cells of a row of the sketch for each byte of text.
CELLS_A_BYTE = 0.075
#: Anchors counted so often are compared in two steps.
HOT = 128


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of the n values from each on."""
    if len(x) < n:
        return x[:0]
    out, width = x, 1
    while width * 2 <= n:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = n - width
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(w: tokens.Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows begin, and the anchor of each."""
    inside = np.flatnonzero(w.inside(window))
    return inside, sliding_min(tokens.roll(w.hash, PIECE), window - PIECE + 1)[inside]


def _counted(window: int):
    """The anchors to count in a batch: one shared by neighbouring windows counts once."""

    def items(batch: pa.RecordBatch) -> np.ndarray:
        w = tokens.split(batch.column("text"))
        at, a = anchors(w, window)
        of = w.of[at]
        return a[np.r_[True, (a[1:] != a[:-1]) | (of[1:] != of[:-1])]] if len(a) else a

    return items


def _windows(shared, window: int, groups: int):
    """doc_id, text_hash, h1, h2, pos, grp: windows that may be repeated; h2 is -1 for those decided to be, grp where not hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hot_bits = shared.value
        for batch in tokens.chunks(batches, "text"):
            w = tokens.split(batch.column("text"))
            at, a = anchors(w, window)
            known = np.asarray(batch.column("doc_id").is_valid())
            may = known[w.of[at]] & reached(bits, a)
            at, hot = at[may], reached(hot_bits, a[may])
            if not len(at):
                continue
            of = w.of[at]
            ids = np.asarray(batch.column("doc_id").fill_null(0))[of]
            h1 = tokens.roll(w.hash, window)[at].view(np.int64)
            h2 = (tokens.roll(tokens.scramble(w.hash ^ np.uint64(tokens.MULTIPLIER)), window)[at] >> np.uint64(33)).astype(np.int32)
            order = np.lexsort((ids, h2, h1))
            h1, h2, ids, of, at, hot = h1[order], h2[order], ids[order], of[order], at[order], hot[order]
            same = np.r_[False, (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])]
            first = np.maximum.accumulate(np.where(same, 0, np.arange(len(at))))  # the first row of each group
            decided = ids > ids[first]
            texts = np.asarray(batch.column("text_hash").fill_null(0))[of]
            h1 = np.where(decided, tokens.scramble(ids.view(np.uint64) * np.uint64(tokens.GOLDEN) + at.astype(np.uint64)).view(np.int64), h1)  # anywhere
            h2 = np.where(decided, np.int32(-1), h2)
            grp = np.where(hot & ~decided, tokens.scramble(ids.view(np.uint64)) % np.uint64(groups), np.uint64(1 << 31)).astype(np.int64)
            grp = np.where(grp < groups, grp, -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(texts, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int32()), pa.array((at - w.first[of]).astype(np.int32)), pa.array(grp)],
                ["doc_id", "text_hash", "h1", "h2", "pos", "grp"],
            )

    return run


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_hash, at: the places of the windows that a document with a smaller id holds too.

    docs: doc_id (long), text, text_hash (long).
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shared = spark.sparkContext.broadcast(bitmaps(docs, _counted(window), width_for(size * CELLS_A_BYTE), (2, HOT)))  # bounded by the widest sketch
    groups = max(1, min(1 << 20, int((size / tokens.CHUNK) ** 0.5)))
    found = docs.select("doc_id", "text_hash", "text").mapInArrow(_windows(shared, window, groups), "doc_id long, text_hash long, h1 long, h2 int, pos int, grp int")
    first = F.min("doc_id").over(Window.partitionBy("h1", "h2", "grp"))
    later = (F.col("h2") < 0) | (F.col("doc_id") > F.col("first"))
    near = found.withColumn("first", first).where(later | (F.col("grp") >= 0))
    near = near.groupBy("doc_id", "text_hash").agg(F.collect_set(F.when(later, F.col("pos"))).alias("at"), F.collect_set(F.when(~later, F.struct("h1", "h2", "pos"))).alias("open"))
    near = materialize(near, "windows-settled")
    # the first holders of each group
    left = near.select("doc_id", "text_hash", F.explode("open").alias("x")).select("doc_id", "text_hash", "x.*")
    far = left.withColumn("first", F.min("doc_id").over(Window.partitionBy("h1", "h2"))).where("doc_id > first").groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("at"))
    both = near.where(F.size("at") > 0).select("doc_id", "text_hash", "at").union(far)
    return both.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("at")).alias("at"))


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_words, n_removed = [], [], []
            places = batch.column("at")
            for i, text in enumerate(batch.column("text")):
                said = (text.as_py() or "").encode().split()  # bytes are split at space and 0x09 to 0x0D
                n_words.append(len(said))
                if places[i].is_valid:
                    hit = np.zeros(len(said) + 1, dtype=np.int64)
                    at = places[i].values.to_numpy()
                    np.add.at(hit, at, 1)
                    np.add.at(hit, at + window, -1)
                    stay = np.cumsum(hit[:-1]) == 0
                    said = [w for w, s in zip(said, stay.tolist(), strict=True) if s]
                n_removed.append(n_words[-1] - len(said))
                kept.append(b" ".join(said))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"]
            )

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: each document's words outside repeated windows, joined by spaces.

    docs: doc_id (whole number), text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"))
    places = materialize(repeated_windows(rows, window), "repeated-windows")
    places = places.select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__t"), "at")
    joined = rows.join(places, (F.col("doc_id") == F.col("__d")) & (F.col("text_hash") == F.col("__t")), "left")
    return joined.select("doc_id", "text", "at").mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept_text string")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {"op6_substring_dedup": op6_substring_dedup}
ORACLES = {
    "op6_substring_dedup": rf"""
with d as materialized (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
p as (select doc_id, unnest(list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: array_to_string(w[i:i + {WINDOW - 1}], ' '))) as win, unnest(range(1, len(w) - {WINDOW - 2})) as i from d where len(w) >= {WINDOW}),
g as (select doc_id, i, min(doc_id) over (partition by win) as first_id from p),
gone as (select distinct doc_id, i + k as pos from g, range({WINDOW}) r(k) where first_id < doc_id),
a as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as pos from d),
k as (select a.doc_id, string_agg(word, ' ' order by a.pos) filter (gone.pos is null) as kept, count(gone.pos) as n_removed from a left join gone on a.doc_id = gone.doc_id and a.pos = gone.pos group by a.doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k on d.doc_id = k.doc_id
"""
}
