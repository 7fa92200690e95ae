"""Removal of byte strings that occur twice or more, by merged Burrows-Wheeler transforms of text segments.

The anchor of a window of ``WINDOW`` bytes is the least hash of its pieces of ``PIECE`` bytes, the leftmost if it is
there twice; a segment is a run of windows with one anchor, and at most ``WINDOW * 2 - PIECE`` bytes long. Equal
windows have equal anchors, so windows of different anchors need not meet.

First pass: a count-min sketch counts segments by anchor. Second pass: segments whose anchor the sketch has seen
twice or more are written with their text; equal segments of a chunk make one row, with the list of their places. They
go, by anchor, to buckets, where equal segments are one string with a weight. Keys with several different strings are
where windows may be shared in part: shards of them are transformed and merged, and the intervals of rows that share
WINDOW bytes and weigh two or more are the repeated windows. Equal windows hold their anchor at one place, so strings
that share a window agree in all but ``SLACK`` bytes of it around the anchor, for one of the places that the anchor may
have. A string that agrees with no other string of its key in this way has nothing to merge, as if it were alone: its
windows repeat if its weight is two or more.

Anchors of ``HEAVY`` segments or more are counted exactly and dealt out over groups of a few chunks each, so a passage
in a third of all documents, with its many different surroundings, never meets in one task. Windows that repeat within
a group are settled there. Each group also gives every distinct window of such anchors once, as a hash with a weight;
hashes are added up, with partial sums, and joined with the windows that are still open, a join that Spark may split.

Defined cases: a null or shorter text has no windows and is kept; a very long text is cut into segments like any other,
whole; rows that share id and text are copies of each other; of pieces with one hash the leftmost is the anchor; null
ids are ids like others; the result has its own columns alone, so none clash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bwt, tokens
from tidemark.llm.common import materialize, table
from tidemark.llm.countmin import bitmaps, reached, width_for
from tidemark.llm.substrings import sliding_min

WINDOW, PIECE = 400, 32
#: Cells of a row of the sketch for each byte of text.
CELLS_A_BYTE = 0.015
#: Segments of an anchor that is dealt out, and chunks of a group of it.
HEAVY, GROUP = 64, 4
#: Bytes of text for each bucket, and of a shard in a bucket.
BUCKET_BYTES, SHARD_BYTES = 2 << 20, 1 << 18
CHUNK = 1 << 20
#: Bytes of a window in which strings of a key may differ and still are merged.
SLACK = 46
_POSITION = 28
#: Bytes in another order, for a second hash of a window.
_OTHER = np.random.default_rng(tokens.SEED + 1).permutation(256).astype(np.uint8)


def segments(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor, of texts in a row: first and last window, anchor's place and hash."""
    starts, ends = first[:-1], first[1:]
    long = ends - starts >= WINDOW
    none = np.zeros(0, dtype=np.int64)
    if not long.any():
        return none, none, none, none.astype(np.uint64)
    flags = np.zeros(len(data) + 1, dtype=np.int8)
    np.add.at(flags, starts[long], 1)
    np.add.at(flags, ends[long] - WINDOW + 1, -1)
    windows = np.flatnonzero(np.cumsum(flags[:-1]))
    h = bwt.gram_hash(data, PIECE)
    low = np.uint64((1 << _POSITION) - 1)
    packed = (h & ~low) | (np.arange(len(h), dtype=np.uint64) & low)  # of equal hashes the leftmost is least
    least = sliding_min(packed, WINDOW - PIECE + 1)[windows] & low
    place = windows + ((least.astype(np.int64) - windows) & int(low))
    new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return windows[new], windows[np.r_[new[1:] - 1, len(windows) - 1]], place[new], h[place[new]]


def _anchors(batch: pa.RecordBatch) -> np.ndarray:
    return segments(*tokens.raw(batch.column("text")))[3]


def _segments(shared, id_type: pa.DataType):
    place_type = pa.list_(pa.struct([("doc_id", id_type), ("t1", pa.int64()), ("start", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = shared.value
        for batch in tokens.chunks(batches, "text", CHUNK):
            data, first = tokens.raw(batch.column("text"))
            a, b, place, anchor = segments(data, first)
            may = np.flatnonzero(reached(twice, anchor))
            if not len(may):
                continue
            a, b, anchor, place = a[may], b[may], anchor[may], place[may] - a[may]
            of = np.searchsorted(first, a, side="right") - 1
            text = data.tobytes()
            found: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
            at_anchor: dict[tuple[int, bytes], int] = {}  # a segment's text says where its anchor is
            for s, e, key, d, p in zip(a.tolist(), b.tolist(), anchor.tolist(), of.tolist(), place.tolist(), strict=True):
                found.setdefault(own := (key, text[s : e + WINDOW]), []).append((d, s))
                at_anchor[own] = p
            ids, t1 = batch.column("doc_id").to_pylist(), batch.column("t1").to_pylist()
            at = first.tolist()
            keys = np.array([k for k, _ in found], dtype=np.uint64).view(np.int64)
            sizes = np.array([len(v) for v in found.values()], dtype=np.int32)
            flat = [x for v in found.values() for x in v]
            places = pa.StructArray.from_arrays(
                [pa.array([ids[d] for d, _ in flat], id_type), pa.array([t1[d] for d, _ in flat], pa.int64()), pa.array([s - at[d] for d, s in flat], pa.int32())], ["doc_id", "t1", "start"]
            )
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), places)
            chunk = pa.array(np.full(len(keys), t1[0] or 0), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sizes), chunk, pa.array([s for _, s in found], pa.binary()), pa.array([at_anchor[x] for x in found], pa.int32()), lists.cast(place_type)], ["key", "n", "chunk", "data", "anchor", "places"])

    return run


def _window_hashes(s: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(s, dtype=np.uint8)
    return bwt.gram_hash(data, WINDOW).view(np.int64), (bwt.gram_hash(_OTHER[data], WINDOW) >> np.uint64(33)).astype(np.int32)


def _around(s: bytes, anchor: int) -> list[tuple[int, bytes]]:
    """What windows of ``s`` hold around their anchor for sure, for each run of ``SLACK`` places that it may have in them."""
    out = []
    for left in range(0, WINDOW - PIECE + 1, SLACK):
        low, high = anchor - left, anchor + WINDOW - min(left + SLACK - 1, WINDOW - PIECE)
        if low >= 0 and high <= len(s):
            out.append((left, s[low:high]))
    return out


def _repeats(id_type: pa.DataType):
    """One bucket: bytes [low, high) of repeated windows (weight 0); of dealt anchors each distinct window with its hash,
    with its place if it is there once (weight 1), without if it repeats (weight 2)."""

    def run(bucket: pa.Table) -> pa.Table:
        keys, groups = (bucket.column(c).combine_chunks().to_numpy() for c in ("key", "group"))
        strings = bucket.column("data").to_pylist()
        places = bucket.column("places").combine_chunks()
        counts = np.diff(places.offsets.to_numpy())
        where = places.flatten()
        rows: dict[tuple[int, int, bytes], list[int]] = {}
        for i, (k, g, s) in enumerate(zip(keys.tolist(), groups.tolist(), strings, strict=True)):
            rows.setdefault((k, g, s), []).append(i)
        anchors = bucket.column("anchor").to_numpy().tolist()
        around = [[hash((k, x)) for x in _around(s, anchors[at[0]])] for (k, _, s), at in rows.items()]  # of all groups that are here
        strings_with = Counter(x for own in around for x in own)
        first = np.r_[0, np.cumsum(counts)]
        out: list[tuple[np.ndarray, ...]] = []  # place, low, high, h1, h2, weight
        zero = lambda n: np.zeros(n, dtype=np.int64)

        def add(g: int, s: bytes, at: list[int], windows: np.ndarray) -> None:
            edges = np.flatnonzero(np.diff(np.r_[0, windows.astype(np.int8), 0]))
            who = np.concatenate([np.arange(first[i], first[i + 1]) for i in at])
            for low, high in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                out.append((who, zero(len(who)) + low, zero(len(who)) + high - 1 + WINDOW, zero(len(who)), zero(len(who)), zero(len(who))))
            if g >= 0:
                n = len(windows)
                h1, h2 = _window_hashes(s)
                at_window = np.arange(n)
                out.append((np.where(windows, -1, who[0]), at_window, at_window + WINDOW, h1, h2.astype(np.int64), np.where(windows, 2, 1)))

        merging = []
        for ((_, g, s), at), own in zip(rows.items(), around, strict=True):
            if all(strings_with[x] == 1 for x in own):
                repeat = counts[at].sum() > 1
                if repeat or g >= 0:
                    add(g, s, at, np.full(len(s) - WINDOW + 1, repeat))
            else:
                merging.append((g, s, at))
        if merging:
            weights = np.array([counts[at].sum() for _, _, at in merging])
            for (g, s, at), windows in zip(merging, bwt.repeated([s for _, s, _ in merging], weights, WINDOW, SHARD_BYTES), strict=True):
                add(g, s, at, windows)
        who, low, high, h1, h2, w = (np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True)) if out else (zero(0),) * 6
        once = np.r_[np.flatnonzero(w < 2), _distinct(h1, h2, w)]
        who, low, high, h1, h2, w = (x[once] for x in (who, low, high, h1, h2, w))
        take = pa.array(who, mask=who < 0)
        start = where.field("start").to_numpy(zero_copy_only=False).astype(np.int64)[np.maximum(who, 0)]
        return pa.table(
            {
                "doc_id": where.field("doc_id").take(take).cast(id_type), "t1": where.field("t1").take(take), "low": pa.array((start + low).astype(np.int32)), "high": pa.array((start + high).astype(np.int32)),
                "h1": pa.array(h1), "h2": pa.array(h2.astype(np.int32)), "weight": pa.array(w.astype(np.int32)),
            }
        )

    return run


def _distinct(h1: np.ndarray, h2: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Of windows known to repeat, one row for each hash."""
    at = np.flatnonzero(weight == 2)
    order = at[np.lexsort((h2[at], h1[at]))]
    return order[np.r_[True, (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])]] if len(order) else order


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, t1, spans: for each text with repeats, the bytes [low, high) that repeated windows cover.

    docs: doc_id (long or string), t1 (long), text.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = pa.string() if kind == "string" else pa.int64()
    shared = docs.sparkSession.sparkContext.broadcast(bitmaps(docs, _anchors, width_for(size * CELLS_A_BYTE), (2,), CHUNK)[0])  # bounded by the widest sketch
    found = docs.select("doc_id", "t1", "text").mapInArrow(_segments(shared, id_type), f"key long, n int, chunk long, data binary, anchor int, places array<struct<doc_id:{kind},t1:long,start:int>>")
    found = materialize(found, "segments")
    hot = materialize(found.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= HEAVY).select(F.col("key").alias("hot")), "heavy-anchors", rebalance=True)
    group = F.when(F.col("hot").isNotNull(), F.pmod("chunk", F.lit(max(1, size // (GROUP * CHUNK))))).otherwise(-1)
    buckets = max(8, size // BUCKET_BYTES)
    dealt = found.join(hot, F.col("key") == F.col("hot"), "left").select("key", group.alias("group"), "data", "anchor", "places")
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("key", "group"), F.lit(buckets)))
    settled = materialize(dealt.groupBy("bucket").applyInArrow(_repeats(id_type), f"doc_id {kind}, t1 long, low int, high int, h1 long, h2 int, weight int"), "byte-windows")
    twice = settled.where("weight > 0").groupBy("h1", "h2").agg(F.sum("weight").alias("n")).where("n > 1").select("h1", "h2")
    late = settled.where("weight = 1").join(twice, ["h1", "h2"])
    spans = settled.where("weight = 0").select("doc_id", "t1", "low", "high").union(late.select("doc_id", "t1", "low", "high"))
    return spans.groupBy("doc_id", "t1").agg(F.collect_set(F.struct("low", "high")).alias("spans"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        spans = batch.column("spans")
        for i, text in enumerate(batch.column("text")):
            data = (text.as_py() or "").encode()
            n_bytes.append(len(data))
            removed = runs = 0
            if spans[i].is_valid:
                at = sorted((x["low"], x["high"]) for x in spans[i].as_py())
                pieces, end = [], 0
                for low, high in at:
                    if low > end or not runs:
                        pieces.append(data[end:low])
                        runs += 1
                    end = max(end, high)
                pieces.append(data[end:])
                data = b"".join(pieces)
                removed = n_bytes[-1] - len(data)
            n_removed.append(removed)
            n_spans.append(runs)
            kept.append(data)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeated_bytes(df: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept: each text's UTF-8 bytes outside of repeated windows."""
    rows = df.select(F.col(f"`{ident}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    if rows.schema["doc_id"].dataType.simpleString() != "string":
        rows = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = rows.withColumn("t1", F.xxhash64("text"))
    spans = materialize(repeated_bytes(rows), "spans").select(F.col("doc_id").alias("__d"), F.col("t1").alias("__t"), "spans")
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("t1") == F.col("__t")), "left")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return joined.select("doc_id", "text", "spans").mapInArrow(_cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op9_suffix_dedup": op9_suffix_dedup}
ORACLES = {
    "op9_suffix_dedup": f"""
with d as materialized (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
p as (select doc_id, i, md5(substr(h, 2 * i + 1, {2 * WINDOW})) as m from (select doc_id, h, unnest(range(0, length(h) // 2 - {WINDOW - 1})) as i from d where length(h) >= {2 * WINDOW})),
r as (select m from p group by m having count(*) > 1),
f as (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= {WINDOW} then 0 else 1 end as fresh from p where m in (select m from r)),
k as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as run from f),
s as (select doc_id, run, min(i) as a, max(i) + {WINDOW} as b from k group by doc_id, run),
q as (select *, lag(b, 1, 0) over (partition by doc_id order by a) as prev from s),
o as (select q.doc_id, count(*) as n_spans, sum(b - a)::bigint as n_removed, string_agg(substr(h, 2 * prev + 1, 2 * (a - prev)), '' order by a) || substr(any_value(h), 2 * max(b) + 1) as kept from q join d on q.doc_id = d.doc_id group by q.doc_id)
select d.doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256 from d left join o on d.doc_id = o.doc_id
"""
}
