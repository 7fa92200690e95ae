"""Benchmark decontamination as a prefix-filtered set join over word shingles.

A window is ``WINDOW`` consecutive words of an item (an item of fewer words is one window) and the set of its
shingles of ``SHINGLE`` words (fewer, if it has fewer). A document holds a window only if it holds all of that
set, so the necessary prefix, in the order of rarity over all documents, is the rarest shingle alone. Documents'
shingles that the benchmark knows are joined with these prefixes; the shingle's place in the window says where the
window would begin and end, which bounds candidates by position and length; the words themselves then decide.

Documents are read once. A bitmap of fixed size lets through what may be an item's shingle, and errs on the side
of letting through; the joins that follow are exact, and Spark broadcasts their sides by measured size or shuffles.

Words for the check are kept in pieces of ``PIECE`` words, and the window's length more, around each shingle that the
bitmap lets through, so a very long text that is an item throughout makes rows in proportion to its length.

Defined cases: a null or empty text has no words and isn't hit; a very long text is read whole; items without words
are ignored; equal items are all counted; repeated document rows are judged one by one; of equally rare shingles the
one with the least hash, then the first in the window, is the prefix; columns of the input are kept apart from
computed names by ``clean_documents``; an empty benchmark leaves all documents clean; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm import tokens
from tidemark.llm.common import boxed, materialize, table, unboxed

WINDOW = 10
SHINGLE = 5
#: Bits of the bitmap, a power of two.
BITS = 1 << 22
#: Words whose windows begin in one piece, or a window's, if that is longer.
PIECE = 64
_HITS = "n_words long, hits array<struct<pos:int,s:int,h:long>>, pieces array<struct<piece:int,words:array<string>>>"
_WINDOWS = "item_id string, win string, len int, place int, s int, h long"


def _item_windows(window: int, shingle: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            w = tokens.split(pa.array(f["text"].tolist(), pa.string()), tokens.ALPHANUMERIC, tokens.LOWER)
            for i, item in enumerate(f["item_id"]):
                a, b = int(w.first[i]), int(w.first[i + 1])
                n = min(window, b - a)
                if not n:
                    continue
                s = min(shingle, n)
                h = tokens.roll(w.hash[a:b], s).view(np.int64)
                said = [w.word(j).decode("utf-8", "replace") for j in range(a, b)]
                for k in range(b - a - n + 1):
                    out += [(item, " ".join(said[k : k + n]), n, p, s, int(h[k + p])) for p in range(n - s + 1)]
            yield pd.DataFrame(out, columns=["item_id", "win", "len", "place", "s", "h"])

    return run


def _scan(bits: bytes, sizes: list[int], window: int, piece: int):
    """One row a document: what ``hits`` says below."""
    hit_type = pa.list_(pa.struct([("pos", pa.int32()), ("s", pa.int32()), ("h", pa.int64())]))
    piece_type = pa.list_(pa.struct([("piece", pa.int32()), ("words", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(np.frombuffer(bits, dtype=np.uint8)).astype(bool)
        for batch in tokens.chunks(batches, "text"):
            w = tokens.split(batch.column("text"), tokens.ALPHANUMERIC, tokens.LOWER)
            found = []
            for s in sizes:
                h, inside = w.windows(s)
                at = np.flatnonzero(inside & known[h & np.uint64(len(known) - 1)])
                found.append((at, np.full(len(at), s), h[at].view(np.int64)))
            pos, size, h = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64),) * 3
            order = np.argsort(pos, kind="stable")
            pos, size, h = pos[order], size[order], h[order]
            text = np.searchsorted(w.first, pos, side="right") - 1
            hits: list = [[] for _ in range(batch.num_rows)]
            pieces: list = [[] for _ in range(batch.num_rows)]
            for d in np.unique(text):
                first, last = int(w.first[d]), int(w.first[d + 1])
                a, b = np.searchsorted(text, [d, d + 1])
                hits[d] = [{"pos": int(p) - first, "s": int(s), "h": int(x)} for p, s, x in zip(pos[a:b], size[a:b], h[a:b], strict=True)]
                low, high = np.maximum(pos[a:b] - window, first) - first, pos[a:b] - first
                for k in np.unique(np.concatenate([low // piece, high // piece])).tolist():  # a window is shorter than a piece
                    begin = first + k * piece
                    said = [w.word(j).decode("utf-8", "replace") for j in range(begin, min(begin + piece + window, last))]
                    pieces[d].append({"piece": k, "words": said})
            kept = [batch.column(c) for c in batch.schema.names if c != "text"]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(w.counts, pa.int64()), pa.array(hits, hit_type), pa.array(pieces, piece_type)], [*names, "n_words", "hits", "pieces"])

    return run


def _hits(docs: DataFrame, items: DataFrame, window: int, piece: int) -> DataFrame:
    """A row for each document: its other columns, n_words, hits (shingles that may be an item's) and pieces of words around them."""
    marks = items.select((F.col("h").bitwiseAND(F.lit(BITS - 1))).alias("b")).distinct().toPandas()["b"].to_numpy()  # BITS rows at most
    known = np.zeros(BITS, dtype=bool)
    known[marks.astype(np.int64)] = True
    sizes = sorted(r["s"] for r in items.select("s").distinct().collect())  # one for each shingle size
    schema = T.StructType([f for f in docs.schema.fields if f.name != "text"])
    made = T._parse_datatype_string(_HITS)
    schema = T.StructType([*schema.fields, *made.fields])
    return docs.mapInArrow(_scan(np.packbits(known).tobytes(), sizes, window, piece), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """docs' columns but text, and n_words, n_hit, items (sorted array of item ids as strings).

    docs: text and any others; benchmark: item_id, text.
    """
    size = max(PIECE, window)
    raw = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = materialize(raw.mapInPandas(_item_windows(window, shingle), _WINDOWS), "item-windows")
    base = materialize(_hits(docs, items, window, size).withColumn("__rid", F.monotonically_increasing_id()), "document-hits", rebalance=True)
    hits = base.select("__rid", "n_words", F.explode("hits").alias("x")).select("__rid", "n_words", "x.*")
    pieces = base.select("__rid", F.explode("pieces").alias("x")).select("__rid", "x.*")
    shingles = items.select("win", "len", "place", "s", "h").distinct()
    seen = base.select(F.explode("hits").alias("x")).groupBy("x.s", "x.h").agg(F.count(F.lit(1)).alias("n"))
    rarest = Window.partitionBy("win", "len").orderBy(F.coalesce("n", F.lit(0)), "h", "place")
    prefix = materialize(shingles.join(seen, ["s", "h"], "left").withColumn("__r", F.row_number().over(rarest)).where("__r = 1 and n > 0").select("win", "len", "place", "s", "h"), "prefixes")
    start = F.col("pos") - F.col("place")
    bounded = hits.join(prefix, ["s", "h"]).withColumn("start", start).where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n_words")))
    held = bounded.withColumn("piece", F.floor(F.col("start") / size).cast("int")).join(pieces, ["__rid", "piece"])
    there = F.array_join(F.slice("words", F.col("start") - F.col("piece") * size + 1, F.col("len")), " ")
    true = held.where(there == F.col("win")).select("__rid", "start", "len", "win")
    runs = F.array_sort(F.collect_set(F.struct("start", "len")))
    covered = F.aggregate(
        runs,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, r: F.struct(F.greatest(a["end"], r["start"] + r["len"]).alias("end"), (a["n"] + F.greatest(F.lit(0), r["start"] + r["len"] - F.greatest(a["end"], r["start"]))).alias("n")),
        lambda a: a["n"],
    )
    words_hit = true.groupBy("__rid").agg(covered.alias("n_hit"))
    ids = items.select("win", "item_id").distinct()
    of = true.select("__rid", "win").distinct().join(ids, "win").groupBy("__rid").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    out = base.drop("hits", "pieces").join(words_hit.join(of, "__rid", "left"), "__rid", "left").drop("__rid")
    return out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "items": F.coalesce("items", F.array().cast("array<string>"))})


def clean_documents(df: DataFrame, benchmark: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` without any item's window, with its own columns."""
    key = F.struct(F.col(f"`{ident}`").alias("i"), F.xxhash64(F.col(f"`{text}`")).alias("t"))
    hit = decontaminate(df.select(key.alias("k"), F.col(f"`{text}`").alias("text")), benchmark).where("n_hit > 0").select(F.col("k.i").alias("__i"), F.col("k.t").alias("__t")).distinct()
    row = boxed(df)
    same = F.col(f"__row.`{ident}`").eqNullSafe(F.col("__i")) & (F.xxhash64(F.col(f"__row.`{text}`")) == F.col("__t"))
    return unboxed(row.join(materialize(hit, "contaminated"), same, "left_anti"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {"op10_decontamination": op10_decontamination}
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_ORACLE = f"""
with d as materialized (select doc_id, {_WORDS} as w from documents),
b as (select item_id::varchar as item_id, {_WORDS} as w from benchmark),
i as (select item_id, w, least({WINDOW}, len(w)) as n from b where len(w) > 0),
v as (select distinct item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) as win from i),
s as (select distinct n from v),
p as (select doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) as win, unnest(range(1, len(w) - n + 2)) as pos from d, s where len(w) >= n),
h as (select p.doc_id, p.n, p.pos, p.win from p where (n, win) in (select n, win from v)),
c as (select doc_id, count(*) as n_hit from (select distinct doc_id, pos + k as at from h, range({WINDOW}) r(k) where k < n) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct h.doc_id, v.item_id from h join v on h.n = v.n and h.win = v.win) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c on d.doc_id = c.doc_id left join t on d.doc_id = t.doc_id
"""
ORACLES = {"op10_decontamination": _ORACLE}
