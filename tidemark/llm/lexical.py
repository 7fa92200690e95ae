"""Ranked lexical search as a threshold-seeded join of stored postings with a set of items.

Postings are written once, a row a document: its length, its terms that some item has (hashes, with how often they
occur). A term's impact in a document is its weight times a saturated share, in whole numbers. A second pass keeps for
each term the ``k`` greatest shares: the greatest bounds what the term can add to any document, and the k-th says that k
documents reach that impact alone, so the greatest k-th impact of an item's terms is below the item's k-th score.

An item's terms, in the order of their bounds, are pruned from below while their bounds together stay under that
threshold: a document that has no other term of the item can't be among the best. What is left joins with the postings,
items in blocks of about ``BLOCK_TERMS`` terms, which is what a task holds of them; sums that stay under the threshold
even with all pruned terms are dropped, the others are candidates, whose pruned terms are looked up for the exact score.
A task raises the thresholds by the scores that it has found. Each task gives at most k rows an item, which meet in two
steps. Terms are compared by 64-bit hashes.

Defined cases: a null or empty text has no terms, so a document of it is never found and not counted, and an item of it
has no rows; a very long text is read whole and makes one row of postings; equal scores rank by ascending doc_id, null
ids last; repeated rows of documents are documents of their own, and repeated items are answered each; an item whose
terms no document has gets no rows; empty tables give an empty result; extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import tokens
from tidemark.llm.common import materialize, table

TOP, FLAT, SLOPE = 10, 25, 75
#: Bits of the bitmap of the items' terms, a power of two; when it fills up, more postings are stored.
BITS = 1 << 22
#: Terms of the items of a block, about, and sums of (document, item) that a task holds at once.
BLOCK_TERMS, CELLS = 1 << 20, 1 << 18
#: Parts in which rows of one term or item meet first.
PARTS = 64
_LARGEST = np.iinfo(np.int64).max


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tokens.chunks(batches, "text"):
        w = tokens.split(batch.column("text"), tokens.ALPHANUMERIC, tokens.LOWER)
        item, term, times = _counted(w, np.ones(len(w.hash), dtype=bool))
        yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(item)), pa.array(term), pa.array(times)], ["item", "term", "times"])


def _counted(w: tokens.Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, term and number of occurrences of the words in ``keep``, by text and term."""
    of, h = w.of[keep].astype(np.int64), w.hash[keep].view(np.int64)
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    new = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, dtype=np.int64)
    return of[new], h[new], np.diff(np.r_[new, len(h)])


def _postings(bits: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(np.frombuffer(bits, dtype=np.uint8)).astype(bool)
        for batch in tokens.chunks(batches, "text"):
            w = tokens.split(batch.column("text"), tokens.ALPHANUMERIC, tokens.LOWER)
            text, term, times = _counted(w, known[w.hash & np.uint64(len(known) - 1)])
            first = pa.array(np.searchsorted(text, np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(first, pa.array(x)) for x in (term, times)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(w.counts, pa.int64()), *lists], ["doc_id", "n", "terms", "times"])

    return run


def postings(docs: DataFrame, item_terms: DataFrame) -> DataFrame:
    """doc_id, n (terms with repeats), terms, times: the written rows of all documents. docs: doc_id long, text."""
    marks = item_terms.select(F.col("term").bitwiseAND(F.lit(BITS - 1)).alias("b")).distinct().toPandas()["b"]  # BITS rows at most
    known = np.zeros(BITS, dtype=bool)
    known[marks.to_numpy().astype(np.int64)] = True
    return materialize(docs.mapInArrow(_postings(np.packbits(known).tobytes()), "doc_id long, n long, terms array<long>, times array<long>"), "postings")


def _shares(n: np.ndarray, times: np.ndarray, docs: int, total: int) -> np.ndarray:
    """The saturated share of each posting. n: its document's terms; docs, total: documents and terms of all."""
    if len(n) and int(n.max()) * SLOPE > _LARGEST // docs:  # beyond 64 bits
        long = np.array([int(x) * SLOPE * docs // total for x in n], dtype=np.int64)
    else:
        long = SLOPE * n * docs // total if len(n) else n
    return 1_000_000_000 * times // (1000 * times + 8 * (FLAT + long))


def _best(group: np.ndarray, value: np.ndarray, then: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest values of each group, of equal ones those of least ``then``; by group and rank."""
    order = np.lexsort((then, -value, group))
    g = group[order]
    index = np.arange(len(g))
    new = np.r_[True, g[1:] != g[:-1]] if len(g) else np.zeros(0, dtype=bool)
    return order[index - np.maximum.accumulate(np.where(new, index, 0)) < k]


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n of each document, and document, term and times of each posting."""
    n = batch.column("n").to_numpy(zero_copy_only=False)
    lists = batch.column("terms")
    doc = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
    return n, doc, lists.flatten().to_numpy(zero_copy_only=False), batch.column("times").flatten().to_numpy(zero_copy_only=False)


def _pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def term_bounds(stored: DataFrame, docs: int, total: int, k: int) -> DataFrame:
    """term, df, top, kth: documents that have the term, its greatest share and its k-th (0: fewer have it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term, share, df = (np.zeros(0, dtype=np.int64) for _ in range(3))
        for batch in _pieces(batches, 4096):
            n, doc, t, times = _columns(batch)
            term, share, df = np.r_[term, t], np.r_[share, _shares(n[doc], times, docs, total)], np.r_[df, np.ones(len(t), dtype=np.int64)]
            values, at = np.unique(term, return_inverse=True)
            sums = np.zeros(len(values), dtype=np.int64)
            np.add.at(sums, at, df)
            keep = _best(at, share, at, k)
            term, share, at = term[keep], share[keep], at[keep]
            df = np.where(np.r_[True, at[1:] != at[:-1]], sums[at], 0) if len(at) else at
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(share), pa.array(df)], ["term", "share", "df"])

    rows = materialize(stored.select("n", "terms", "times").mapInArrow(run, "term long, share long, df long").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS))), "shares")
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("share")))
    best = rows.select("term", "part", "share").withColumn("r", rank("term", "part")).where(F.col("r") <= k).withColumn("r", rank("term")).where(F.col("r") <= k)
    ends = best.groupBy("term").agg(F.max("share").alias("top"), F.coalesce(F.max(F.when(F.col("r") == k, F.col("share"))), F.lit(0)).alias("kth"))
    return rows.groupBy("term").agg(F.sum("df").alias("df")).join(ends, "term")


def plan(item_terms: DataFrame, bounds: DataFrame, docs: int) -> DataFrame:
    """item, term, factor, pruned, threshold, rest: what the join needs of each item's terms; rest bounds all pruned ones together."""
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * docs + 2.0) / (F.col("df") * 2 + 1).cast("double")))
    found = item_terms.join(bounds, "term").withColumn("factor", F.col("times") * weight).where("factor > 0")
    own = Window.partitionBy("item")
    below = own.orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("bound", F.col("factor") * F.col("top")).withColumn("threshold", F.max(F.col("factor") * F.col("kth")).over(own))
    found = found.withColumn("so_far", F.sum("bound").over(below)).withColumn("pruned", F.col("so_far") < F.col("threshold"))
    return found.withColumn("rest", F.coalesce(F.max(F.when(F.col("pruned"), F.col("so_far"))).over(own), F.lit(0))).select("item", "term", "factor", "pruned", "threshold", "rest")


class _Lists:
    """For each key from 0 to n - 1 a list of (other, factor)."""

    def __init__(self, key: np.ndarray, other: np.ndarray, factor: np.ndarray, n: int):
        order = np.argsort(key, kind="stable")
        self.other, self.factor = other[order], factor[order]
        self.first = np.searchsorted(key[order], np.arange(n + 1))

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For all entries of the lists of ``keys``: which of keys, and the entry's place."""
        counts = self.first[keys + 1] - self.first[keys]
        which = np.repeat(np.arange(len(keys)), counts)
        return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(self.first[keys], counts)


def _search(block: pd.DataFrame, docs: int, total: int, k: int):
    """item, doc_id, score: of each task the k best documents of each item of ``block``, as far as they may be among the best of all."""
    items, item = np.unique(block["item"].to_numpy(), return_inverse=True)
    vocabulary, term = np.unique(block["term"].to_numpy(), return_inverse=True)
    factor, pruned = block["factor"].to_numpy(), block["pruned"].to_numpy().astype(bool)
    by_term = _Lists(term[~pruned], item[~pruned], factor[~pruned], len(vocabulary))
    by_item = _Lists(item[pruned], term[pruned], factor[pruned], len(items))
    threshold, rest = (np.zeros(len(items), dtype=np.int64) for _ in range(2))
    threshold[item], rest[item] = block["threshold"].to_numpy(), block["rest"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = threshold.copy()
        best_item, best_score, best_doc = (np.zeros(0, dtype=np.int64) for _ in range(3))
        width, wide = len(items), len(vocabulary)
        for batch in _pieces(batches, max(1, CELLS // width)):
            n, doc, t, times = _columns(batch)
            at = np.minimum(np.searchsorted(vocabulary, t), wide - 1)
            there = vocabulary[at] == t
            doc, at = doc[there], at[there]
            share = _shares(n[doc], times[there], docs, total)
            which, place = by_term.of(at)
            score = np.zeros(batch.num_rows * width, dtype=np.int64)
            np.add.at(score, doc[which] * width + by_term.other[place], by_term.factor[place] * share[which])
            cell = np.flatnonzero(score)
            cell = cell[score[cell] + rest[cell % width] >= least[cell % width]]
            d, i, score = cell // width, cell % width, score[cell]
            which, place = by_item.of(i)
            posting = doc * wide + at  # ascending, as a document's terms are
            wanted = d[which] * wide + by_item.other[place]
            found = np.minimum(np.searchsorted(posting, wanted), max(len(posting) - 1, 0))
            has = posting[found] == wanted
            np.add.at(score, which[has], by_item.factor[place[has]] * share[found[has]])
            keep = score >= np.maximum(least[i], 1)
            ids = batch.column("doc_id").fill_null(_LARGEST).to_numpy(zero_copy_only=False)
            best_item, best_score, best_doc = np.r_[best_item, i[keep]], np.r_[best_score, score[keep]], np.r_[best_doc, ids[d[keep]]]
            keep = _best(best_item, best_score, best_doc, k)
            best_item, best_score, best_doc = best_item[keep], best_score[keep], best_doc[keep]
            full = np.flatnonzero(best_item[k - 1 :] == best_item[: max(0, len(best_item) - k + 1)])  # places of the first of k
            least[best_item[full]] = np.maximum(least[best_item[full]], best_score[full + k - 1])
        known = pa.array(best_doc, mask=best_doc == _LARGEST)
        yield pa.RecordBatch.from_arrays([pa.array(items[best_item]), known, pa.array(best_score)], ["item", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents with a score above 0 for each item.

    docs: doc_id (long), text; items: item_id, text.
    """
    asked = materialize(items.select("item_id", F.col("text").cast("string").alias("text")).withColumn("item", F.monotonically_increasing_id()), "items")
    item_terms = materialize(asked.select("item", "text").mapInArrow(_item_terms, "item long, term long, times long"), "item-terms")
    stored = postings(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), item_terms)
    n_docs, n_terms = stored.agg(F.count(F.when(F.col("n") > 0, True)), F.coalesce(F.sum("n"), F.lit(0))).first()
    bounds = term_bounds(stored, max(n_docs, 1), max(n_terms, 1), k)
    planned = materialize(plan(item_terms, bounds, n_docs), "planned")
    blocks = -(-planned.count() // BLOCK_TERMS)
    schema, found = "item long, doc_id long, score long", None
    for b in range(blocks):
        block = planned.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).toPandas()  # about BLOCK_TERMS rows
        if len(block):
            part = stored.mapInArrow(_search(block, n_docs, n_terms, k), schema)
            found = part if found is None else found.union(part)
    if found is None:
        found = stored.sparkSession.createDataFrame([], schema)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    best = found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS))).withColumn("rank", rank("item", "part")).where(F.col("rank") <= k)
    best = best.withColumn("rank", rank("item")).where(F.col("rank") <= k)
    return best.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op13_lexical_search": op13_lexical_search}
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_ORACLE = f"""
with d as materialized (select row_number() over () as row, doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark),
i as materialized (select item_id, term, count(*) as times from (select item_id, unnest(w) as term from b) group by all),
z as (select count(*) as docs, sum(len(w))::bigint as total from d where len(w) > 0),
p as materialized (select row, term, count(*) as tf from (select row, unnest(w) as term from d) where term in (select term from i) group by all),
f as (select term, count(*) as df from p group by term),
s as (select i.item_id, d.doc_id, d.row, (i.times * floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)))::bigint * ((1000000000 * tf) // (1000 * tf + 8 * ({FLAT} + ({SLOPE} * len(w) * docs) // total))))::bigint as part
  from i join f using (term) join p using (term) join d using (row), z),
t as (select item_id, doc_id, row, sum(part)::bigint as score from s group by all),
r as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from t where score > 0)
select item_id, rank, doc_id, score from r where rank <= {TOP}
"""
ORACLES = {"op13_lexical_search": _ORACLE}
