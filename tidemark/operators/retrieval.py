"""Retrieval for any question: an inverted index in blocks by impact, a search that skips blocks, and a rerank.

An index is two written tables. Documents are cut into shards of about SHARD words where they are read, so no posting is
sent to another task: ``blocks`` has for each shard and term blocks by level of impact, of BLOCK postings at most. A posting
is a document, how often it has the term, and its length. Beside a block stand the postings that may be its greatest,
whatever the mean length of all documents and the number that have the term; both are known when all is written.
``forward`` has the documents of the shards. Impacts are BM25's parts in whole millionths, so sums are exact in any order.

A search reads blocks' heads first, without postings. A question's SEEDS best blocks are read, and what their postings add
up to by document is reached by k documents at least, which is a threshold. Then only blocks are wanted that could still
lift a document over it: those of terms whose bounds, with all smaller ones, reach it, and of these the blocks whose own
bound does together with all other terms'. Blocks are sent once, whatever the number of questions, and meet by shard, where a
document is whole: it stays if what its wanted blocks say, with the bounds of all other terms, reaches the threshold and what k
documents of its shard reach. The few that stay are scored in full, and a shard's k best of each question go on.

Defined cases: null and empty texts count as documents and are never found; rows that share an id add up, those of one length
as if they were one text, as in the SQL; of equal scores a null id is last.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.evidence import K1, RRF, B, nearest
from tidemark.registry import query
from tidemark.session import written
from tidemark.sources.tables import table

#: Postings of a block, at most; levels of impact of a term; blocks a question reads before it has a threshold.
BLOCK, LEVELS, SEEDS = 256, 16, 48
#: Words of a shard, about, which a task holds at once; a level has so many of a shard's postings of a term or more, on average.
SHARD, FEW = 1 << 21, 4
#: Rows of a batch that a task sends on; words of the questions that a shard meets at once, about.
ROWS, ASKED = 8192, 1 << 20
#: No block has such a bound.
NEVER = 1 << 62
TOP, DEEP = 10, 50


def terms_of(text: Column) -> Column:
    """Words of ASCII letters and digits, in lower case."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), "")


def _starts(x: np.ndarray) -> np.ndarray:
    """Places where a sorted array has a new value."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, dtype=np.int64)


def _runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All places of runs that begin at ``first`` and have ``count`` places."""
    return np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)


def _blocks(docs: pa.Table, shard: int) -> Iterator[pa.RecordBatch]:
    """The blocks of a shard, and rows without a term that tell its members. docs: doc_id, dl, rows, w."""
    w = docs.column("w").combine_chunks()
    lengths = docs.column("dl").to_numpy()
    coded = w.flatten().dictionary_encode()
    key = coded.indices.to_numpy().astype(np.int64) * len(lengths) + np.repeat(np.arange(len(lengths)), pc.list_value_length(w).to_numpy())
    key.sort()
    new = _starts(key)
    tf, key = np.diff(np.r_[new, len(key)]), key[new]  # by term, then document
    term, doc = np.divmod(key, len(lengths))
    dl = lengths[doc]
    # levels needn't be alike in all shards, so the shard's own mean length does
    share = tf / (tf + K1 * (1 - B + B * dl / lengths.mean()))
    first = _starts(term)
    df = np.diff(np.r_[first, len(term)])
    levels = np.clip(df // FEW, 1, LEVELS)[term]
    level = np.minimum((share * levels / np.maximum.reduceat(share, first)[term]).astype(np.int64), levels - 1) if len(term) else term
    run = term * LEVELS + level
    order = np.argsort(run, kind="stable")
    run, tf, dl, doc = run[order], tf[order], dl[order], doc[order]
    first = _starts(run)
    place = np.arange(len(run)) - np.repeat(first, np.diff(np.r_[first, len(run)]))
    new = np.flatnonzero(place % BLOCK == 0)
    ends = np.r_[new, len(run)]
    # of the postings that have the term equally often the one of the shortest document is the greatest
    block = np.repeat(np.arange(len(new)), np.diff(ends))
    pair = block * (tf.max(initial=0) + 1) + tf
    order = np.argsort(pair, kind="stable")
    some = _starts(pair[order])
    short = np.minimum.reduceat(dl[order], some) if len(some) else dl
    often, of = tf[order][some], np.searchsorted(block[order][some], np.arange(len(new) + 1))
    lists = lambda at, values: pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)
    out = pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(new), shard)), coded.dictionary.take(pa.array(run[new] // LEVELS)), pa.array(run[new] % LEVELS, pa.int32()), pa.array(place[new] // BLOCK, pa.int32()),
            pa.array(np.diff(ends)), lists(of, pa.array(often, pa.int32())), lists(of, pa.array(short, pa.int32())),
            lists(ends, docs.column("doc_id").take(pa.array(doc)).combine_chunks()), lists(ends, pa.array(tf, pa.int32())), lists(ends, pa.array(dl, pa.int32())),
        ],
        ["shard", "term", "level", "part", "n", "best_tf", "best_dl", "docs", "tf", "dl"],
    )
    schema = out.schema.append(pa.field("members", pa.list_(pa.struct([docs.schema.field(x) for x in ("doc_id", "dl", "rows")]))))
    yield from (pa.RecordBatch.from_pylist([{"shard": shard, "members": x.to_pylist()}], schema) for x in docs.select(["doc_id", "dl", "rows"]).to_batches(ROWS))
    out = pa.RecordBatch.from_arrays([*out.columns, pa.nulls(out.num_rows, schema.field("members").type)], schema=schema)
    yield from (out.slice(k, ROWS) for k in range(0, out.num_rows, ROWS))


def _shards(words: int):
    """Blocks of the documents of a task, by shards of about so many words. Neighbours of one id are in one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last, number = [], 0, None, TaskContext.get().partitionId() << 32
        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch.column("w")).to_numpy())
            while batch.num_rows:
                if size >= words and batch.column("doc_id")[0].as_py() != last:
                    yield from _blocks(pa.Table.from_batches(held), number)
                    held, size, number = [], 0, number + 1
                take = min(int(np.searchsorted(ends, words - size)) + 1, batch.num_rows)
                held.append(batch.slice(0, take))
                size, last = size + int(ends[take - 1]), batch.column("doc_id")[take - 1].as_py()
                batch, ends = batch.slice(take), ends[take:] - ends[take - 1]
        if held:
            yield from _blocks(pa.Table.from_batches(held), number)

    return run


def _impact(tf: Column, dl: Column) -> Column:
    """A posting's part in whole millionths. Columns idf and avgdl."""
    part = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))
    return F.floor(part * 1e6 + 0.5)


@dataclass
class Index:
    """stored: shard, term, level, part, n, best_tf, best_dl and the postings' docs, tf, dl; forward: shard, doc_id, dl, rows (that
    share id and length); total: one row, the number of documents, their mean length, and how many share an id at most."""

    stored: DataFrame
    forward: DataFrame
    total: DataFrame

    @classmethod
    def build(cls, docs: DataFrame) -> Index:
        """docs: doc_id (distinct, as a rule), text."""
        repeated = written(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("doc_id").alias("id"), "rows"), "repeated-ids")
        words = docs.select("doc_id", terms_of(F.col("text")).alias("w")).select("doc_id", F.size("w").alias("dl"), F.lit(1).cast("long").alias("rows"), "w")
        again = F.col("doc_id").eqNullSafe(F.col("id"))
        added = words.join(repeated.select("id"), again, "left_semi").groupBy("doc_id", "dl").agg(F.sum("rows").alias("rows"), F.flatten(F.collect_list("w")).alias("w"))
        words = words.join(repeated.select("id"), again, "left_anti").union(added.repartition("doc_id").sortWithinPartitions("doc_id"))
        kind = docs.schema["doc_id"].dataType.simpleString()
        columns = f"shard long, term string, level int, part int, n long, best_tf array<int>, best_dl array<int>, docs array<{kind}>, tf array<int>, dl array<int>"
        rows = written(words.mapInArrow(_shards(SHARD), f"{columns}, members array<struct<doc_id:{kind},dl:int,rows:long>>"), "blocks")
        forward = written(rows.where("members is not null").select("shard", F.explode("members").alias("m")).select("shard", "m.*"), "forward")
        total = forward.agg(F.sum("rows").alias("all"), F.sum(F.col("dl") * F.col("rows")).alias("words")).crossJoin(repeated.agg(F.coalesce(F.max("rows"), F.lit(1)).alias("rows")))
        return cls(rows.where("term is not null").drop("members"), forward, written(total.select("all", (F.col("words") / F.col("all")).alias("avgdl"), "rows"), "total"))

    def weights(self, of: DataFrame | None = None) -> DataFrame:
        """term, idf, avgdl, rows: of all terms, or of those of ``of`` (term)."""
        rows = self.stored.select("term", "n")
        df = (rows if of is None else rows.join(of, "term", "left_semi")).groupBy("term").agg(F.sum("n").alias("df"))
        return df.crossJoin(F.broadcast(self.total)).select("term", F.log(1 + (F.col("all") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "avgdl", "rows")

    def scored(self, weights: DataFrame) -> DataFrame:
        """The blocks of the terms of ``weights``, with ``top``, the most that a block can add to an id, and ``impacts`` of all postings."""
        impacts = lambda tf, dl: F.zip_with(tf, dl, _impact)
        return self.stored.join(weights, "term").withColumns({"top": F.array_max(impacts("best_tf", "best_dl")) * F.col("rows"), "impacts": impacts("tf", "dl")})

    @property
    def blocks(self) -> DataFrame:
        """shard, term, level, part, top, n, postings (doc_id, impact)."""
        postings = F.zip_with("docs", "impacts", lambda d, i: F.struct(d.alias("doc_id"), i.alias("impact")))
        return self.scored(self.weights()).select("shard", "term", "level", "part", "top", "n", postings.alias("postings"))


def _best(k: int):
    """q, doc_id, score of the documents of a shard that can be among the k best of a question.

    asked: q, term, times, least (of a wanted block's bound), rest (bounds of all terms without wanted blocks), limit. blocks:
    term, top, docs, impacts.
    """

    def run(asked: pa.Table, blocks: pa.Table) -> pa.Table:
        names = pc.unique(asked.column("term"))
        times, least, rest, limit = (asked.column(x).to_numpy() for x in ("times", "least", "rest", "limit"))
        term = pc.index_in(asked.column("term"), value_set=names).to_numpy()
        at = pc.index_in(blocks.column("term"), value_set=names).to_numpy()
        order = np.argsort(at, kind="stable")
        first = np.searchsorted(at[order], np.arange(len(names) + 1))
        top, docs = blocks.column("top").to_numpy(), blocks.column("docs").combine_chunks()
        size = pc.list_value_length(docs).to_numpy()
        begin = np.cumsum(size) - size
        coded = docs.flatten().dictionary_encode(null_encoding="encode")
        doc, ids, impact = coded.indices.to_numpy(), coded.dictionary, blocks.column("impacts").combine_chunks().flatten().to_numpy()
        later = np.argsort(pc.sort_indices(ids).to_numpy())
        question = asked.column("q").combine_chunks().dictionary_encode()
        by = question.indices.to_numpy()
        rows = np.argsort(by, kind="stable")
        found = [[np.zeros(0, dtype=np.int64)] for _ in range(3)]

        def sums(block: np.ndarray, row: np.ndarray) -> np.ndarray:
            place, factor = _runs(begin[block], size[block]), np.repeat(times[row], size[block])
            return np.bincount(doc[place], impact[place] * factor, len(ids)).astype(np.int64)

        for mine in np.split(rows, _starts(by[rows])[1:]) if len(ids) and len(rows) else ():
            count = first[term[mine] + 1] - first[term[mine]]
            block, row = order[_runs(first[term[mine]], count)], np.repeat(mine, count)
            wanted = top[block] * times[row] >= least[row]
            score = sums(block[wanted], row[wanted])
            reached = np.partition(score, -k)[-k] if len(score) >= k else 0
            keep = np.flatnonzero((score > 0) & (score + rest[mine[0]] >= max(limit[mine[0]], reached)))
            if len(keep):
                score = score[keep] + sums(block[~wanted], row[~wanted])[keep]
                best = np.lexsort((later[keep], -score))[:k]
                for held, x in zip(found, (np.full(len(best), by[mine[0]]), keep[best], score[best]), strict=True):
                    held.append(x)
        q, d, score = map(np.concatenate, found)
        return pa.table({"q": question.dictionary.take(pa.array(q)), "doc_id": ids.take(pa.array(d)), "score": score})

    return run


def search(index: Index, questions: DataFrame, k: int = TOP) -> tuple[DataFrame, DataFrame]:
    """q, rk, doc_id, score of the k best documents of each question, best first, ties by id; and q, postings, read: the
    postings of the question's terms and how many of them were read in blocks to find documents.

    questions: q (distinct), text.
    """
    asked = written(questions.select("q", F.explode(terms_of(F.col("text"))).alias("term")).groupBy("q", "term").agg(F.count(F.lit(1)).alias("times")), "asked")
    weights = written(index.weights(asked.select("term").distinct()), "weights")
    key = ["shard", "term", "level", "part"]
    heads = written(index.scored(weights).select(*key, "top", "n"), "heads")
    own, bound = Window.partitionBy("q"), F.col("top") * F.col("times")
    first = heads.join(asked, "term").withColumn("place", F.row_number().over(own.orderBy(bound.desc(), *key))).where(F.col("place") <= SEEDS)
    first = written(first.drop("place"), "first-blocks")
    # what k documents reach by these blocks alone
    read = index.stored.select(*key, "docs", "tf", "dl").join(first.select("q", "times", *key), key).join(weights, "term")
    read = read.select("q", "times", "idf", "avgdl", F.explode(F.arrays_zip("docs", "tf", "dl")).alias("p"))
    sums = read.groupBy("q", "p.docs").agg(F.sum(_impact(F.col("p.tf"), F.col("p.dl")) * F.col("times")).alias("sure"))
    reached = sums.withColumn("place", F.row_number().over(own.orderBy(F.desc("sure")))).where(F.col("place") == k).select("q", F.col("sure").alias("limit"))
    terms = heads.groupBy("term").agg(F.max("top").alias("top"), F.sum("n").alias("n")).join(asked, "term").select("q", "term", "times", "n", bound.alias("most"))
    terms = terms.withColumns({"below": F.sum("most").over(own.orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("most").over(own)})
    # what a block must add at least, if it isn't to be left out; none of a term is wanted whose bound, with all smaller ones, is below the limit
    slight = F.col("below") < F.col("limit")
    least = F.when(slight, NEVER).otherwise(F.col("limit") - F.col("all") + F.col("most"))
    rest = F.coalesce(F.max(F.when(slight, F.col("below"))).over(own), F.lit(0))
    plan = terms.join(reached, "q", "left").withColumn("limit", F.coalesce("limit", F.lit(0))).select("q", "term", "times", "n", "limit", least.alias("least"), rest.alias("rest"))
    plan = written(plan, "plan")
    # by shard and, where very many words are asked, by part of the questions
    parts = 1 + asked.count() // ASKED
    sides = plan.select("q", "term", "times", "least", "rest", "limit", F.pmod(F.xxhash64("q"), F.lit(parts)).alias("group")).crossJoin(written(heads.select("shard").distinct(), "shards"))
    lowest = plan.groupBy("term").agg(F.min(F.when(F.col("least") == NEVER, 0.0).otherwise(F.col("least") / F.col("times"))).alias("lowest"))
    blocks = index.scored(weights.join(lowest, "term")).where(F.col("top") >= F.col("lowest")).select("shard", "term", "top", "docs", F.col("impacts").cast("array<int>").alias("impacts"))
    blocks = blocks.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    q, doc_id = asked.schema["q"].dataType.simpleString(), index.stored.schema["docs"].dataType.elementType.simpleString()
    scored = sides.groupBy("shard", "group").cogroup(blocks.groupBy("shard", "group")).applyInArrow(_best(k), f"q {q}, doc_id {doc_id}, score long")
    rank = F.row_number().over(own.orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = scored.withColumn("rk", rank).where(F.col("rk") <= k).select("q", F.col("rk").cast("long").alias("rk"), "doc_id", "score")
    wanted, sides = bound >= F.col("least"), plan.select("q", "term", "times", "least")
    more = first.drop("times").join(sides, ["q", "term"]).where(~wanted).groupBy("q").agg(F.sum("n").alias("more"))
    reads = heads.join(sides, "term").groupBy("q").agg(F.sum("n").alias("postings"), F.coalesce(F.sum(F.when(wanted, F.col("n"))), F.lit(0)).alias("read")).join(more, "q", "left")
    return best, reads.select("q", "postings", (F.col("read") + F.coalesce("more", F.lit(0))).alias("read"))


_W = "list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"
_BM = f"""with d as materialized (select doc_id, {_W} as w from documents), k as (select count(*) as n, avg(len(w)) as avgdl from d),
  t as materialized (select doc_id, len(w) as dl, term, count(*) as tf from (select doc_id, w, unnest(w) as term from d) group by all), f as (select term, count(*) as df from t group by term),
  i as materialized (select doc_id, term, floor(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * {K1 + 1}::double / (tf + {K1}::double * ({1 - B}::double + {B}::double * dl / avgdl)) * 1e6 + 0.5)::bigint as impact from t join f using (term), k),
  a as (select item_id as q, term, count(*) as times from (select item_id, unnest({_W}) as term from benchmark) group by all),
  s as materialized (select q, doc_id, sum(impact * times)::bigint as score from a join i using (term) group by all), r as materialized (select *, row_number() over (partition by q order by score desc, doc_id) as rk from s where score > 0)"""


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("q"), "text")


@query("index_topk", f"{_BM} select q as item_id, rk, doc_id, round(score / 1e6::double, 6) as score from r where rk <= {TOP}")
def index_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The best documents for every item of ``benchmark``, through the index."""
    best, _ = search(Index.build(table(spark, sf, "documents").select("doc_id", "text")), _questions(spark, sf))
    return best.select(F.col("q").alias("item_id"), "rk", "doc_id", F.round(F.col("score") / 1e6, 6).alias("score"))


def fuse(lists: DataFrame) -> DataFrame:
    """q, doc_id, fused: ranks of several lists (q, doc_id, rk) as sums of their reciprocals."""
    return lists.groupBy("q", "doc_id").agg(F.round(F.sum(1.0 / (RRF + F.col("rk"))), 9).alias("fused"))


def rerank(fused: DataFrame, questions: DataFrame, docs: DataFrame, top: int = TOP) -> DataFrame:
    """q, rk, doc_id, score: the fused list by its own weight, by the share of the question's words that a document holds,
    and by the share of its pairs of neighbouring words. Only the texts of the list are read for words."""
    pairs = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, 2), " ")))
    q = questions.select("q", terms_of(F.col("text")).alias("qw"))
    d = docs.select("doc_id", "text").join(fused.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", terms_of(F.col("text")).alias("dw"))
    x = fused.join(q, "q").join(d, "doc_id")
    share = lambda a, b: F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_distinct(a)), F.lit(1))
    most = F.max("fused").over(Window.partitionBy("q"))
    score = F.round(0.5 * F.col("fused") / most + 0.3 * share(F.col("qw"), F.col("dw")) + 0.2 * share(pairs(F.col("qw")), pairs(F.col("dw"))), 6)
    x = x.select("q", "doc_id", score.alias("score"))
    return x.withColumn("rk", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc_id")).cast("long")).where(F.col("rk") <= top).select("q", "rk", "doc_id", "score")


_PAIRS = "list_distinct(list_transform(range(1, greatest(len({0}) - 1, 1) + 1), lambda i: array_to_string({0}[i:i + 1], ' ')))"


@query(
    "hybrid_rerank",
    f"""{_BM}, lx as (select q, doc_id, rk from r where rk <= {DEEP}), e as (select vec_id, embedding::double[] as v from embeddings),
  fv as (select q, doc_id as vec_id from (select *, row_number() over (partition by q order by rk) as o from lx where doc_id in (select vec_id from e)) where o = 1),
  dn as (select q, o.vec_id as doc_id, row_number() over (partition by q order by round(list_cosine_similarity(own.v, o.v), 6) desc, o.vec_id) as rk from fv join e own using (vec_id) join e o on o.vec_id <> own.vec_id),
  fu as (select q, doc_id, round(sum(1.0::double / ({RRF} + rk)), 9) as fused from (select * from lx union all select * from dn where rk <= {DEEP}) group by all),
  x as (select fu.*, max(fused) over (partition by q) as most, b.w as qw, d.w as dw from fu join (select item_id as q, {_W} as w from benchmark) b using (q) join d using (doc_id)),
  z as (select q, doc_id, round(0.5 * fused / most + 0.3 * len(list_intersect(list_distinct(qw), list_distinct(dw))) / greatest(len(list_distinct(qw)), 1)::double + 0.2 * len(list_intersect({_PAIRS.format('qw')}, {_PAIRS.format('dw')})) / greatest(len({_PAIRS.format('qw')}), 1)::double, 6) as score from x)
  select q as item_id, rk, doc_id, score from (select *, row_number() over (partition by q order by score desc, doc_id) as rk from z) where rk <= {TOP}""",
)
def hybrid_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """Lexical and dense lists for every item, fused by rank, then ranked again by what the texts say."""
    docs, asked = table(spark, sf, "documents").select("doc_id", "text"), _questions(spark, sf)
    best, _ = search(Index.build(docs), asked, DEEP)
    lexical = written(best, "lexical").select("q", "doc_id", "rk")
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    with_vector = lexical.join(e.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    first = written(with_vector.groupBy("q").agg(F.min_by("doc_id", "rk").alias("vec_id")), "first-hits")
    near = nearest(e.join(first.select("vec_id").distinct(), "vec_id", "left_semi"), e, DEEP)
    dense = first.join(near.select(F.col("query_id").alias("asked"), F.col("vec_id").alias("doc_id"), "rk"), F.col("vec_id") == F.col("asked")).select("q", "doc_id", "rk")
    return rerank(fuse(lexical.union(dense)), asked, docs).withColumnRenamed("q", "item_id")
