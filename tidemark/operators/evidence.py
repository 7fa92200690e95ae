"""Text as evidence: masking, shingles, near duplicates, retrieval, dates, corroboration and checked numbers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.graphs import components
from tidemark.registry import query
from tidemark.session import written
from tidemark.sources.tables import table

#: What is masked, in this order: names after a title, ids of customers and staff, addresses, numbers.
_MASKS = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+", "[EMAIL]"),
    (r"[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}", "[IP]"),
    (r"[+][0-9]{1,3}[ .-]?[(]?[0-9]{2,4}[)]?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}", "[PHONE]"),
    (r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,7}", "[CARD]"),
    (r"(CUST|EMP|ORD|INV|TKT)[-#]?[0-9]{3,}", "[ID]"),
    (r"(Mr|Mrs|Ms|Dr|Prof)[.]? [A-Z][a-z]+( [A-Z][a-z]+)?", "[NAME]"),
]


#: What a text must hold for each mask's pattern to match at all, which is cheaper to look for.
_NEEDED = [("@",), (".",), ("+",), (), ("CUST", "EMP", "ORD", "INV", "TKT"), ("Mr", "Ms", "Dr", "Prof")]


def pii_mask(text: Column) -> Column:
    def step(pattern: str, name: str, needed: tuple[str, ...]):
        def masked(x: Column) -> Column:
            there = reduce(or_, (F.contains(x, F.lit(n)) for n in needed)) if needed else F.lit(True)
            return F.when(there, F.regexp_replace(x, pattern, name)).otherwise(x)

        return masked

    for (pattern, name), needed in zip(_MASKS, _NEEDED, strict=True):
        text = F.transform(F.array(text), step(pattern, name, needed)).getItem(0)  # the text is computed once
    return text


_MASK_SQL = "text"
for _p, _n in _MASKS:
    _MASK_SQL = f"regexp_replace({_MASK_SQL}, '{_p}', '{_n}', 'g')"


@query("pii_mask", f"select doc_id, md5({_MASK_SQL}) as masked_md5, {_MASK_SQL} <> text as changed from documents")
def pii_mask_query(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").withColumn("m", pii_mask(F.col("text"))).select("doc_id", F.md5("m").alias("masked_md5"), (F.col("m") != F.col("text")).alias("changed"))


def shingles(text: Column, n: int = 5) -> Column:
    """Distinct runs of n words; a shorter text is one run."""
    w = F.filter(F.split(F.lower(text), " "), lambda x: x != "")
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
    return F.transform(F.array(w), lambda w: F.array_distinct(runs(w))).getItem(0)


_TERMS = "list_filter(string_split(lower(text), ' '), lambda x: x <> '')"
_SHINGLES = "list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i+4], ' ')))"


@query("shingles", f"with d as (select doc_id, {_TERMS} as w from documents) select doc_id, len({_SHINGLES})::int as n_shingles, list_min({_SHINGLES}) as least from d")
def shingles_query(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "documents").select("doc_id", shingles(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n_shingles"), F.array_min("s").alias("least"))


def minhash_bands(docs: DataFrame, hashes: int = 64, rows: int = 4) -> DataFrame:
    """doc_id, band: the bands of minima of each document. docs: doc_id, s (hashes of shingles)."""
    each = docs.select("doc_id", F.explode("s").alias("h"))
    # minima combine before the exchange, so a document's shingles never travel
    minima = each.groupBy("doc_id").agg(*[F.min(F.xxhash64(F.lit(k), "h")).alias(f"m{k}") for k in range(hashes)])
    signed = minima.select("doc_id", F.array(*[F.col(f"m{k}") for k in range(hashes)]).alias("m"))
    bands = F.transform(F.sequence(F.lit(0), F.lit(hashes // rows - 1)), lambda b: F.xxhash64(b, F.slice("m", b * rows + 1, rows)))
    return signed.select("doc_id", F.explode(bands).alias("band"))


def _by_rare_shingles(docs: DataFrame, similarity: float) -> DataFrame:
    """doc_id, other: documents that share one of their rarest shingles, enough of them that no similar pair is lost."""
    each = docs.select("doc_id", F.size("s").alias("n"), F.explode("s").alias("h"))
    spread = each.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    own = Window.partitionBy("doc_id")
    # shingles of one document come first and link nothing, so they are counted and don't travel
    rank = F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("df", "h"))
    rare = written(each.join(spread, "h").withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1).select("doc_id", "n", "h"), "rare-shingles")
    other = rare.select("h", F.col("doc_id").alias("other"), F.col("n").alias("m"))
    return rare.join(other, "h").where("doc_id > other").where((F.col("m") >= F.col("n") * similarity - 1e-9) & (F.col("n") >= F.col("m") * similarity - 1e-9)).select("doc_id", "other").distinct()


def near_duplicates(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """doc_id, class_id, links: each document's class by exact similarity of shingles, and how many texts it is linked to.

    docs: doc_id (distinct), text. Equal texts are one class from the start. Members of a band meet its first one; in bands
    whose members aren't all linked by that, those with a rare shingle in common are compared too, which loses no pair.
    Shingles travel as their 64-bit hashes, a quarter of their words' size; two of one text are taken for one where these meet.
    """
    text = written(docs.groupBy(F.sha2("text", 256).alias("t")).agg(F.min("doc_id").alias("first_id"), F.first("text").alias("text")), "texts")
    hashes = F.array_distinct(F.transform(shingles(F.col("text")), lambda x: F.xxhash64(x)))
    sets = written(text.select(F.col("first_id").alias("doc_id"), hashes.alias("s")), "shingles")
    members = written(minhash_bands(sets), "bands")
    first = members.groupBy("band").agg(F.min("doc_id").alias("other"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = written(members.join(first, "band").where("doc_id <> other").select("doc_id", "other").distinct(), "stars")

    def similar(pairs: DataFrame) -> DataFrame:
        both = F.size(F.array_intersect("s", "o"))
        j = both / (F.size("s") + F.size("o") - both)
        full = pairs.join(sets, "doc_id").join(sets.select(F.col("doc_id").alias("other"), F.col("s").alias("o")), "other")
        return full.where(j >= similarity).select(F.col("doc_id").alias("u"), F.col("other").alias("v"))

    links = written(similar(stars), "similar")
    roots = components(links)
    rooted = members.join(roots, F.col("doc_id") == F.col("node"), "left").select("band", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    open_bands = rooted.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("band")
    rest = written(members.join(open_bands, "band").select("doc_id").distinct(), "open-texts")
    more = _by_rare_shingles(sets.join(rest, "doc_id", "left_semi"), similarity).join(stars, ["doc_id", "other"], "left_anti")
    more = written(more, "more-pairs")  # with a size that the planner knows: few pairs are sent to the sets, not the sets to them
    links = written(links.union(similar(more)), "all-similar")
    roots = components(links)
    degree = links.select("u").union(links.select("v")).groupBy(F.col("u").alias("first_id")).agg(F.count(F.lit(1)).alias("links"))
    named = text.select("t", "first_id").join(roots.withColumnRenamed("node", "first_id"), "first_id", "left").join(degree, "first_id", "left")
    named = named.select("t", F.coalesce("root", "first_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    return docs.select("doc_id", F.sha2("text", 256).alias("t")).join(named, "t").select("doc_id", "class_id", "links")


@query("minhash_dups")
def minhash_dups(spark: SparkSession, sf: str) -> DataFrame:
    """One story, many outlets: the class of every document among near copies of similarity 0.8 or more."""
    return near_duplicates(table(spark, sf, "documents").select("doc_id", "text"))


@query("exact_dups", "select min(doc_id) as first_id, count(*) as copies from documents group by text having count(*) > 1")
def exact_dups(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("h")


@query("independent_sources", "with c as (select text, lang, count(distinct source) as sources from documents group by all) select lang, count(*) as stories, sum(sources)::bigint as outlets, count(*) filter (sources > 1) as syndicated from c group by lang")
def independent_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Forty customers are forty signals, a syndicated story is one."""
    c = table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("h"), "lang").agg(F.count_distinct("source").alias("sources"))
    return c.groupBy("lang").agg(F.count(F.lit(1)).alias("stories"), F.sum("sources").alias("outlets"), F.count_if(F.col("sources") > 1).alias("syndicated"))


K1, B, TOP = 1.5, 0.75, 10
_QUERY_TERMS = ("license", "token", "the", "rights")


def bm25(docs: DataFrame, terms: tuple[str, ...], top: int = TOP) -> DataFrame:
    """doc_id, score of the best documents: postings of the query's terms alone, with corpus totals beside them."""
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "), " "), lambda x: x != "")
    d = docs.select("doc_id", words.alias("w")).select("doc_id", F.size("w").alias("dl"), F.filter("w", lambda x: x.isin(*terms)).alias("hits"))
    d = written(d.select("doc_id", "dl", *[F.size(F.filter("hits", lambda x: x == t)).alias(f"t{i}") for i, t in enumerate(terms)]), "postings")  # texts are read once
    totals = d.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"t{i}") > 0).alias(f"n{i}") for i in range(len(terms))])  # one row
    s = d.where(sum((F.col(f"t{i}") for i in range(len(terms))), F.lit(0)) > 0).crossJoin(F.broadcast(totals))
    part = lambda i: F.log(1 + (F.col("n") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5)) * F.col(f"t{i}") * (K1 + 1) / (F.col(f"t{i}") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    score = F.round(sum((part(i) for i in range(len(terms))), F.lit(0.0)), 6)
    return s.select("doc_id", score.alias("score")).orderBy(F.desc("score"), "doc_id").limit(top)


_BM_PART = " + ".join(f"ln(1 + (n - n{i} + 0.5) / (n{i} + 0.5)) * t{i} * {K1 + 1} / (t{i} + {K1} * (1 - {B} + {B} * dl / avgdl))" for i in range(len(_QUERY_TERMS)))


@query("bm25_topk", "with w as (select doc_id, list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') as w from documents), d as (select doc_id, len(w) as dl, " + ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) as t{i}" for i, t in enumerate(_QUERY_TERMS)) + " from w), k as (select count(*) as n, avg(dl) as avgdl, " + ", ".join(f"count(*) filter (t{i} > 0) as n{i}" for i in range(len(_QUERY_TERMS))) + f" from d) select doc_id, round({_BM_PART}, 6) as score from d, k where {' + '.join(f't{i}' for i in range(len(_QUERY_TERMS)))} > 0 order by score desc, doc_id limit {TOP}")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return bm25(table(spark, sf, "documents"), _QUERY_TERMS)


@query("dense_topk", "with q as (select vec_id as query_id, embedding as q from embeddings where vec_id % 100 = 0), s as (select query_id, vec_id, round(list_cosine_similarity(q::double[], embedding::double[]), 6) as sim from q, embeddings where query_id <> vec_id) select * from (select *, row_number() over (partition by query_id order by sim desc, vec_id) as rk from s) where rk <= 5")
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest vectors of each query vector."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return nearest(e.where("vec_id % 100 = 0"), e)  # the stated query set


#: Query vectors and vectors that meet in one matrix product.
QUERY_BLOCK, VECTOR_BLOCK = 512, 1024


def _blocks(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, most):
                part = batch.slice(k, most)
                vectors = part.column("v")
                width = len(vectors[0].as_py())
                flat = vectors.flatten().to_numpy().reshape(len(vectors), width)
                norm = np.linalg.norm(flat, axis=1, keepdims=True)
                unit = np.divide(flat, norm, out=np.zeros_like(flat), where=norm > 0)
                yield pa.RecordBatch.from_arrays([pa.array([part.column("vec_id").to_pylist()], pa.list_(pa.int64())), pa.array([unit.tobytes()], pa.binary()), pa.array([width], pa.int32())], ["ids", "m", "width"])

    return run


def _best(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one pair of blocks at a time, whose matrices are read in place
                row = {c: batch.column(c)[k] for c in ("qids", "qm", "ids", "m", "width")}
                q, v = (np.frombuffer(row[c].as_buffer()).reshape(-1, row["width"].as_py()) for c in ("qm", "m"))
                ids, asked = (row[c].values.to_numpy() for c in ("ids", "qids"))
                sim = np.round(q @ v.T, 6)
                sim[asked[:, None] == ids[None, :]] = -np.inf
                # only what reaches a query's last place is put in order, ties with it included
                last = np.partition(sim, -top, axis=1)[:, -top] if top < len(ids) else np.full(len(asked), -np.inf)
                at, of = np.nonzero((sim >= last[:, None]) & np.isfinite(sim))
                order = np.lexsort((ids[of], -sim[at, of], at))
                at, of = at[order], of[order]
                kept = np.arange(len(at)) - np.searchsorted(at, at) < top
                at, of = at[kept], of[kept]
                yield pa.RecordBatch.from_arrays([pa.array(asked[at]), pa.array(ids[of]), pa.array(sim[at, of])], ["query_id", "vec_id", "sim"])

    return run


def nearest(queries: DataFrame, vectors: DataFrame, top: int = 5) -> DataFrame:
    """query_id, vec_id, sim, rk: the nearest by cosine, a vector itself left out. Both: vec_id (long), v (array of doubles).

    Vectors of a partition make blocks, and each pair of a query block and a vector block is one matrix product, of which
    only the best go on.
    """
    kind = "ids array<long>, m binary, width int"
    q = written(queries.mapInArrow(_blocks(QUERY_BLOCK), kind), "queries").select(F.col("ids").alias("qids"), F.col("m").alias("qm"))
    s = vectors.mapInArrow(_blocks(VECTOR_BLOCK), kind).crossJoin(q).mapInArrow(_best(top), "query_id long, vec_id long, sim double")  # blocks, not rows
    return s.withColumn("rk", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "vec_id")).cast("long")).where(F.col("rk") <= top)


#: Constant of reciprocal ranks, and how deep each list goes.
RRF, DEEP = 60, 50
_BM_SQL = "with w as (select doc_id, list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') as w from documents), d as (select doc_id, len(w) as dl, " + ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) as t{i}" for i, t in enumerate(_QUERY_TERMS)) + " from w), k as (select count(*) as n, avg(dl) as avgdl, " + ", ".join(f"count(*) filter (t{i} > 0) as n{i}" for i in range(len(_QUERY_TERMS))) + f" from d), bm as (select doc_id, round({_BM_PART}, 6) as score from d, k where {' + '.join(f't{i}' for i in range(len(_QUERY_TERMS)))} > 0 order by score desc, doc_id limit {DEEP})"


@query("hybrid_topk", f"{_BM_SQL}, br as (select doc_id, row_number() over (order by score desc, doc_id) as rk from bm), q as (select embedding as q, vec_id as qid from embeddings where vec_id = (select vec_id from embeddings join br on vec_id = doc_id order by rk limit 1)), ds as (select vec_id as doc_id, round(list_cosine_similarity(q::double[], embedding::double[]), 6) as sim from embeddings, q where vec_id <> qid), dr as (select doc_id, row_number() over (order by sim desc, doc_id) as rk from ds qualify rk <= {DEEP}), u as (select doc_id, rk from br union all select doc_id, rk from dr) select doc_id, round(sum(1.0::double / ({RRF} + rk)), 8) as score from u group by doc_id order by score desc, doc_id limit {TOP}")
def hybrid_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Lexical and dense lists fused by reciprocal ranks; the best lexical hit that has a vector asks for its neighbours."""
    lexical = written(bm25(table(spark, sf, "documents"), _QUERY_TERMS, DEEP), "lexical")  # DEEP rows
    br = lexical.withColumn("rk", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).cast("long"))
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    asked = e.join(br, F.col("vec_id") == F.col("doc_id")).orderBy("rk").limit(1).select("vec_id", "v")
    dense = nearest(asked, e, DEEP).select(F.col("vec_id").alias("doc_id"), "rk")
    fused = br.select("doc_id", "rk").union(dense).groupBy("doc_id").agg(F.round(F.sum(1.0 / (RRF + F.col("rk"))), 8).alias("score"))
    return fused.orderBy(F.desc("score"), "doc_id").limit(TOP)


@query("dual_date", "with d as (select event_id, cast(ts as date) as published, case when event_id % 5 = 0 then cast(ts as date) - ((event_id % 11)::int) end as effective from events) select coalesce(effective, published) as d, count(*) as n, count(*) filter (effective <> published) as by_effective from d where coalesce(effective, published) between date '2024-01-05' and date '2024-01-20' group by 1")
def dual_date(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence is placed by the day on which it takes effect, where that is stated."""
    published = F.to_date("ts")
    effective = F.when(F.col("event_id") % 5 == 0, F.date_sub(published, (F.col("event_id") % 11).cast("int")))
    d = table(spark, sf, "events").select(published.alias("p"), effective.alias("e")).withColumn("d", F.coalesce("e", "p"))
    return d.where("d between date'2024-01-05' and date'2024-01-20'").groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("e") != F.col("p")).alias("by_effective"))


@query("timing_gate", "select c.event_id, count(p.event_id) as in_window, count(*) filter (p.ts > c.ts) as post_dated from (select * from events where event_type = 'signup') c left join (select * from events where event_type = 'purchase') p on p.user_id = c.user_id and cast(p.ts as date) between cast(c.ts as date) - 7 and cast(c.ts as date) + 1 group by 1")
def timing_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Causes that precede their effect within the lag, and decoys dated after it."""
    e = table(spark, sf, "events")
    c = e.where("event_type = 'signup'").select("event_id", F.col("user_id").alias("u"), F.col("ts").alias("at"))
    p = e.where("event_type = 'purchase'").select("user_id", "ts", F.lit(1).alias("one"))
    near = (F.col("user_id") == F.col("u")) & F.to_date("ts").between(F.date_sub(F.to_date("at"), 7), F.date_add(F.to_date("at"), 1))
    return c.join(p, near, "left").groupBy("event_id").agg(F.count("one").alias("in_window"), F.count_if(F.col("ts") > F.col("at")).alias("post_dated"))


@query("noisy_or", "select event_type, round(1 - exp(sum(ln(1 - least(p, 1 - 1e-9)))), 8) as p from (select event_type, user_id % 10 as cluster, max(value) / 2000 as p from events group by all) group by event_type")
def noisy_or(spark: SparkSession, sf: str) -> DataFrame:
    """Independent clusters that each may explain it: one minus the product of failing."""
    c = table(spark, sf, "events").groupBy("event_type", (F.col("user_id") % 10).alias("cluster")).agg((F.max("value") / 2000).alias("p"))
    return c.groupBy("event_type").agg(F.round(1 - F.exp(F.sum(F.log(1 - F.least(F.col("p"), F.lit(1 - 1e-9))))), 8).alias("p"))


_MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_NAMED = "|".join(_MONTHS)
_ANY_DATE = rf"[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}} (?:{_NAMED}) [0-9]{{4}}|(?:{_NAMED}) [0-9]{{1,2}}, [0-9]{{4}}|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}"


def date_in(said: Column) -> Column:
    """The day that one spelling of a date names (2024-03-05, 5 March 2024, March 5, 2024, 05/03/2024); null if there is none."""
    part = lambda pattern, k: F.nullif(F.regexp_extract(said, pattern, k), F.lit("")).cast("int")
    named = F.nullif(F.array_position(F.array(*map(F.lit, _MONTHS)), F.regexp_extract(said, f"({_NAMED})", 1)), F.lit(0)).cast("int")
    of = lambda y, m, d: F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")
    iso, slashed, spelt, turned = "^([0-9]{4})-([0-9]{2})-([0-9]{2})$", "^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$", "^([0-9]{1,2}) [A-Z][a-z]+ ([0-9]{4})$", "^[A-Z][a-z]+ ([0-9]{1,2}), ([0-9]{4})$"
    return F.when(said.rlike(iso), of(part(iso, 1), part(iso, 2), part(iso, 3))).when(said.rlike(slashed), of(part(slashed, 3), part(slashed, 2), part(slashed, 1))).when(said.rlike(spelt), of(part(spelt, 2), named, part(spelt, 1))).when(said.rlike(turned), of(part(turned, 2), named, part(turned, 1)))


def effective_date(text: Column) -> Column:
    """The day on which what a text tells takes effect: the date behind 'effective' or 'with effect from', else its first date."""
    marked = rf"(?i:effective|with effect)(?: (?:from|as of|on))? ({_ANY_DATE})"
    said = F.coalesce(F.nullif(F.regexp_extract(text, marked, 1), F.lit("")), F.nullif(F.regexp_extract(text, f"({_ANY_DATE})", 1), F.lit("")))
    return F.transform(F.array(said), date_in).getItem(0)  # found once, then read


@query("effective_dates", "select o_orderkey, o_orderdate::date as effective, o_orderkey % 5 = 4 as unmarked from orders")
def effective_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Notices that orders give rise to, in five wordings, and the dates that are read back from them."""
    day = F.to_date("o_orderdate")
    spelt = lambda f: F.date_format(day, f)
    k = F.col("o_orderkey") % 5
    said = F.when(k == 0, F.concat(F.lit("Published 2031-01-01. New prices, effective "), spelt("yyyy-MM-dd"), F.lit("."))).when(k == 1, F.concat(F.lit("2031-01-01: with effect from "), spelt("d MMMM yyyy"), F.lit(" terms change.")))
    said = said.when(k == 2, F.concat(F.lit("Rates are Effective as of "), spelt("MMMM d, yyyy"))).when(k == 3, F.concat(F.lit("seen 12/12/2031, effective on "), spelt("dd/MM/yyyy"))).otherwise(F.concat(F.lit("On "), spelt("d MMMM yyyy"), F.lit(" it was ordered, order 1998-99.")))
    read = F.transform(F.array(said), effective_date).getItem(0)
    return table(spark, sf, "orders").select("o_orderkey", read.alias("effective"), (k == 4).alias("unmarked"))


_SIGNED = r"(?:fell|down|dropped|declined|decreased)?(?: by)? ?-?[0-9]+(?:\.[0-9]+)?(?: ?(?:%|pp\b|lakh\b|crore\b))?"
_DOWN = "-|fell|down|dropped|declined|decreased"


def numbers(text: Column) -> Column:
    """The numbers of a text as (value, unit): signs and words of decrease count, lakh and crore are multiplied out."""
    value = lambda x: F.regexp_replace(x, "[^0-9.]", "").cast("double") * F.when(x.contains("crore"), 1e7).when(x.contains("lakh"), 1e5).otherwise(1.0) * F.when(x.rlike(_DOWN), -1).otherwise(1)
    unit = lambda x: F.when(x.contains("%"), "%").when(x.contains("pp"), "pp").otherwise("")
    return F.transform(F.regexp_extract_all(text, F.lit(_SIGNED), F.lit(0)), lambda x: F.struct(value(x).alias("value"), unit(x).alias("unit")))


def unmatched(told: Column, bundle: Column) -> Column:
    """Those numbers that no number of the bundle with that unit bears out, within half a percent and a rounded digit."""
    return F.filter(told, lambda x: ~F.exists(bundle, lambda b: (b["unit"] == x["unit"]) & (F.abs(b["value"] - x["value"]) <= 0.005 * F.abs(b["value"]) + 0.005)))


def numbers_sql(text: str) -> str:
    value = f"regexp_replace(x, '[^0-9.]', '', 'g')::double * case when contains(x, 'crore') then 1e7 when contains(x, 'lakh') then 1e5 else 1 end * case when regexp_matches(x, '{_DOWN}') then -1 else 1 end"
    return f"list_transform(regexp_extract_all({text}, '{_SIGNED}'), lambda x: {{'value': {value}, 'unit': case when contains(x, '%') then '%' when contains(x, 'pp') then 'pp' else '' end}})"


def unmatched_sql(told: str, bundle: str) -> str:
    return f"list_filter({told}, lambda x: len(list_filter({bundle}, lambda b: b.unit = x.unit and abs(b.value - x.value) <= 0.005 * abs(b.value) + 0.005)) = 0)"


#: Drafts of a narrator in the order of its tries, and the numbers that hold.
_CLAIMS = [
    (1, ["Revenue fell 12.4% to 60.8"], [(-12.4, "%"), (60.8, ""), (69.4, "")]),
    (2, ["Spend of ₹4.5 lakh rose 3 %", "Spend of ₹4.5 lakh rose 3 pp"], [(450000.0, ""), (3.0, "pp")]),
    (3, ["ROAS is 2.31, up 0.4", "ROAS is 2.3, up 0.4", "ROAS rose by 0.4 to 2.9"], [(2.31, "")]),
    (4, ["A gap of 1.2 crore"], [(12000000.0, "")]),
    (5, ["No numbers here"], []),
    (6, ["Margin rose 12.4%", "Margin moved by -12.4%"], [(-12.4, "%")]),
]
TRIES = 3
_DRAFTS = "[" + ", ".join(f"coalesce(len({unmatched_sql(numbers_sql(f'said[{k + 1}]'), 'bundle')}), 0)" for k in range(TRIES)) + "]"


@query("verify_numbers", "with c as (select * from (values " + ", ".join("({}, {}, [{}]::struct(value double, unit varchar)[])".format(i, said, ", ".join(f"{{'value': {v}, 'unit': '{u}'}}" for v, u in b)) for i, said, b in _CLAIMS) + f") t(id, said, bundle)), n as (select id, len({numbers_sql('said[1]')}) as n_numbers, {_DRAFTS}[1:len(said)] as lost from c) select id, n_numbers::int as n_numbers, lost[1]::int as unmatched, coalesce(list_position(lost, 0), 0)::int as draft from n")
def verify_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Every number that is told must be in the bundle; the first draft that holds is taken, else (0) the template."""
    c = spark.createDataFrame(_CLAIMS, "id int, said array<string>, bundle array<struct<value:double,unit:string>>")
    lost = F.transform("said", lambda x: F.size(unmatched(numbers(x), F.col("bundle"))))
    return c.withColumn("lost", lost).select("id", F.size(numbers(F.get("said", F.lit(0)))).alias("n_numbers"), F.get("lost", F.lit(0)).alias("unmatched"), F.array_position("lost", 0).cast("int").alias("draft"))


#: A feed that spells products in its own way: a letter is missing, brands are in capitals, spaces are doubled.
_FEED = "substr(p_name, 1, 1) || substr(p_name, 3) || '  ' || upper(replace(p_brand, '#', '-'))"
#: Least similarity of a link, and names in one form: lower case, a space for all that is no letter or digit.
LINKED = 0.8
_PLAIN = "regexp_replace(lower({0}), '[^a-z0-9]+', ' '{1})"


def similar_names(left: DataFrame, right: DataFrame, least: float = LINKED) -> DataFrame:
    """a, b, score of all pairs of names whose edit similarity is ``least`` or more. left: a; right: b; distinct, in lower case.

    An edit changes two of a name's pairs of letters at most, so similar names share one of the rarest of these: of 2 k + 1 of
    each, where k edits are the most that its length and ``least`` allow. Names of other lengths are left out by the join.
    Names so short that their edits may change all pairs are compared by length alone: the longer one's n - 1 pairs are at most
    twice its (1 - least) n edits, so n is 1 / (2 least - 1) at most, or any where ``least`` is a half or less.
    """
    low = least - 5e-7  # scores are rounded
    pairs = lambda x: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 1, F.lit(1))), lambda i: F.substring(x, i, F.lit(2))))
    sides = left.select(F.lit(0).alias("side"), F.col("a").alias("name")).union(right.select(F.lit(1), "b"))
    each = written(sides.select("side", "name", F.length("name").alias("n"), F.explode(pairs(F.col("name"))).alias("g")), "letter-pairs")
    df = each.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    rank = F.row_number().over(Window.partitionBy("side", "name").orderBy("df", "g"))
    most = F.floor(F.col("n") / low * (1 - low) + 1e-9)  # the other name may be longer
    rare = written(each.join(df, "g").withColumn("rank", rank).where(F.col("rank") <= 2 * most + 1).select("side", "name", "n", "g"), "rare-pairs")
    one, other = (rare.where(F.col("side") == k).select("g", F.col("name").alias(x), F.col("n").alias(f"n{x}")) for k, x in enumerate("ab"))
    near = lambda a, b: F.abs(a - b) <= (1 - low) * F.greatest(a, b) + 1e-9
    met = one.join(other, "g").where(near(F.col("na"), F.col("nb"))).select("a", "b")
    short = lambda df, x: df.select(x).where(F.length(x) <= (1 / (2 * low - 1) + 1e-9 if low > 0.5 else float("inf")))
    met = met.union(short(left, "a").join(short(right, "b"), near(F.length("a"), F.length("b")))).distinct()
    score = F.round(1 - F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b"), F.lit(1)), 6)
    return met.withColumn("score", score).where(F.col("score") >= least)


@query("fuzzy_link", f"with p as (select *, {_PLAIN.format("p_name || ' ' || p_brand", ", 'g'")} as a from part), b as (select {_PLAIN.format(_FEED, ", 'g'")} as b, min(p_partkey) as other from part group by all), n as (select distinct a from p), s as (select a, other, round(1 - levenshtein(a, b)::double / greatest(length(a), length(b)), 6) as score from n, b), k as (select a, arg_max(other, (score, -other)) as linked, max(score) as score from s where score >= {LINKED} group by all) select p_partkey, linked, score, coalesce(score >= 0.9, false) as sure from p left join k using (a)")
def fuzzy_link(spark: SparkSession, sf: str) -> DataFrame:
    """The counterpart of each product in a feed that spells names in its own way, by edit distance; null where none is near.

    Distinct names are compared, not rows, and none is left out for the way it is spelt; rows join back.
    """
    p = table(spark, sf, "part").withColumn("a", F.expr(_PLAIN.format("p_name || ' ' || p_brand", "")))
    feed = written(p.groupBy(F.expr(_PLAIN.format(_FEED, "")).alias("b")).agg(F.min("p_partkey").alias("other")), "feed")
    s = similar_names(p.select("a").distinct(), feed).join(feed, "b")
    best = s.groupBy("a").agg(F.max_by("other", F.struct("score", -F.col("other"))).alias("linked"), F.max("score").alias("score"))
    return p.join(best, "a", "left").select("p_partkey", "linked", "score", F.coalesce(F.col("score") >= 0.9, F.lit(False)).alias("sure"))


@query("cite_or_drop", "with h as (select event_id, case when event_id % 3 = 0 then []::bigint[] when event_id % 3 = 1 then [event_id % 1500] else [event_id % 800, event_id % 1900] end as cited from events), k as (select event_id, unnest(cited) as doc_id from h) select event_id, count(*) as citations from k where doc_id in (select doc_id from documents) group by 1")
def cite_or_drop(spark: SparkSession, sf: str) -> DataFrame:
    """Hypotheses keep only citations of documents at hand, and go without any."""
    i = F.col("event_id")
    cited = F.when(i % 3 == 0, F.array().cast("array<bigint>")).when(i % 3 == 1, F.array(i % 1500)).otherwise(F.array(i % 800, i % 1900))
    k = table(spark, sf, "events").select("event_id", F.explode(cited).alias("doc_id"))
    return k.join(table(spark, sf, "documents").select("doc_id"), "doc_id", "left_semi").groupBy("event_id").agg(F.count(F.lit(1)).alias("citations"))


@query("case_lookup", "select p_type, p_brand, arg_max(p_partkey, (p_size, -p_partkey)) as precedent, max(p_size) as recency from part group by all")
def case_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The most recent precedent for each pair of measure and driver."""
    p = table(spark, sf, "part")
    return p.groupBy("p_type", "p_brand").agg(F.max_by("p_partkey", F.struct("p_size", -F.col("p_partkey"))).alias("precedent"), F.max("p_size").alias("recency"))
