"""Importance resampling towards a target's distribution, over a sparse matrix of documents by hashed features.

Features are the words of a text and its pairs of consecutive words, hashed into ``BUCKETS`` buckets. The matrix of
counts is written once, as blocks of compressed sparse rows: one row of the table holds the documents of about ``BLOCK``
bytes of text, with the places where each document's entries begin, the entries' buckets and their counts (both packed
as little-endian numbers of as few bytes as do: a reader holds many rows at once). Column sums
of the blocks give the corpus' distribution, those of the target's blocks the target's; both together give each bucket
a gain, and the product of the matrix with the gains gives each document's weight. Texts are read once.

Sums of a partition leave it as one row a bucket and are added up by Spark; the gains, one number a bucket, are all that
reaches the driver. A keyed draw is added to the weight (Gumbel's trick: the highest sums are a sample without repeats
whose chances follow the weights). Ranks come from one sort of rows without texts, and the counts of its partitions.

Defined cases: a null text equals an empty one and has no features, the weight 0 and no rank; a very long text is one
row of the matrix, which has at most ``BUCKETS`` entries; equal scores rank by ascending id, null ids last, and repeated
rows are ranked one by one (``resample`` draws rows that are equal in id and text together); with an empty target all
gains follow from the corpus alone; an empty table gives an empty result; extra columns are kept by ``resample``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm import tokens
from tidemark.llm.common import boxed, materialize, table, unboxed

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: Bytes of text whose rows make a block of the matrix; one text may be longer.
BLOCK = 1 << 19
#: Words of more bytes are hashed one by one.
LONG = 64
_BLOCK_FIELDS = "n_words array<long>, begins array<long>, buckets binary, counts binary"


def _crc_table() -> np.ndarray:
    """The remainders of all bytes under the reflected polynomial of CRC-32."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(0xEDB88320), x >> 1)
    return x


_CRC = _crc_table()


def crc_after(crc: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of what has the CRC-32 ``crc`` with data[start:end] behind it, for many words, one byte of all at a time."""
    length = end - start
    order = np.argsort(np.minimum(length, LONG + 1).astype(np.uint8), kind="stable")[::-1]
    state, at, size = ~crc[order], start[order], length[order]
    n_long = int((size > LONG).sum())
    for i in range(n_long):
        state[i] = ~np.uint32(zlib.crc32(data[at[i] : at[i] + size[i]].tobytes(), int(~state[i])))
    left = len(order) - np.cumsum(np.bincount(np.minimum(size, LONG + 1), minlength=LONG + 2))  # words of more than j bytes
    for j in range(LONG):
        n = int(left[j])
        if n <= n_long:
            break
        s = state[n_long:n]
        state[n_long:n] = _CRC[(s ^ data[at[n_long:n] + j]) & np.uint32(255)] ^ (s >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = ~state
    return out


def feature_buckets(w: tokens.Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The text and the bucket of each feature."""
    n = len(w.start)
    one = crc_after(np.zeros(n, dtype=np.uint32), w.data, w.start, w.end)
    pair = np.flatnonzero(w.inside(2))
    spaced = ~one[pair]
    spaced = ~(_CRC[(spaced ^ np.uint32(0x20)) & np.uint32(255)] ^ (spaced >> np.uint32(8)))
    two = crc_after(spaced, w.data, w.start[pair + 1], w.end[pair + 1])
    of = w.of
    return np.r_[of, of[pair]].astype(np.int64), np.r_[one, two].astype(np.int64) % buckets


def _packed(values: np.ndarray) -> bytes:
    return values.astype(np.min_scalar_type(int(values.max(initial=0))).newbyteorder("<")).tobytes()


def _blocks(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.chunks(batches, "text", BLOCK):
            w = tokens.split(batch.column("text"), tokens.ALPHANUMERIC, tokens.LOWER)
            text, bucket = feature_buckets(w, buckets)
            cell, counts = np.unique(text * buckets + bucket, return_counts=True)
            begins = np.searchsorted(cell, np.arange(batch.num_rows + 1) * buckets)
            names = [c for c in batch.schema.names if c != "text"]
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            lists = [one(x) for x in (*(batch.column(c) for c in names), pa.array(w.counts, pa.int64()), pa.array(begins, pa.int64()))]
            packed = [pa.array([_packed(x)], pa.binary()) for x in (cell % buckets, counts)]
            yield pa.RecordBatch.from_arrays([*lists, *packed], [*names, "n_words", "begins", "buckets", "counts"])

    return run


def count_matrix(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The written blocks: for each column of docs but text an array with the value of each document, and the sparse rows.

    docs: text and any others, whose names aren't n_words, begins, buckets or counts.
    """
    keys = [T.StructField(f.name, T.ArrayType(f.dataType)) for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType([*keys, *T._parse_datatype_string(_BLOCK_FIELDS).fields])
    return materialize(docs.mapInArrow(_blocks(buckets), schema), "count-matrix")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each block its row, begins, buckets and counts."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            begins = row.column("begins").flatten().to_numpy()
            entries = [row.column(c)[0].as_py() for c in ("buckets", "counts")]
            n = max(int(begins[-1]), 1)
            yield row, begins, *(np.frombuffer(x, dtype=f"<u{len(x) // n or 1}").astype(np.int64) for x in entries)


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: the features of each bucket that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for _, _, bucket, counts in _rows(batches):
            np.add.at(total, bucket, counts)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there])], ["bucket", "n"])

    return matrix.select("begins", "buckets", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain: a thousandfold log ratio of smoothed shares, for all buckets. corpus, target: as of ``column_sums``."""
    spark = corpus.sparkSession
    all_s, all_t = (x.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for x in (corpus, target))
    every = spark.range(buckets).withColumnRenamed("id", "bucket")
    both = every.join(corpus.select("bucket", F.col("n").alias("s")), "bucket", "left").join(target.select("bucket", F.col("n").alias("t")), "bucket", "left").fillna(0)
    part = lambda n, other: (F.col(n) + F.lit(1)).cast("double") * F.lit(float(other + buckets))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(part("t", all_s) / part("s", all_t))).alias("gain"))


def weigh(matrix: DataFrame, gain: np.ndarray) -> DataFrame:
    """The matrix' own columns, n_words, n_features and weight (the mean gain of a document's features, floored), a row a document."""
    keys = [f for f in matrix.schema.fields if f.name not in ("n_words", "begins", "buckets", "counts")]
    schema = T.StructType([*(T.StructField(f.name, f.dataType.elementType) for f in keys), *T._parse_datatype_string("n_words long, n_features long, weight long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, begins, bucket, counts in _rows(batches):
            sums = np.r_[0, np.cumsum(gain[bucket] * counts)]
            sizes = np.r_[0, np.cumsum(counts)]
            n = sizes[begins[1:]] - sizes[begins[:-1]]
            mean = (sums[begins[1:]] - sums[begins[:-1]]) // np.maximum(n, 1)
            made = [block.column("n_words").flatten(), pa.array(n), pa.array(mean)]
            yield pa.RecordBatch.from_arrays([*(block.column(f.name).flatten() for f in keys), *made], schema.fieldNames())

    return matrix.mapInArrow(run, schema)


def _draw(ident: Column, seed: int) -> Column:
    """A thousandfold Gumbel variate that depends on the id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def importance_scores(docs: DataFrame, target: DataFrame, percent: int = PERCENT, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """docs' columns but text, and n_features, weight, score, rank (null where not drawn).

    docs: doc_id, text and any others; target: text. Of the documents with ``least_words`` words, ``percent`` in a hundred are drawn.
    """
    matrix = count_matrix(docs, buckets)
    corpus = materialize(column_sums(matrix, buckets), "column-sums")
    aim = column_sums(count_matrix(target.select(F.col("text").cast("string").alias("text")), buckets), buckets)
    known = gains(corpus, materialize(aim, "column-sums"), buckets).toPandas()  # a row a bucket
    gain = np.zeros(buckets, dtype=np.int64)
    gain[known["bucket"].to_numpy()] = known["gain"].to_numpy()
    scored = weigh(matrix, gain).withColumn("score", F.col("weight") + _draw(F.col("doc_id"), seed))
    scored = materialize(scored.withColumn("__fit", F.col("n_words") >= least_words).withColumn("__row", F.monotonically_increasing_id()), "scored")
    # one order of all rows, numbered within its partitions; equal rows may be parted, as they are numbered
    order = [F.desc("__fit"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("__row")]
    ranked = materialize(scored.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.call_function("shiftright", "__at", F.lit(33))
    sizes = ranked.where("__fit").groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))  # a row a partition
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    most = ranked.where("__fit").count() * percent // 100
    rank = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    out = ranked.withColumn("__part", part).join(before, "__part", "left").withColumn("rank", F.when(F.col("__fit") & (rank <= most), rank))
    return out.drop("__fit", "__row", "__at", "__part", "__before", "n_words")


def resample(df: DataFrame, target: DataFrame, percent: int = PERCENT, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The drawn rows of ``df`` with their own columns, texts included."""
    own = df.select(F.col(f"`{ident}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("t"), F.col(f"`{text}`").cast("string").alias("text"))
    drawn = importance_scores(own, target, percent).where("rank is not null").select(F.col("doc_id").alias("__i"), F.col("t").alias("__t")).distinct()
    row = boxed(df)
    same = F.col(f"__row.`{ident}`").eqNullSafe(F.col("__i")) & (F.xxhash64(F.col(f"__row.`{text}`").cast("string")) == F.col("__t"))
    return unboxed(row.join(materialize(drawn, "drawn"), same, "left_semi"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


QUERIES = {"op11_importance_resampling": op11_importance_resampling}
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_ORACLE = f"""
with w as materialized (select 0 as side, doc_id, {_WORDS} as w from documents union all select 1, item_id, {_WORDS} from benchmark),
e as (select side, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) as feature from w),
c as materialized (select side, doc_id, feature, count(*) as n from e group by all),
tab as materialized (select list(x order by i) as tab from (select i, list_reduce(list_prepend(i, range(8)), lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as x from range(256) r(i))),
h as materialized (select feature, hex(encode(feature)) as hex from (select distinct feature from c)),
k as materialized (select feature, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(hex), 2), lambda j: ('0x' || hex[j:j + 1])::bigint)), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]))) % {BUCKETS} as bucket from h, tab),
m as materialized (select side, doc_id, bucket, sum(n)::bigint as n from c join k using (feature) group by all),
q as (select bucket, coalesce(sum(n) filter (where side = 0), 0) as s, coalesce(sum(n) filter (where side = 1), 0) as t from m group by bucket),
z as (select coalesce(sum(s), 0)::double as all_s, coalesce(sum(t), 0)::double as all_t from q),
g as (select bucket, floor(1000 * ln(((t + 1)::double * (all_s + {BUCKETS})) / ((s + 1)::double * (all_t + {BUCKETS}))))::bigint as gain from q, z),
v as (select doc_id, sum(n)::bigint as n_features, sum(n * gain)::bigint as total from m join g using (bucket) where side = 0 group by doc_id),
p as (select w.doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, case when n_features > 0 then floor(total::double / n_features)::bigint else 0 end as weight, ('0x' || sha256('{SEED}:' || w.doc_id)[1:8])::bigint as u from w left join v on w.doc_id = v.doc_id where side = 0),
o as (select *, weight + floor(-1000 * ln(-ln((u + 0.5::double) / 4294967296)))::bigint as score from p),
r as (select *, row_number() over (partition by n_words >= {LEAST_WORDS} order by score desc, doc_id) as rn, count(*) filter (where n_words >= {LEAST_WORDS}) over () as n from o)
select doc_id, n_features::bigint as n_features, weight, score, case when n_words >= {LEAST_WORDS} and rn <= {PERCENT} * n // 100 then rn::bigint end as rank from r
"""
ORACLES = {"op11_importance_resampling": _ORACLE}
