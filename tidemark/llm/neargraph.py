"""Near copies among vectors: searches in a robust-pruned flat graph that is built on overlapping cluster shards.

Equal vectors are one class from the start. Centroids, fitted on a bounded sample and thinned so that a tight group has
one nearest centroid, make shards; each class goes to its ``OVERLAP`` nearest ones. A shard of more than ``HOLDS``
classes is cut into blocks by hash, so no task holds more than two blocks. In each block every class gets its nearest
others and some far ones as candidates, of which robust pruning keeps those that no kept one stands for, ``DEGREE`` at
most; links go both ways, and what the medoid can't reach is tied to its nearest neighbour that can be reached. The lists
of a class from all its shards are then united.

For the search each pair of blocks of a shard is a unit of work. All classes of the one block walk the other's graph at
once: a greedy search with a beam of ``BEAM`` from the medoid, then every class found within the range, and a little
beyond it, is expanded until no more are found. Pairs are verified in double precision. A unit gives a row a class, with
the number of rows that it links to and its root in the unit; of a pair that shares several shards only the least one
counts the link, so pairs never leave their task. Connected components join the roots.

``audit`` compares the links of a bounded sample with brute force over all classes. Below ``RECALL`` the work is done
again with twice the overlap.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
unlike lengths don't link; ties have no effect, as all links are found; repeated rows are vectors of their own and link
with each other; null ids take the least id that their vectors reach; extra columns aren't read; an empty table gives an
empty result.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import materialize, table
from tidemark.llm.graphs import components

COSINE, OVERLAP, HOLDS = 0.95, 3, 1536
#: Classes of a shard on average, centroids at most, and their least angle to each other as a cosine.
PER_SHARD, CENTROIDS, APART = 512, 8192, 0.8
#: Vectors and bytes of the sample that the centroids are fitted on, at most, and rounds of fitting.
SAMPLE, SAMPLE_BYTES, ROUNDS = 32_768, 64 << 20, 8
#: Links of a class in a block at most, nearest and far candidates for them, and by how much a kept one must be nearer.
DEGREE, NEAREST, FAR, ALPHA = 24, 48, 16, 1.2
#: Width of the greedy search, how far below the range a class is still expanded, and pairs that are looked at together.
BEAM, SLACK, FRONT = 24, 0.08, 1 << 15
#: Classes that the audit compares with all others, and the recall that it asks for.
AUDIT, RECALL, TRIES = 256, 0.98, 3
_log = logging.getLogger(__name__)


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit_centroids(sample: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    """At most ``k`` unit vectors, none nearer to another than ``APART``."""
    x = unit(sample).astype(np.float32)
    centroids = x[np.random.default_rng(seed).permutation(len(x))[:k]]
    for _ in range(ROUNDS):
        of = np.concatenate([(x[i : i + 4096] @ centroids.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, x)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centroids = np.where(norm > 1e-6, sums / np.maximum(norm, 1e-6), centroids)
    near = centroids @ centroids.T >= APART
    keep = np.zeros(len(centroids), dtype=bool)
    for i in range(len(centroids)):
        keep[i] = not (near[i] & keep).any()
    return centroids[keep]


def _assign(centroids: dict[int, np.ndarray], overlap: int):
    """Adds ``shards``, ascending: the nearest centroids of each vector; of a length that the sample lacks there is one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                c = centroids.get(int(dim))
                if c is None or len(c) <= overlap:
                    near = np.zeros((part.num_rows, 1), dtype=np.int32) if c is None else np.tile(np.arange(len(c), dtype=np.int32), (part.num_rows, 1))
                else:
                    x = unit(_matrix(part.column("embedding"))).astype(np.float32)
                    near = np.sort(np.argpartition(-(x @ c.T), overlap - 1, axis=1)[:, :overlap], axis=1).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1) * near.shape[1], pa.int32()), pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*batch.schema.names, "shards"])

    return run


def robust_prune(x: np.ndarray, rows: np.ndarray, candidates: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """For each of ``rows`` of x those of its ``candidates`` (nearest first, -1: none) that are kept, -1 behind them.

    The nearest is kept, and drops all others that it is nearer to, by the factor ``alpha``, than the row itself is.
    """
    distance = lambda one: np.sqrt(np.maximum(2 - 2 * np.einsum("nd,nkd->nk", one, x[candidates]), 0))
    to, alive = distance(x[rows]), candidates >= 0
    out = np.full((len(rows), degree), -1, dtype=np.int64)
    every = np.arange(len(rows))
    for r in range(degree):
        first = alive.argmax(axis=1)
        has = alive[every, first]
        if not has.any():
            break
        chosen = candidates[every, first]
        out[has, r] = chosen[has]
        alive &= ~(has[:, None] & (alpha * distance(x[chosen]) <= to))
        alive[every, first] = False
    return out


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(axis=0)).argmax())


def build_graph(x: np.ndarray, seed: int = 3) -> list[np.ndarray]:
    """Neighbours of each row of ``x`` (unit vectors): a graph in which the medoid reaches all."""
    n = len(x)
    if n == 1:
        return [np.zeros(0, dtype=np.int64)]
    nearest = min(NEAREST, n - 1)
    near = np.empty((n, nearest), dtype=np.int64)
    for i in range(0, n, 512):
        sims = x[i : i + 512] @ x.T
        sims[np.arange(len(sims)), np.arange(i, i + len(sims))] = -2
        best = np.argpartition(-sims, nearest - 1, axis=1)[:, :nearest]
        near[i : i + 512] = np.take_along_axis(best, np.argsort(-np.take_along_axis(sims, best, 1), axis=1, kind="stable"), 1)
    far = np.random.default_rng(seed).integers(0, n, (n, FAR))
    far[far == np.arange(n)[:, None]] = -1
    candidates = np.concatenate([near, far], axis=1)
    kept = np.concatenate([robust_prune(x, np.arange(i, min(i + 256, n)), candidates[i : i + 256]) for i in range(0, n, 256)])
    one, at = np.nonzero(kept >= 0)
    other = kept[one, at]
    pairs = np.unique(np.r_[one * n + other, other * n + one])
    lists = np.split(pairs % n, np.searchsorted(pairs // n, np.arange(1, n)))
    start = medoid(x)
    while True:  # what can't be reached is tied to its nearest neighbour that can
        seen = np.zeros(n, dtype=bool)
        seen[start] = True
        front = np.array([start])
        while len(front):
            front = np.unique(np.concatenate([lists[i] for i in front]))
            front = front[~seen[front]]
            seen[front] = True
        if seen.all():
            return lists
        a, reached = int(np.argmin(seen)), np.flatnonzero(seen)
        b = int(reached[(x[reached] @ x[a]).argmax()])
        lists[a], lists[b] = np.r_[lists[a], b], np.r_[lists[b], a]


def search_graph(queries: np.ndarray, x: np.ndarray, lists: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Query and row of ``x`` of each pair found with a product of ``least`` or more; all are unit vectors."""
    nq, n = len(queries), len(x)
    degree = max(1, max(map(len, lists)))
    near = np.full((n, degree), -1, dtype=np.int64)
    for i, row in enumerate(lists):
        near[i, : len(row)] = row
    seen, open_ = np.zeros((nq, n), dtype=bool), np.zeros((nq, n), dtype=bool)  # open: in the range and not expanded
    found: list[np.ndarray] = []
    start = medoid(x)

    def look(q: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Products of new pairs; notes those in the range."""
        seen[q, t] = True
        sims = np.einsum("nd,nd->n", queries[q], x[t])
        inside = sims >= least - SLACK
        open_[q[inside], t[inside]] = True
        hit = sims >= least - 1e-4
        found.append(q[hit] * n + t[hit])
        return sims

    beam = np.full((nq, BEAM), -1, dtype=np.int64)
    value = np.full((nq, BEAM), -2.0, dtype=x.dtype)
    done = np.zeros((nq, BEAM), dtype=bool)
    every = np.arange(nq)
    beam[:, 0], value[:, 0] = start, look(every, np.full(nq, start))
    active = every
    while len(active):
        best = np.where(done[active] | (beam[active] < 0), -3.0, value[active]).argmax(axis=1)
        live = ~done[active, best] & (beam[active, best] >= 0)
        active, best = active[live], best[live]
        done[active, best] = True
        open_[active, beam[active, best]] = False
        step = max(1, FRONT // degree)
        for k in range(0, len(active), step):
            a = active[k : k + step]
            targets = near[beam[a, best[k : k + step]]]
            fresh = (targets >= 0) & ~seen[a[:, None], targets]
            r, c = np.nonzero(fresh)
            sims = np.full(targets.shape, -2.0, dtype=x.dtype)
            sims[r, c] = look(a[r], targets[r, c])
            ids, values = np.concatenate([beam[a], np.where(fresh, targets, -1)], axis=1), np.concatenate([value[a], sims], axis=1)
            flags = np.concatenate([done[a], np.zeros(targets.shape, dtype=bool)], axis=1)
            top = np.argsort(-values, axis=1, kind="stable")[:, :BEAM]
            beam[a], value[a], done[a] = (np.take_along_axis(v, top, 1) for v in (ids, values, flags))
    while open_.any():
        q, t = np.nonzero(open_)
        open_[q, t] = False
        step = max(1, FRONT // degree)
        for k in range(0, len(q), step):
            targets = near[t[k : k + step]]
            r, c = np.nonzero(targets >= 0)
            pair = np.unique(q[k : k + step][r] * n + targets[r, c])
            pair = pair[~seen.ravel()[pair]]
            look(pair // n, pair % n)
    pairs = np.concatenate(found)
    return pairs // n, pairs % n


def _built(key: tuple, members: pa.Table) -> pa.Table:
    x = unit(_matrix(members.column("embedding"))).astype(np.float32)
    cid = members.column("cid").to_numpy()
    lists = build_graph(x)
    first = np.r_[0, np.cumsum([len(v) for v in lists])]
    near = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(cid[np.concatenate(lists)], pa.int64()))
    return pa.table({"cid": cid, "near": near})


def _local(cid: np.ndarray, near: pa.ChunkedArray) -> list[np.ndarray]:
    """Neighbour lists by row, of the neighbours that have a row."""
    order = np.argsort(cid)
    lists = near.combine_chunks()
    of = np.repeat(np.arange(len(cid)), lists.value_lengths().to_numpy(zero_copy_only=False))
    other = lists.flatten().to_numpy()
    at = np.minimum(np.searchsorted(cid[order], other), len(cid) - 1)
    there = cid[order][at] == other
    return np.split(order[at[there]], np.searchsorted(of[there], np.arange(1, len(cid))))


def _first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that stands in both rows."""
    same = (a[:, :, None] == b[:, None, :]).any(axis=2)
    return np.where(same, a, np.iinfo(np.int32).max).min(axis=1)


def _searched(cosine: float):
    def run(key: tuple, members: pa.Table) -> pa.Table:
        shard, i, j = (int(k.as_py()) for k in key[1:])
        block = members.column("block").to_numpy()
        exact = unit(_matrix(members.column("embedding")))
        x = exact.astype(np.float32)
        cid, weight = members.column("cid").to_numpy(), members.column("n").to_numpy()
        ours, theirs = np.flatnonzero(block == i), np.flatnonzero(block == j)
        rows = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        if len(ours) and len(theirs):
            near = members.column("near").combine_chunks().take(pa.array(theirs))
            q, t = search_graph(x[ours], x[theirs], _local(cid[theirs], pa.chunked_array([near])), cosine)
            rows = ours[q], theirs[t]
        a, b = np.minimum(*rows), np.maximum(*rows)
        pair = np.unique((a * len(cid) + b)[a != b])
        a, b = pair // len(cid), pair % len(cid)
        true = np.zeros(len(a), dtype=bool)
        for k in range(0, len(a), FRONT):
            true[k : k + FRONT] = np.einsum("nd,nd->n", exact[a[k : k + FRONT]], exact[b[k : k + FRONT]]) >= cosine
        a, b = a[true], b[true]
        root = np.arange(len(cid))[np.argsort(np.argsort(cid))]  # numbers in the order of the ids
        by_rank = cid[np.argsort(cid)]
        while True:
            low = np.minimum(root[a], root[b])
            then = root.copy()
            np.minimum.at(then, a, low)
            np.minimum.at(then, b, low)
            if (then == root).all():
                break
            root = then
        shards = _matrix(members.column("shards"))
        own = _first_common(shards[a], shards[b]) == shard
        links = np.zeros(len(cid), dtype=np.int64)
        np.add.at(links, a[own], weight[b[own]])
        np.add.at(links, b[own], weight[a[own]])
        linked = np.unique(np.r_[a, b])
        return pa.table({"cid": cid[linked], "links": links[linked], "root": by_rank[root[linked]]})

    return run


def _vectors(df: DataFrame) -> DataFrame:
    """vec_id, embedding, valid, t1, t2: with hashes that tell vectors apart."""
    if df.schema["embedding"].dataType.elementType != T.FloatType():
        df = df.withColumn("embedding", F.col("embedding").cast("array<double>"))
    e = F.col("embedding")
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    valid = e.isNotNull() & (F.size(e) > 0) & ~F.exists(e, bad) & F.exists(e, lambda v: v != 0)
    rows = df.select("vec_id", "embedding", F.coalesce(valid, F.lit(False)).alias("valid"))
    return rows.select("*", F.xxhash64("embedding").alias("t1"), F.xxhash64(F.lit(1), "embedding").alias("t2"))


def _centroids(classes: DataFrame, n: int, overlap: int) -> dict[int, np.ndarray]:
    widest = classes.agg(F.max("dim")).first()[0] or 1
    taken = classes.orderBy("t1", "t2").limit(max(1, min(SAMPLE, SAMPLE_BYTES // (8 * widest)))).select("dim", "embedding").toPandas()  # bounded
    out = {}
    for dim, part in taken.groupby("dim"):
        share = n * len(part) / max(1, len(taken))
        k = int(min(CENTROIDS, -(-share * overlap // PER_SHARD), max(1, len(part) // 4)))
        if k > 1:
            out[int(dim)] = fit_centroids(np.stack(part["embedding"].to_list()), k)
    return out


def _found(classes: DataFrame, centroids: dict[int, np.ndarray], cosine: float, overlap: int) -> DataFrame:
    """cid, links, root: a row for each class of each unit of work that has a link there."""
    members = classes.select("cid", "n", "dim", "embedding")
    schema = T.StructType([*members.schema.fields, T.StructField("shards", T.ArrayType(T.IntegerType()))])
    placed = materialize(members.mapInArrow(_assign(centroids, overlap), schema), "shards")
    each = placed.withColumn("shard", F.explode("shards"))
    sizes = materialize(each.groupBy("dim", "shard").agg(F.ceil(F.count(F.lit(1)) / HOLDS).cast("int").alias("blocks")), "shard-sizes")
    each = each.join(sizes, ["dim", "shard"]).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    built = each.select("dim", "shard", "block", "cid", "embedding").groupBy("dim", "shard", "block").applyInArrow(_built, "cid long, near array<long>")
    united = materialize(built.groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "adjacency")  # a list a shard
    whole = each.join(united, "cid").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = whole.withColumn("i", F.least("block", "with")).withColumn("j", F.greatest("block", "with")).drop("with", "blocks")
    return materialize(units.groupBy("dim", "shard", "i", "j").applyInArrow(_searched(cosine), "cid long, links long, root long"), "found")


def brute_links(classes: DataFrame, asked: DataFrame, cosine: float) -> DataFrame:
    """cid, links of the classes ``asked``, a bounded number, compared with all classes."""
    rows = asked.select("cid", "dim", "embedding").toPandas()
    known = {int(d): (p["cid"].to_numpy(), unit(np.stack(p["embedding"].to_list()))) for d, p in rows.groupby("dim")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                if int(dim) in known:
                    part = batch.filter(pa.array(dims == dim))
                    cid, x = known[int(dim)]
                    near = (unit(_matrix(part.column("embedding"))) @ x.T >= cosine) & (part.column("cid").to_numpy()[:, None] != cid)
                    yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(near.T @ part.column("n").to_numpy())], ["cid", "links"])

    return classes.select("cid", "n", "dim", "embedding").mapInArrow(run, "cid long, links long").groupBy("cid").agg(F.sum("links").alias("links"))


def audit(classes: DataFrame, found: DataFrame, cosine: float) -> float:
    """The share of the links of ``AUDIT`` classes that were found."""
    asked = materialize(classes.orderBy(F.xxhash64("t1"), "t2").limit(AUDIT), "audited")
    own = found.join(asked.select("cid"), "cid").groupBy("cid").agg(F.sum("links").alias("own"))
    x = brute_links(classes, asked, cosine).join(own, "cid", "left").agg(F.sum("links"), F.sum(F.least("links", "own"))).first()
    return (x[1] or 0) / x[0] if x[0] else 1.0


def near_vectors(df: DataFrame, cosine: float = COSINE, overlap: int = OVERLAP) -> DataFrame:
    """vec_id, n_links, component_id for each row of ``df`` (vec_id, embedding)."""
    rows = materialize(_vectors(df.select("vec_id", "embedding")), "vectors")
    classes = rows.where("valid").groupBy("t1", "t2").agg(F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
    classes = materialize(classes.select("*", F.size("embedding").alias("dim"), F.monotonically_increasing_id().alias("cid")), "vector-classes")
    n = classes.count()
    for attempt in range(TRIES):
        wide = overlap << attempt
        found = _found(classes, _centroids(classes, n, wide), cosine, wide)
        recall = audit(classes, found, cosine)
        if recall >= RECALL:
            break
        _log.warning("recall of the audit with overlap %d: %.4f", wide, recall)
    roots = components(found.select(F.col("cid").alias("u"), F.col("root").alias("v")))
    named = classes.select("cid", "t1", "t2", "n", "least").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    named = materialize(named.join(found.groupBy("cid").agg(F.sum("links").alias("links")), "cid", "left"), "named")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(named.join(ids, "root").select("t1", "t2", "component_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "named")
    linked = rows.where("valid").select("vec_id", "t1", "t2").join(named, ["t1", "t2"]).select("vec_id", "n_links", "component_id")
    return linked.union(rows.where("not valid").select("vec_id", F.lit(0).cast("long"), "vec_id"))


def op12_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


QUERIES = {"op12_vector_graph": op12_vector_graph}
_ORACLE = f"""
with recursive v as materialized (select row_number() over () as row, vec_id, embedding::double[] as e from embeddings),
u as materialized (select row, vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as norm from v where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
l as materialized (select a.row as a, b.row as b from u a join u b on a.row <> b.row and len(a.e) = len(b.e) where list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {COSINE}),
r as (select row, row as at from u union select r.row, l.b from r join l on r.at = l.a),
m as (select r.row, min(v.vec_id) as component_id from r join v on r.at = v.row group by r.row),
n as (select a as row, count(*) as n_links from l group by a)
select v.vec_id, coalesce(n_links, 0)::bigint as n_links, coalesce(component_id, v.vec_id) as component_id, v.vec_id is not distinct from coalesce(component_id, v.vec_id) as kept
from v left join m using (row) left join n using (row)
"""
ORACLES = {"op12_vector_graph": _ORACLE}
