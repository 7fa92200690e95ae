"""A convolutional text classifier in numpy: hashed word embeddings, three filter widths, max pooling.

A word's vector is the sum of three embeddings, found by the hash of the word and of its first four and six bytes.
Filters of one, two and three words slide over the whole text; the largest answer of each feeds a logistic unit.
It is trained on a bounded sample of labelled documents outside the held-out fold, in a seeded order, so reruns
agree. Part of the sample is kept aside to scale scores, so that 0.5 divides the classes, and to set a threshold
for each language, which doesn't enter the score.

Defined cases: a null text is empty; a very long text is scored whole, as a batch by itself; of the training sample
those are left out with which its texts, in the order of the hash of their ids, would exceed ``SAMPLE_BYTES``; a score
of exactly 0.5 is toxic; the result has its own columns alone, so none clash; a text without words gets the score of the empty text; if the sample lacks a
class, all scores are 0; labels that are null are ignored, of several labels of a document the highest counts;
repeated rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import tokens
from tidemark.llm.common import table

#: Most labelled documents of each class that are trained on: toxic, others; and most bytes of their texts in all.
SAMPLE = (2000, 4000)
SAMPLE_BYTES = 64 << 20
FOLDS = 5
DIM, FILTERS, WIDTHS = 16, 12, (1, 2, 3)
#: Rows of the embeddings of words, and of beginnings of four and of six bytes; powers of two.
ROWS = (1 << 16, 1 << 14, 1 << 15)
BEGINNINGS = (4, 6)
#: Passes over the sample: as many as make VISITS documents, within bounds.
VISITS, EPOCHS = 48000, (8, 20)
STEP, BATCH, DROP = 0.02, 16, 0.5
#: Each so-many-th document of the sample sets scale and thresholds.
ASIDE = 5
#: Toxic documents of a language that are needed for a threshold of its own.
ENOUGH = 10


def word_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each word of all texts its rows of the three embeddings, and where each text's words begin, with the end."""
    w = tokens.split(texts, tokens.ALPHANUMERIC, tokens.LOWER)
    if not len(w.start):
        return np.zeros((0, 3), dtype=np.int32), w.first
    out = np.empty((len(w.start), 3), dtype=np.int32)
    out[:, 0] = w.hash & np.uint64(ROWS[0] - 1)
    length = w.end - w.start
    code = np.zeros(len(w.start), dtype=np.uint64)
    for k in range(max(BEGINNINGS)):
        at = np.minimum(w.start + k, len(w.data) - 1)
        code = code * np.uint64(257) + np.where(k < length, w.data[at].astype(np.uint64) + np.uint64(1), np.uint64(0))
        if k + 1 in BEGINNINGS:
            i = BEGINNINGS.index(k + 1) + 1
            out[:, i] = tokens.scramble(code + np.uint64(i)) & np.uint64(ROWS[i] - 1)
    return out, w.first


@dataclass
class Model:
    embeddings: list[np.ndarray]
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str | None, float] = field(default_factory=dict)
    trained: bool = True

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Model:
        f32 = lambda a: a.astype(np.float32)
        return cls(
            [f32(rng.normal(0, 0.1, (r, DIM))) for r in ROWS],
            [f32(rng.normal(0, (w * DIM) ** -0.5, (w * DIM, FILTERS))) for w in WIDTHS],
            np.zeros(FILTERS * len(WIDTHS), dtype=np.float32),
            f32(rng.normal(0, 0.3, FILTERS * len(WIDTHS))),
            -1.0,
        )

    def vectors(self, rows: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
        whole = self.embeddings[0][rows[:, 0]]
        if keep is not None:
            whole = whole * keep[:, None]
        return whole + self.embeddings[1][rows[:, 1]] + self.embeddings[2][rows[:, 2]]

    def logits(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        """One for each text, all texts at once."""
        counts = np.diff(first)
        pooled = np.zeros((len(counts), FILTERS * len(WIDTHS)), dtype=np.float32)
        there = np.flatnonzero(counts)
        if len(there):
            x = self.vectors(rows)
            of = np.repeat(np.arange(len(counts)), counts)
            begins = first[:-1][there]
            for k, w in enumerate(WIDTHS):
                y = x @ self.filters[k][:DIM]
                for j in range(1, w):  # a window that leaves its text sees zeros there
                    part = x[j:] @ self.filters[k][j * DIM : (j + 1) * DIM]
                    part[of[j:] != of[:-j]] = 0
                    y[:-j] += part
                pooled[there, k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(y, begins, axis=0)
            pooled[there] = np.maximum(pooled[there] + self.bias, 0)
        return pooled @ self.out + self.out_bias

    def scores(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.zeros(len(first) - 1)
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * self.logits(rows, first).astype(np.float64) + self.scale[1], -60, 60)))


class _Adam:
    def __init__(self, like: np.ndarray) -> None:
        self.m, self.v, self.t = np.zeros_like(like), np.zeros_like(like), 0

    def step(self, value: np.ndarray, grad: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (grad - self.m)
        self.v += 0.001 * (grad * grad - self.v)
        value -= STEP * 0.3 * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def train(docs: list[np.ndarray], toxic: np.ndarray, langs: list[str | None], seed: int = 7) -> Model:
    """docs: word rows of each text. Gradients reach only the windows that pooling chose."""
    rng = np.random.default_rng(seed)
    model = Model.fresh(rng)
    aside = np.arange(len(docs)) % ASIDE == 0
    if len(set(toxic[aside].tolist())) < 2:
        aside[:] = False  # too few to keep any aside
    chosen = np.flatnonzero(~aside)
    if not len(chosen) or len(set(toxic[chosen].tolist())) < 2:
        model.trained = False
        return model
    weight = 0.5 * len(chosen) / max(1, toxic[chosen].sum())
    weights = np.where(toxic == 1, min(weight, 4.0), 1.0)
    adams = [_Adam(a) for a in (*model.filters, model.bias, model.out, np.zeros(1, dtype=np.float32))]
    squares = [np.full(r, 1e-3, dtype=np.float32) for r in ROWS]
    for _ in range(min(EPOCHS[1], max(EPOCHS[0], VISITS // len(chosen)))):
        order = rng.permutation(chosen)
        for k in range(0, len(order), BATCH):
            _learn(model, [docs[i] for i in order[k : k + BATCH]], toxic[order[k : k + BATCH]], weights[order[k : k + BATCH]], adams, squares, rng)
    check = np.flatnonzero(aside) if aside.any() else chosen
    z = np.array([model.logits(docs[i], np.array([0, len(docs[i])]))[0] for i in check], dtype=np.float64)
    model.scale = _platt(z, toxic[check])
    p = 1 / (1 + np.exp(-np.clip(model.scale[0] * z + model.scale[1], -60, 60)))
    if toxic[check].sum() >= ENOUGH:  # 0.5 is where F1 is highest
        best = min(max(_threshold(p, toxic[check]), 1e-6), 1 - 1e-6)
        model.scale = (model.scale[0], model.scale[1] - float(np.log(best / (1 - best))))
        p = 1 / (1 + np.exp(-np.clip(model.scale[0] * z + model.scale[1], -60, 60)))
    for lang in sorted({langs[i] for i in check}, key=str):
        of = np.array([langs[i] == lang for i in check])
        y = toxic[check][of]
        model.thresholds[lang] = _threshold(p[of], y) if y.sum() >= ENOUGH else 0.5
    return model


def _learn(model: Model, docs: list[np.ndarray], y: np.ndarray, weights: np.ndarray, adams: list[_Adam], squares: list[np.ndarray], rng: np.random.Generator) -> None:
    g_filters = [np.zeros_like(f) for f in model.filters]
    g_bias, g_out, g_b = np.zeros_like(model.bias), np.zeros_like(model.out), 0.0
    rows_hit, grads_hit, keeps_hit = [], [], []
    for rows, label, weight in zip(docs, y, weights, strict=True):
        pooled = np.zeros(len(model.out), dtype=np.float32)
        n = len(rows)
        if n:
            keep = (rng.random(n) >= DROP).astype(np.float32)
            x = np.zeros((n + max(WIDTHS) - 1, DIM), dtype=np.float32)
            x[:n] = model.vectors(rows, keep)
            at = []
            for k, w in enumerate(WIDTHS):
                conv = sum(x[j : j + n] @ model.filters[k][j * DIM : (j + 1) * DIM] for j in range(w))
                at.append(conv.argmax(axis=0))
                pooled[k * FILTERS : (k + 1) * FILTERS] = conv[at[-1], np.arange(FILTERS)]
            pooled = np.maximum(pooled + model.bias, 0)
        p = 1 / (1 + np.exp(-np.clip(pooled @ model.out + model.out_bias, -30, 30)))
        d = np.float32((p - label) * weight / len(docs))
        g_out += d * pooled
        g_b += float(d)
        if not n:
            continue
        back = d * model.out * (pooled > 0)
        g_bias += back
        for k, w in enumerate(WIDTHS):
            part = back[k * FILTERS : (k + 1) * FILTERS]
            for j in range(w):
                place = at[k] + j
                g_filters[k][j * DIM : (j + 1) * DIM] += x[place].T * part
                ok = (place < n) & (part != 0)
                rows_hit.append(rows[place[ok]])
                keeps_hit.append(keep[place[ok]])
                grads_hit.append((model.filters[k][j * DIM : (j + 1) * DIM].T * part[:, None])[ok])
    for a, value, g in zip(adams, (*model.filters, model.bias, model.out), (*g_filters, g_bias, g_out), strict=False):
        a.step(value, g + 1e-5 * value)
    b = np.array([model.out_bias], dtype=np.float32)
    adams[-1].step(b, np.array([g_b], dtype=np.float32))
    model.out_bias = float(b[0])
    if rows_hit:
        rows, grads, keep = np.concatenate(rows_hit), np.concatenate(grads_hit), np.concatenate(keeps_hit)
        for k in range(3):
            ids, back = np.unique(rows[:, k], return_inverse=True)
            g = np.zeros((len(ids), DIM), dtype=np.float32)
            np.add.at(g, back, grads * keep[:, None] if k == 0 else grads)
            squares[k][ids] += (g * g).mean(axis=1)
            model.embeddings[k][ids] -= STEP * 2 * g / np.sqrt(squares[k][ids])[:, None]


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic fit to smoothed labels, by Newton's method."""
    up, n = int(y.sum()), len(y)
    t = np.where(y == 1, (up + 1) / (up + 2), 1 / (n - up + 2))
    a, b = 1.0, 0.0
    x = np.c_[z, np.ones(n)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -60, 60)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(2) * 1e-3
        step = np.linalg.solve(h, x.T @ (p - t) + 1e-3 * np.array([a - 1, b]))
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -2, 2))
        if abs(step).max() < 1e-6:
            break
    return max(a, 1e-3), b


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Where F1 is highest, half way to the next lower score."""
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(p) + 1) + y.sum())
    k = int(f1.argmax())
    return float((p[order[k]] + (p[order[k + 1]] if k + 1 < len(p) else 0.0)) / 2)


def fold(ident: Column) -> Column:
    return F.crc32(ident.cast("string").cast("binary")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> Model:
    """docs: doc_id, lang, text; labels: doc_id, toxic. Rows of the held-out fold are never read as labels."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    least = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, sample[0]), (0, sample[1]))]
    chosen = F.broadcast(least[0].union(least[1]))  # bounded by the sample
    rows = docs.join(chosen, "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max(F.struct("text", "lang")).alias("x"))
    upto = F.sum(F.coalesce(F.octet_length("x.text"), F.lit(0))).over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id"))
    rows = rows.withColumn("bytes", upto).where(F.col("bytes") <= SAMPLE_BYTES // 2)  # two groups, bounded by the sample
    found = sorted(rows.select("doc_id", "toxic", "x.text", "x.lang").collect(), key=lambda r: (hash_of(r["doc_id"]), str(r["doc_id"])))
    texts = []
    for batch in tokens.chunks(iter([pa.RecordBatch.from_pydict({"text": pa.array([r["text"] for r in found], pa.string())})]), "text", 1 << 18):
        at, first = word_rows(batch.column("text"))
        texts += [at[first[i] : first[i + 1]].copy() for i in range(batch.num_rows)]
    return train(texts, np.array([r["toxic"] for r in found], dtype=np.int64), [r["lang"] for r in found])


def hash_of(x: object) -> int:
    """A fixed number that shuffles ids."""
    return int(tokens.scramble(np.frombuffer(str(x).encode().ljust(24, b"\0")[:24], dtype=np.uint64).copy()).sum())


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in tokens.chunks(batches, "text", 1 << 20):
            names = [c for c in batch.schema.names if c != "text"]
            scores = model.scores(*word_rows(batch.column("text")))
            langs = batch.column("lang").to_pylist()
            limits = [model.thresholds.get(x, 0.5) for x in langs]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(scores, pa.float64()), pa.array(limits, pa.float64())], [*names, "score", "threshold"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, score, threshold; docs: doc_id, lang, text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "lang", "text").mapInArrow(_score(shared), f"doc_id {kind}, lang string, score double, threshold double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", (F.col("score") >= F.col("threshold")).alias("flagged"))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLES: dict[str, str] = {}
