"""Near copies by Order MinHash, verified by banded alignment.

A sketch has ``TABLES`` entries. For each, the ``CHOSEN`` least of a text's shingles of ``SHINGLE`` words, each
labelled with how often it occurred before, are kept in the order of the text and hashed together: texts agree
in an entry if they share these shingles and their order, so agreement follows edit similarity. Equal texts are
one class from the start. Classes that share an entry are paired first with the first class of that entry, and with a
neighbour that shares the next entry too; pairs are aligned word by word in a band that is widened up to the most edits
that similarity ``SIMILARITY`` (1 - edits / words of the longer text) allows. Entries whose classes are all linked by
then are settled. In the others, all classes that aren't linked are paired where an entry has ``FEW`` classes or fewer;
classes of larger entries (a passage that many texts share) are paired where they have one of their rarest words in
common. That loses no pair: similar texts share all but a fifth of the longer one's words, so in any order of words
the first fifth of one and of the other, and one word more, meet. Linked classes are joined by connected components.

The texts of such entries get bitmaps of their words, labelled with how often they occurred before; a bit says whether an
odd number of words fell on it. Words that both texts have cancel out, so a bit that differs stands for a word that only one
of them has, and those bound the edits from below: pairs that this bound leaves too far apart are dropped in the join that
makes them, before they are aligned. Words are ordered by cells of a table of counts, a bounded one that all tasks know.

Very long pairs are first aligned at the runs of ``RUN`` words that are once in each of them and in one order in both,
with exact alignments between these, which bounds their edits from above. Where the bound is small enough the pair is
near; only otherwise is the band widened over the whole of it, in memory that grows with the band.

Defined cases: a null text equals an empty one; texts without words are copies only of equal texts; a text shorter
than a shingle is one shingle; a very long text is sketched and aligned whole; null ids come after all others; a class
is named by its least id, and of rows that share it the equal ones count as one; of repeated rows one stays; columns of
the input stay as they are in ``drop_near_copies``, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import tokens
from tidemark.llm.common import boxed, materialize, table, text_key, unboxed
from tidemark.llm.graphs import components

SHINGLE, TABLES, CHOSEN, SIMILARITY = 5, 64, 2, 0.8
#: Bits of a shingle's place among those of a batch, and a value that no shingle has.
PLACE_BITS, ALL = 28, np.uint64(2**64 - 1)
#: Bits of the bitmap that says which texts are to be aligned, a power of two.
BITS = 1 << 24
#: Pairs that are aligned together, numbers held for them at once, and the first half width of the band.
BATCH, HELD, BAND = 128, 1 << 22, 16
#: Pairs with so many words are bounded from above first, by runs of so many words.
LONG, RUN = 4096, 4
#: Neighbours are sought among about so many classes of an entry at once.
CHAIN = 1024
#: Up to so many classes of an entry are paired one by one, more of them by their rarest words.
FEW = 32
#: 64-bit words of the bitmap of a text's labelled words.
SET_WORDS = 32
#: Cells of the counts that order words, a power of two, and how many words of both a pair's next common one is sought among.
CELLS, AFTER = 1 << 18, 24
_SEEDS = tokens.scramble(np.arange(1, TABLES + 1, dtype=np.uint64)) | np.uint64(1)


def _shingles(w: tokens.Words) -> tuple[np.ndarray, np.ndarray]:
    """Labelled shingle hashes of all texts in a row, and where each text's begin, with the end."""
    h, inside = w.windows(SHINGLE)
    counts = np.maximum(w.counts - SHINGLE + 1, 0)
    out, of = h[inside], np.repeat(np.arange(len(counts)), counts)
    short = np.flatnonzero((w.counts > 0) & (counts == 0))
    if len(short):
        whole = np.array([tokens.roll(w.hash[w.first[i] : w.first[i + 1]], int(w.counts[i]))[0] for i in short], dtype=np.uint64)
        at = np.searchsorted(of, short)
        out, of = np.insert(out, at, whole), np.insert(of, at, short)
        counts[short] = 1
    return tokens.scramble(out + _labels(out, of) * np.uint64(tokens.GOLDEN)), np.r_[0, np.cumsum(counts)]


def _labels(h: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How often each value of h occurred before among those of the same text."""
    order = np.lexsort((h, of))
    a, b = h[order], of[order]
    index = np.arange(len(a))
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, dtype=bool)
    label = np.empty(len(a), dtype=np.uint64)
    label[order] = (index - np.maximum.accumulate(np.where(new, index, 0))).astype(np.uint64)
    return label


def sketch(w: tokens.Words) -> tuple[np.ndarray, np.ndarray]:
    """Entries of the sketches of the texts that have words, one text a row, and which texts those are."""
    values, first = _shingles(w)
    texts = np.flatnonzero(np.diff(first))
    begins, counts = first[:-1][texts], np.diff(first)[texts]
    out = np.zeros((len(texts), TABLES), dtype=np.uint64)
    if not len(texts):
        return out, texts
    low = np.uint64((1 << PLACE_BITS) - 1)
    index = np.arange(len(values), dtype=np.uint64)
    for t in range(TABLES):
        v = values * _SEEDS[t]
        v &= ~low
        v |= index  # a minimum tells its place, and of equal hashes the first is least
        places = np.full((len(texts), CHOSEN), len(values))
        for c in range(CHOSEN):
            least = np.minimum.reduceat(v, begins)
            there = least != ALL
            places[there, c] = (least[there] & low).astype(np.int64)
            v[places[there, c]] = ALL
        places.sort(axis=1)
        entry = np.full(len(texts), t + 1, dtype=np.uint64)
        for c in range(CHOSEN):
            there = places[:, c] < len(values)
            entry = np.where(there, tokens.scramble(entry * np.uint64(tokens.GOLDEN) + values[np.where(there, places[:, c], 0)]), entry)
        out[:, t] = entry
    return out, texts


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tokens.chunks(batches, "text"):
        w = tokens.split(batch.column("text"))
        entries, texts = sketch(w)
        sizes = np.zeros(batch.num_rows + 1, dtype=np.int32)
        sizes[texts + 1] = TABLES
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(entries.reshape(-1).view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t1"), batch.column("t2"), pa.array(w.counts.astype(np.int32)), lists], ["doc_id", "t1", "t2", "n_words", "entries"])


def _members(classes: DataFrame) -> DataFrame:
    """cid, entry, next, first, n: classes by entries that they share, with the first class of each and their number."""
    each = classes.select("cid", "entries", F.posexplode("entries").alias("t", "entry"))
    rows = each.select("cid", "entry", F.get("entries", F.pmod(F.col("t") + 1, F.lit(TABLES))).alias("next"))
    shared = rows.groupBy("entry").agg(F.min("cid").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return materialize(rows.join(shared, "entry"), "members")


def _candidates(members: DataFrame) -> DataFrame:
    """a, b: classes that share an entry, each with the first of it and with one neighbour.

    Neighbours follow one order for all entries, so most of them recur. An entry of many classes is cut into runs of that
    order, by the parts of the table that their numbers come from, so no task sorts all of it.
    """
    star = members.where("cid <> first").select(F.col("first").alias("a"), F.col("cid").alias("b"))
    part = F.call_function("shiftright", "cid", F.lit(33))  # as numbers are given out
    parts = (members.agg(F.max(part)).first()[0] or 0) + 1
    run = F.floor(part * F.ceil(F.col("n") / CHAIN) / parts)
    near = Window.partitionBy("entry", "next", run).orderBy("cid")
    chain = members.select("cid", F.lag("cid").over(near).alias("before")).where("before is not null").select(F.least("before", "cid").alias("a"), F.greatest("before", "cid").alias("b"))
    return star.union(chain).distinct()


def _similar_lengths(na: str, nb: str) -> Column:
    longest = F.greatest(na, nb)
    return longest - F.least(na, nb) <= F.floor(longest * (1 - SIMILARITY) + 1e-9)


def _may_be_near(one: str, other: str) -> Column:
    """By numbers of words (n...) and bitmaps (w...) alone: whether a pair can have so few edits as it must.

    Words of one text alone, less those by which it is longer, are half of all that only one text has.
    """
    na, nb, a, b = (F.col(c + x) for c in "nw" for x in (one, other))
    most = F.floor(F.greatest(na, nb) * (1 - SIMILARITY) + 1e-9)
    odd = reduce(lambda s, t: s + t, [F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(SET_WORDS)])
    return _similar_lengths(f"n{one}", f"n{other}") & (odd + F.abs(na - nb) <= 2 * most)


def _by_rare_words(words: DataFrame) -> DataFrame:
    """cid, root, n_words, words -> a, b: classes of unlike roots that share one of their rarest words and may be near.

    Words are labelled with how often they occurred before, and ordered by the number of roots that have a word of their
    cell. Of common words that follow each other within ``AFTER`` words of both texts the last one alone gives the pair.
    """
    cells = words.mapInArrow(_cells, "cell int, root long").distinct().groupBy("cell").agg(F.count(F.lit(1)).alias("roots")).toPandas()  # CELLS rows at most
    roots = np.zeros(CELLS, dtype=np.int32)
    roots[cells["cell"].to_numpy()] = np.minimum(cells["roots"].to_numpy(), np.iinfo(np.int32).max)
    rarest = materialize(words.mapInArrow(_rarest(roots), "cid long, root long, n_words int, rare array<long>, bits array<long>"), "rarest")
    rarest = rarest.select("*", F.posexplode("rare").alias("rank", "word"))
    after = F.slice("rare", F.col("rank") + 2, F.lit(AFTER))
    one, other = (rarest.select("word", F.col("cid").alias(x), F.col("root").alias(f"r{x}"), F.col("n_words").alias(f"n{x}"), F.col("bits").alias(f"w{x}"), after.alias(f"after_{x}")) for x in "ab")
    met = one.join(other, "word").where("a < b and ra <> rb").where(_may_be_near("a", "b") & ~F.arrays_overlap("after_a", "after_b"))
    return met.select("a", "b").distinct()


def label(words: np.ndarray) -> np.ndarray:
    """The 31-bit hashes of a text's words, each with how often it occurred before, in another order."""
    w = np.sort(words.astype(np.int64), kind="stable")
    index = np.arange(len(w))
    new = np.r_[True, w[1:] != w[:-1]] if len(w) else np.zeros(0, dtype=bool)
    return w << 32 | (index - np.maximum.accumulate(np.where(new, index, 0)))


def word_set(labelled: np.ndarray) -> np.ndarray:
    """The bitmap of a text's labelled words: whether an odd number of them has each bit."""
    n = 64 * SET_WORDS
    odd = np.bincount((tokens.scramble(labelled.view(np.uint64)) % np.uint64(n)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def _cell(labelled: np.ndarray) -> np.ndarray:
    return (tokens.scramble(labelled.view(np.uint64)) >> np.uint64(32) & np.uint64(CELLS - 1)).astype(np.int32)


def rare_words(labelled: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Of a text's labelled words the rarest fifth and one more, without those that a single root has."""
    n = roots[_cell(labelled)]
    order = np.lexsort((labelled, n))[: int(np.floor(len(labelled) * (1 - SIMILARITY) + 1e-9)) + 1]
    return labelled[order[n[order] > 1]]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [_cell(label(x.values.to_numpy())) for x in batch.column("words")]
        root = np.repeat(batch.column("root").to_numpy(), [len(x) for x in lists])
        rows = pa.table({"cell": np.concatenate(lists) if lists else np.zeros(0, dtype=np.int32), "root": root})
        yield from rows.group_by(["cell", "root"]).aggregate([]).to_batches()


def _rarest(roots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labelled = [label(x.values.to_numpy()) for x in batch.column("words")]
            rare = [rare_words(x, roots) for x in labelled]
            first = np.r_[0, np.cumsum([len(x) for x in rare])].astype(np.int32)
            words = pa.ListArray.from_arrays(pa.array(first), pa.array(np.concatenate(rare) if rare else np.zeros(0, dtype=np.int64)))
            sets = np.array([word_set(x) for x in labelled], dtype=np.int64).ravel()
            bits = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * SET_WORDS), pa.array(sets))
            yield pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("root"), batch.column("n_words"), words, bits], ["cid", "root", "n_words", "rare", "bits"])

    return run


def _word_lists(bits: bytes):
    """t1, t2, words: 31-bit hashes of the words of the texts that the bitmap may know."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(np.frombuffer(bits, dtype=np.uint8)).astype(bool)
        for batch in batches:
            t1 = np.asarray(batch.column("t1"))
            for part in tokens.chunks(iter([batch.filter(pa.array(known[t1 & (len(known) - 1)]))]), "text"):
                w = tokens.split(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(w.first.astype(np.int32)), pa.array((w.hash >> np.uint64(33)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("t1"), part.column("t2"), lists], ["t1", "t2", "words"])

    return run


def banded(pairs: list[tuple[np.ndarray, np.ndarray]], band: int) -> np.ndarray:
    """Edits between the sequences of each pair, right where they are at most ``band``; lengths differ by no more.

    All pairs move down one row at a time; a row holds the cells within ``band`` of the diagonal.
    """
    p, n = len(pairs), np.array([len(a) for a, _ in pairs])
    m = np.array([len(b) for _, b in pairs])
    high, width = int(n.max()), 2 * band + 1
    a = np.full((p, high), -1, dtype=np.int32)
    b = np.full((p, high + width + band), -2, dtype=np.int32)
    for i, (x, y) in enumerate(pairs):
        a[i, : len(x)] = x
        b[i, band : band + len(y)] = y[: high + width]
    far = np.int32(1 << 29)
    step = np.arange(width, dtype=np.int32)
    row = np.broadcast_to(np.where(step >= band, step - band, far), (p, width)).astype(np.int32)
    out = np.full(p, far, dtype=np.int64)
    end = m - n + band
    done = n == 0
    out[done] = row[done, end[done]]
    up = np.empty((p, width), dtype=np.int32)
    for i in range(1, high + 1):
        up[:, :-1] = row[:, 1:]
        up[:, -1] = far
        up += 1
        row = row + (b[:, i - 1 : i - 1 + width] != a[:, i - 1 : i])
        if i <= band:
            row[:, : band - i + 1] = far  # no letters of b before its first
        np.minimum(row, up, out=row)
        row -= step
        np.minimum.accumulate(row, axis=1, out=row)
        row += step
        if i <= band:
            row[:, : band - i] = far
        if (done := n == i).any():
            out[done] = row[done, end[done]]
        if i % 32 == 0 and (row[n > i].min(axis=1, initial=far) > band).all():
            break  # no path of the others can end within the band
    return out


def edits_within(pairs: list[tuple[np.ndarray, np.ndarray]], most: np.ndarray) -> np.ndarray:
    """Edits of each pair, or -1 where they are more than ``most``; of long pairs a bound that is no more than it will do."""
    out = np.full(len(pairs), -1, dtype=np.int64)
    left = []
    for i, (a, b) in enumerate(pairs):
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > most[i]:
            continue
        n = len(a)
        same = a == b[:n]
        head = n if same.all() else int(np.argmin(same))
        a, b = a[head:], b[head:]
        n = len(a)
        same = a[::-1] == b[::-1][:n]
        tail = n if same.all() else int(np.argmin(same))
        a, b = a[: n - tail], b[: len(b) - tail]
        if not len(a):
            out[i] = len(b)
            continue
        x, na = np.unique(a, return_counts=True)
        y, nb = np.unique(b, return_counts=True)
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        common = int(np.minimum(na, np.where(y[at] == x, nb[at], 0)).sum())
        if len(b) - common > most[i]:  # each word of the longer one that the other lacks is an edit
            continue
        if len(b) >= LONG and (bound := _at_most(a, b)) <= most[i]:
            out[i] = bound
            continue
        left.append((i, a, b, len(b) - common))
    band = BAND
    while left:
        left.sort(key=lambda x: len(x[1]))
        wait = []
        k = 0
        while k < len(left):
            n = next((n for n in range(1, min(BATCH, len(left) - k)) if (n + 1) * (len(left[k + n][1]) + 3 * band) > HELD), min(BATCH, len(left) - k))
            part = left[k : k + n]
            k += n
            fits = [x for x in part if x[3] <= band]  # the bound on edits says which bands can't do
            wait += [x for x in part if x[3] > band]
            if fits:
                for x, d in zip(fits, banded([(a, b) for _, a, b, _ in fits], band), strict=True):
                    if d <= band:
                        out[x[0]] = d if d <= most[x[0]] else -1
                    elif band < most[x[0]]:
                        wait.append(x)
        left, band = wait, band * 2
    return out


def _at_most(a: np.ndarray, b: np.ndarray) -> int:
    """An upper bound of the edits between two sequences, near to them where edits are scattered."""
    runs = []
    for x in (a, b):
        h = tokens.roll(tokens.scramble(x.astype(np.int64).view(np.uint64)), RUN)
        values, at, counts = np.unique(h, return_index=True, return_counts=True)
        runs.append((values[counts == 1], at[counts == 1]))
    _, in_a, in_b = np.intersect1d(runs[0][0], runs[1][0], assume_unique=True, return_indices=True)
    i, j = runs[0][1][in_a], runs[1][1][in_b]
    order = np.argsort(i)
    i, j = i[order], j[order]
    tops, tails, back = [], [], np.full(len(j), -1, dtype=np.int64)  # the longest run of places that rise in both
    for k, y in enumerate(j.tolist()):
        p = bisect_left(tops, y)
        back[k] = tails[p - 1] if p else -1
        tops[p : p + 1], tails[p : p + 1] = [y], [k]
    chain, k = [], tails[-1] if tails else -1
    while k >= 0:
        chain.append(k)
        k = int(back[k])
    chain = np.array(chain[::-1], dtype=np.int64)
    x, y = ((v[chain][:, None] + np.arange(RUN)).ravel() for v in (i, j))
    x, at = np.unique(x, return_index=True)  # words in two runs are there twice
    y = y[at]
    rises = y > np.r_[-1, np.maximum.accumulate(y)[:-1]] if len(y) else np.zeros(0, dtype=bool)
    x, y = np.r_[-1, x[rises], len(a)], np.r_[-1, y[rises], len(b)]
    gaps = [(a[p + 1 : q], b[r + 1 : s]) for p, q, r, s in zip(x[:-1].tolist(), x[1:].tolist(), y[:-1].tolist(), y[1:].tolist(), strict=True) if q - p > 1 or s - r > 1]
    total = sum(max(len(c), len(d)) for c, d in gaps if max(len(c), len(d)) >= LONG)
    small = [(c, d) for c, d in gaps if max(len(c), len(d)) < LONG]
    return total + int(edits_within(small, np.array([max(len(c), len(d)) for c, d in small], dtype=np.int64)).sum())


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("wa"), batch.column("wb")
        pairs = [(a[i].values.to_numpy(), b[i].values.to_numpy()) for i in range(batch.num_rows)]
        longer = np.array([max(len(x), len(y), 1) for x, y in pairs], dtype=np.int64)
        edits = edits_within(pairs, np.floor(longer * (1 - SIMILARITY) + 1e-9).astype(np.int64))
        keep = np.flatnonzero(edits >= 0)
        yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(keep)), batch.column("b").take(pa.array(keep)), pa.array(1 - edits[keep] / longer[keep])], ["u", "v", "similarity"])


def _words_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cid, words of the classes ``wanted`` (cid, t1, t2)."""
    marks = wanted.select(F.col("t1").bitwiseAND(F.lit(BITS - 1)).cast("int").alias("b")).distinct()
    known = np.zeros(BITS, dtype=bool)
    known[marks.toPandas()["b"].to_numpy().astype(np.int64)] = True  # BITS rows at most
    lists = docs.select("t1", "t2", "text").mapInArrow(_word_lists(np.packbits(known).tobytes()), "t1 long, t2 long, words array<int>")
    # of equal texts one list: they have the same class
    return materialize(wanted.join(lists, ["t1", "t2"]).groupBy("cid").agg(F.first("words").alias("words")), "words")


def _near(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """u, v, similarity: those of ``pairs`` (a, b) that are near copies."""
    wanted = classes.join(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct(), "cid").select("cid", "t1", "t2")
    words = _words_of(docs, wanted)
    wa, wb = (words.select(F.col("cid").alias(x), F.col("words").alias(f"w{x}"), F.size("words").alias(f"n{x}")) for x in "ab")
    full = pairs.join(wa, "a").join(wb, "b").where(_similar_lengths("na", "nb")).select("a", "b", "wa", "wb")
    return materialize(full.mapInArrow(_aligned, "u long, v long, similarity double"), "near")


def _unsettled(members: DataFrame, links: DataFrame) -> DataFrame:
    """entry, next, cid, n, root: entries whose classes the links don't all join."""
    roots = components(links.select("u", "v")).withColumnRenamed("node", "cid")
    rooted = materialize(members.select("entry", "cid", "n").join(roots, "cid", "left").select("entry", "cid", "n", F.coalesce("root", "cid").alias("root")), "rooted")
    apart = rooted.groupBy("entry").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("entry")
    return materialize(rooted.join(apart, "entry"), "rest")


def near_links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """u, v, similarity: classes whose texts are near copies; those that share an entry are linked or joined by links.

    docs: text, t1, t2; classes: cid, t1, t2, n_words, entries, for each distinct text.
    """
    members = _members(classes)
    pairs = materialize(_candidates(members), "pairs")
    links = _near(docs, classes, pairs)
    rest = _unsettled(members, links)
    sized = rest.where(F.col("n") <= FEW).join(classes.select("cid", "n_words"), "cid")
    one, other = (sized.select("entry", F.col("cid").alias(x), F.col("root").alias(f"r{x}"), F.col("n_words").alias(f"n{x}")) for x in "ab")
    few = one.join(other, "entry").where("a < b and ra <> rb").where(_similar_lengths("na", "nb")).select("a", "b").distinct()
    hot = materialize(rest.where(F.col("n") > FEW).select("cid", "root").distinct().join(classes.select("cid", "t1", "t2", "n_words"), "cid"), "hot")
    many = _by_rare_words(_words_of(docs, hot.select("cid", "t1", "t2")).join(hot.select("cid", "root", "n_words"), "cid").select("cid", "root", "n_words", "words"))
    more = materialize(few.union(many).distinct().join(pairs, ["a", "b"], "left_anti"), "more-pairs")
    return links.union(_near(docs, classes, more))


def near_copies(df: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, t1, t2, n_words, class_id, class_size: one row for each row of ``df``; class_id is the class's least id."""
    docs = df.select(F.col(f"`{ident}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    docs = docs.select("doc_id", "text", *text_key(F.col("text")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    base = materialize(docs.mapInArrow(_sketches, f"doc_id {kind}, t1 long, t2 long, n_words int, entries array<long>"), "sketches")
    classes = base.groupBy("t1", "t2").agg(F.first("n_words").alias("n_words"), F.first("entries").alias("entries"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    roots = components(near_links(docs, classes).select("u", "v"))
    named = classes.select("cid", "t1", "t2").join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("t1", "t2", F.coalesce("root", "cid").alias("root"))
    rows = base.select("doc_id", "t1", "t2", "n_words").join(named, ["t1", "t2"])
    # written, so that the join may split the rows of a large class
    sizes = materialize(rows.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")), "class-sizes")
    return rows.join(sizes, "root").select("doc_id", "t1", "t2", "n_words", "class_id", "class_size")


def drop_near_copies(df: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The row with the least id of each class, with its own columns; of rows equal in id and text one."""
    found = near_copies(df, ident, text)
    first = found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select("doc_id", "t1", "t2").distinct()
    stays = materialize(first.select(F.col("doc_id").alias("__d"), F.col("t1").alias("__t1"), F.col("t2").alias("__t2")), "stays")
    row = boxed(df)
    t1, t2 = text_key(F.col(f"__row.`{text}`"))
    keyed = row.select("__row", F.col(f"__row.`{ident}`").alias("__i"), t1.alias("__k1"), t2.alias("__k2"))
    kept = keyed.join(stays, F.col("__i").eqNullSafe(F.col("__d")) & (F.col("__k1") == F.col("__t1")) & (F.col("__k2") == F.col("__t2")), "left_semi")
    return unboxed(kept.dropDuplicates(["__i", "__k1", "__k2"]).select("__row"))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


QUERIES = {"op7_order_minhash": op7_order_minhash}
ORACLES: dict[str, str] = {}
