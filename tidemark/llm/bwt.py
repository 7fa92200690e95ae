"""Burrows-Wheeler transforms of shards of strings, merged by interleave refinement.

Strings are read in letters of ``STRIDE`` bytes: suffix i begins with the letter at i and goes on at i + STRIDE, so
each string is STRIDE interleaved chains of letters, each with an end mark of its own that sorts before all letters.
Letters are compared by a 64-bit hash; any order of letters serves, as only equal ones count. The transform of a
shard lists, in the order of its sorted suffixes, the letter before each.

Merging doesn't sort suffixes again. An interleave says of which shard each row of the merged order is. Reading the
transforms in this order and dealing the rows to their letters, in a stable way, gives the interleave by one letter
more; a boundary between rows that first shows in round j ends a common prefix of j - 1 letters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tidemark.llm import tokens

STRIDE = 50


def gram_hash(data: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n bytes from each byte on, by doubling."""
    h = tokens._BYTES[data]
    width, power = 1, tokens.MULTIPLIER
    out, done, bits = None, 0, n
    while bits:
        if bits & 1:
            m = len(data) - n + 1
            part = h[done : done + m] if m > 0 else h[:0]
            out = part.copy() if out is None else out * np.uint64(power) + part
            done += width
        bits >>= 1
        if bits:
            h = h[:-width] * np.uint64(power) + h[width:] if len(h) > width else h[:0]
            power = power * power % (1 << 64)
            width *= 2
    return tokens.scramble(out) if out is not None else h


@dataclass
class Shard:
    """place: where each suffix begins, as string and offset, in sorted order; before: the letter before it; marks:
    how many suffixes are end marks, the first ones; chained: whether there is a letter before."""

    string: np.ndarray
    offset: np.ndarray
    before: np.ndarray
    chained: np.ndarray
    marks: int


def _order(high: np.ndarray, low: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of (high, low) and dense ranks; both below 2**31, or high alone any 64-bit value."""
    key = high if low is None else (high.astype(np.uint64) << np.uint64(32)) | low.astype(np.uint64)
    order = np.argsort(key)
    at = key[order]
    rank = np.empty(len(key), dtype=np.int64)
    rank[order] = np.cumsum(np.r_[False, at[1:] != at[:-1]])
    return order, rank


def transform(strings: list[bytes], names: np.ndarray) -> Shard:
    """The shard of some strings of STRIDE bytes at least; names: their numbers."""
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    data = np.frombuffer(b"".join(s + b"\0" for s in strings), dtype=np.uint8)  # a place for the mark after the last byte
    first = np.r_[0, np.cumsum(sizes + 1)]
    of = np.repeat(np.arange(len(strings)), sizes + 1)
    offset = np.arange(len(data)) - first[of]
    letters = np.zeros(len(data), dtype=np.uint64)
    h = gram_hash(data, STRIDE)
    letters[: len(h)] = h
    letter = offset + STRIDE <= sizes[of]
    n_marks = int((~letter).sum())
    rank = np.empty(len(data), dtype=np.int64)
    rank[~letter] = np.arange(n_marks)
    _, dense = _order(letters[letter])
    rank[letter] = n_marks + dense
    step = STRIDE
    index = np.arange(len(data))
    while True:
        nxt = np.minimum(index + step, len(data) - 1)
        low = np.where(letter & (of[nxt] == of) & (index + step < len(data)), rank[nxt], 0)
        order, fresh = _order(rank, low)
        if fresh[order[-1]] == len(data) - 1:
            break
        rank, step = fresh, step * 2
    chained = offset[order] >= STRIDE
    return Shard(names[of[order]], offset[order], np.where(chained, letters[np.maximum(order - STRIDE, 0)], 0), chained, n_marks)


def merge(shards: list[Shard], rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """string and offset of all suffixes by their first ``rounds`` letters, and the common prefix of each with the one
    above it, in letters, ``rounds`` at most."""
    sizes = np.array([len(s.string) for s in shards])
    base = np.r_[0, np.cumsum(sizes)]
    n = int(base[-1])
    before = np.concatenate([s.before for s in shards])
    chained = np.concatenate([s.chained for s in shards])
    _, dense = _order(before)
    marks = np.concatenate([np.full(s.marks, k) for k, s in enumerate(shards)])
    interleave = np.repeat(np.arange(len(shards)), sizes)
    common = np.full(n, rounds, dtype=np.int64)
    common[0] = 0
    edge = np.zeros(n, dtype=bool)
    edge[0] = True

    def rows(z: np.ndarray) -> np.ndarray:
        out = np.empty(n, dtype=np.int64)
        for k in range(len(shards)):
            out[z == k] = np.arange(base[k], base[k + 1])
        return out

    for j in range(1, rounds + 1):
        read = rows(interleave)
        live = np.flatnonzero(chained[read])
        symbol = dense[read[live]]
        key = np.sort((symbol.astype(np.uint64) << np.uint64(32)) | live.astype(np.uint64))  # stable: ties by place
        source = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        symbol = (key >> np.uint64(32)).astype(np.int64)
        block = np.cumsum(edge)[source]
        # end marks differ from each other; rows of one letter stay apart if what follows did
        fresh = np.r_[np.ones(len(marks), dtype=bool), np.r_[True, (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])][: len(symbol)]]
        new = fresh & ~edge
        common[new] = j - 1
        interleave, edge = np.r_[marks, interleave[source]], fresh | edge
    read = rows(interleave)
    string = np.concatenate([s.string for s in shards])[read]
    offset = np.concatenate([s.offset for s in shards])[read]
    return string, offset, common


def repeated(strings: list[bytes], weights: np.ndarray, length: int, shard_bytes: int) -> list[np.ndarray]:
    """For each string, whether each window of ``length`` bytes (a multiple of STRIDE) occurs twice or more in all.

    weights: how often each string is there.
    """
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    cut = np.cumsum(sizes) // shard_bytes
    shards = [transform([strings[i] for i in part], part) for part in (np.flatnonzero(cut == c) for c in np.unique(cut))]
    string, offset, common = merge(shards, length // STRIDE)
    interval = np.cumsum(common < length // STRIDE) - 1
    whole = offset + length <= sizes[string]
    total = np.bincount(interval, weights=np.where(whole, weights[string], 0))
    hit = whole & (total[interval] >= 2)
    first = np.r_[0, np.cumsum(np.maximum(0, sizes - length + 1))]
    out = np.zeros(first[-1], dtype=bool)
    out[first[string[hit]] + offset[hit]] = True
    return np.split(out, first[1:-1])
