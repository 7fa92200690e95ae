"""Words of whole Arrow batches as arrays: where they are, and a 64-bit hash of each, without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; one text may be longer.
CHUNK = 4 << 20
#: Odd multipliers, the golden ratio's among them, and a seed for the table of bytes.
GOLDEN, MULTIPLIER, SEED = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 20240229

_BYTES = np.random.default_rng(SEED).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = np.ones(1, dtype=np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        full = np.full(max(n, 1024), MULTIPLIER, dtype=np.uint64)
        full[0] = 1
        _powers = np.multiply.accumulate(full)
    return _powers


def scramble(x: np.ndarray) -> np.ndarray:
    """A mixed copy of 64-bit values; distinct ones stay distinct."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes of words as most operators take them: all but space and 0x09 to 0x0D.
PLAIN = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])
#: Letters, digits and bytes beyond ASCII, for text that is compared by its words alone.
ALPHANUMERIC = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or 0x41 <= b <= 0x5A or b >= 0x80 for b in range(256)])
#: Upper-case ASCII to lower case.
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


@dataclass
class Words:
    """Words of some texts in a row: text i has those from first[i] to first[i + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def of(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1, dtype=np.int32), self.counts)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def windows(self, n: int, h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each word on, and whether they lie in one text; for all but the last n - 1."""
        return roll(self.hash if h is None else h, n), self.inside(n)

    def inside(self, n: int) -> np.ndarray:
        of = self.of
        return of[: max(0, len(of) - n + 1)] == of[n - 1 :] if len(of) >= n else np.zeros(0, dtype=bool)


def roll(h: np.ndarray, n: int) -> np.ndarray:
    m = max(0, len(h) - n + 1)
    out = np.zeros(m, dtype=np.uint64)
    if m:
        for j in range(n):
            out *= np.uint64(GOLDEN)
            out += h[j : j + m]
    return scramble(out)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (null: none), and where each begins, with the end."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets - offsets[0]


def split(texts: pa.Array, table: np.ndarray = PLAIN, fold: np.ndarray | None = None) -> Words:
    data, at = raw(texts)
    if fold is not None:
        data = fold[data]
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Words(data, none, none, none.astype(np.uint64), np.zeros(len(at), dtype=np.int64))
    inside = table[data]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[at[:-1][at[:-1] < n]] = False
    begins = inside & ~before
    start = np.flatnonzero(begins)
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = at[1:]
    after[ends[ends > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    if len(start):
        index = np.arange(n, dtype=np.int32)
        offset = index - np.maximum.accumulate(np.where(begins, index, 0))
        values = np.where(table, _BYTES, 0).astype(np.uint64)
        sums = np.add.reduceat(values[data] * _power(int((end - start).max()) + 1)[np.minimum(offset, (end - start).max())], start)
        hashes = scramble(sums + (end - start).astype(np.uint64) * np.uint64(GOLDEN))
    else:
        hashes = np.zeros(0, dtype=np.uint64)
    return Words(data, start, end, hashes, np.searchsorted(start, at))


def chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, each of at least one row."""
    for batch in batches:
        sizes = np.diff(raw(batch.column(text))[1])
        begin, total = 0, 0
        for i, size in enumerate(sizes):
            if i > begin and total + size > most:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += int(size)
        if begin < len(sizes):
            yield batch.slice(begin)
