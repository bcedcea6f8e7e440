"""Vectorised words, hashes and batches over Arrow string columns.

A chunk is a slice of a record batch of at most ``CHUNK_BYTES`` of text (one longer text makes a chunk
of its own).  Its texts lie end to end in one byte array, and words are byte ranges of that array.
Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 6 << 20
SPACES = b" \t\n\x0b\x0c\r"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_NOT_SPACE = np.ones(256, dtype=bool)
_NOT_SPACE[list(SPACES)] = False
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xBF58476D1CE4E5B9)
_C = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch whose texts hold ``limit`` bytes at most, or one row."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < n:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


@dataclass
class Texts:
    """Texts end to end: text i is ``data[offsets[i]:offsets[i + 1]]``; ``data`` has 8 spare bytes at its end."""

    data: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        column = pc.fill_null(column, "").cast(pa.large_string())
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=column.offset + n + 1)[column.offset :] if n else np.zeros(1, np.int64)
        first, last = int(offsets[0]), int(offsets[-1])
        data = np.zeros(last - first + 8, dtype=np.uint8)
        if last > first:
            data[: last - first] = np.frombuffer(column.buffers()[2], dtype=np.uint8)[first:last]
        return cls(data, offsets - first)

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    @property
    def size(self) -> int:
        return int(self.offsets[-1])

    def lowered(self) -> Texts:
        """A-Z to a-z; no other byte changes."""
        return Texts(_LOWER[self.data], self.offsets)

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums over the bytes of each text of a byte-long array of counts or flags."""
        total = np.zeros(self.size + 1, dtype=np.int64)
        np.cumsum(values[: self.size], out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


@dataclass
class Words:
    """Word j is ``data[start[j]:end[j]]``; the words of text i are ``first[i]`` to ``first[i + 1]``."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def n(self) -> int:
        return len(self.start)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _words(texts: Texts, is_word: np.ndarray) -> Words:
    size = texts.size
    inside = is_word[texts.data[:size]]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = texts.offsets[(texts.offsets > 0) & (texts.offsets < size)]
    opens[edges] = inside[edges]  # a text's first byte opens a word whatever stands before it
    closes[edges - 1] = inside[edges - 1]
    start = np.flatnonzero(opens)
    return Words(start, np.flatnonzero(closes) + 1, np.searchsorted(start, texts.offsets))


def space_words(texts: Texts) -> Words:
    """Runs of anything but the six ASCII white-space characters."""
    return _words(texts, _NOT_SPACE)


def alnum_words(texts: Texts) -> Words:
    """Runs of ASCII letters and digits and of all characters from U+0080."""
    return _words(texts, _ALNUM)


def word_hashes(texts: Texts, words: Words) -> np.ndarray:
    """64-bit hashes of the words' bytes, eight bytes a step."""
    eight = np.ndarray((max(len(texts.data) - 7, 0),), dtype="<u8", buffer=texts.data, strides=(1,))
    length = words.end - words.start
    out = length.astype(np.uint64) * _A
    at, left, rows = words.start, length, None
    while len(at):
        got = eight[at]
        short = left < 8
        got[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        if rows is None:
            out = mix(out ^ got)
            rows = np.flatnonzero(left > 8)
        else:
            out[rows] = mix(out[rows] * _A ^ got)
            rows = rows[left > 8]
        keep = left > 8
        at, left = at[keep] + 8, left[keep] - 8
    return out


def run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every run of k neighbours, run i from word i on; runs may cross from one text into the next."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _A
        out ^= hashes[j : j + n]
        out = mix(out)
    return out


def inside_runs(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the runs of k words that lie within one text, and their texts."""
    counts = np.maximum(np.diff(words.first) - k + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(words.first[:-1], counts)
    return at, owner


def shingle_sets(texts: Texts, words: Words, k: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of k-word shingles of each text, and the offsets of the texts among them.

    A text of fewer words, but not none, has its whole sequence as its one shingle.
    """
    hashes = word_hashes(texts, words) if hashes is None else hashes
    runs = run_hashes(hashes, k)
    at, owner = inside_runs(words, k)
    values = runs[at] if len(at) else np.empty(0, np.uint64)
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = np.array([run_hashes(hashes[words.first[i] : words.first[i + 1]], int(count[i]))[0] for i in short], dtype=np.uint64)
        values, owner = np.concatenate([values, mix(extra + _B)]), np.concatenate([owner, short])
    order = np.lexsort((values, owner)) if len(short) else _grouped_order(values, owner)
    values, owner = values[order], owner[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(texts.n + 1))


def _grouped_order(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """As lexsort((values, owner)) for an owner that already ascends: sort by value, then stably by owner."""
    by_value = np.argsort(values)
    small = owner.astype(np.uint16) if len(owner) and owner[-1] < 65536 else owner
    return by_value[np.argsort(small[by_value], kind="stable")]
