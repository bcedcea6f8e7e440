"""Language-model scores by logistic context mixing.

Text model: a text is its lower-cased words, each closed by a blank, and one end mark.  Bytes are spelled as the binary
decisions of a prefix code fitted to the training bytes.  For every decision seven contexts are hashed to slots of counters:
the last 1, 2, 3, 4 and 6 bytes of the word, and the whole word so far, alone and with the document's state (the first four
have the state too).  A gate, the longest context with evidence together with the place in the code, picks the weights by
which the predictors' logits are added; an adaptive map per gate then refines the mixed probability.  The state is causal:
the cluster of the last frequent word before the token, so it follows a document's language or subject.

Learning, over all training documents:
1. each task splits its texts into chunks and stores every chunk once: words, and tokens as word numbers;
2. the frequent words are found from the chunks' own most frequent ones; their transitions, counted over all chunks, are
   clustered into states;
3. chunks' (state, word) counts meet in ranges.  Words that begin alike meet in one range (a beginning that too many words
   share is split by a longer one), so the counters of the whole word so far are the range's own, and their number grows
   with the words of the corpus.  The counters of the last bytes are added up over all ranges into tables of fixed size;
4. weights and refinement are learned online, range by range, by gradient steps over the words in hashed order, with each
   decision's own occurrence taken out of its counters; ranges are averaged by their tokens (parameter mixing);
5. each range scores its (state, word) pairs once and answers the chunks, which add up their documents.

Broadcast data have fixed sizes: the shared counters (two bytes a slot, ``slots``), weights, code, frequent words, states and
the bit table of long shared beginnings.  Counts of words travel by range, never to the driver.

Defined results: null and empty texts are the end mark alone; a null id counts as the empty text's checksum (training);
without training documents the counters are empty, N = V = 0, and base_score of a known-free token is log10(0.5 / 0.5) = 0;
repeated rows are each learned and scored, rows with one id and different texts too; a very long text is a chunk of its own
and a very long word is spelled whole; other columns are ignored whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
import uuid
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from attestor.llm.frames import drop, keep, map_chunks, rows_per_batch
from attestor.llm.text import Texts, Words as Spans, mix, space_words, word_hashes

END = b"\n"
_R = np.uint64(0x9E3779B97F4A7C15)
_RI = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: A chunk's words that may become frequent words.
_CANDIDATES = 512
SHARED = 5
ORDERS = SHARED + 2
#: Lengths of the beginnings by which words are dealt to ranges; after the last the whole word decides.
LEVELS = (3, 6, 12, 24, 48)


@dataclass(frozen=True)
class Model:
    #: log2 of the slots of the tables that all ranges share, by context.
    slots: tuple[int, ...] = (16, 18, 20, 20, 20)
    #: log2 of the slots of each of a range's own tables.
    own_slots: int = 20
    frequent: int = 64
    states: int = 8
    chunk_bytes: int = 4 << 20
    #: Words, counted once a chunk, that meet in one range, about.
    range_words: int = 1 << 16
    #: log2 of the bits of the table of beginnings that are split.
    split_bits: int = 22
    #: Bytes learned from in one gradient step, and scored at a time.
    step_bytes: int = 6 << 10
    rate: float = 0.02
    smooth: float = 0.4


@dataclass
class Learned:
    """What scoring needs besides the counters' codes."""

    code: np.ndarray
    code_bits: np.ndarray
    nodes: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    refine: np.ndarray = field(default_factory=lambda: np.zeros(0))


# ---- counters -------------------------------------------------------------------------------------------------


def count_levels() -> np.ndarray:
    """The count that each of 256 codes stands for: exact to 63, then 193 steps of equal ratio up to 2 ** 40."""
    return np.concatenate([np.arange(64), np.round(np.exp(np.linspace(np.log(64), np.log(2.0**40), 192)))])


_LEVELS = count_levels()


def encode_counts(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    def code(n):
        return np.minimum(np.searchsorted(_LEVELS, n, side="right") - 1, 255).astype(np.uint16)

    return code(zeros) | code(ones) << np.uint16(8)


@dataclass
class Logits:
    """Tables over pairs of codes: ln((ones + s) / (zeros + s)), 0 without evidence; ``less`` and ``left`` at bit * 65536 +
    codes: the same with one occurrence of that bit taken out, and whether any evidence is left then."""

    plain: np.ndarray
    less: np.ndarray
    left: np.ndarray

    @classmethod
    def of(cls, smooth: float) -> Logits:
        zeros, ones = np.tile(_LEVELS, 256), np.repeat(_LEVELS, 256)

        def table(z, o):
            z, o = np.maximum(z, 0), np.maximum(o, 0)
            return np.where(z + o > 0, np.log((o + smooth) / (z + smooth)), 0.0).astype(np.float32)

        some = lambda z, o: np.maximum(z, 0) + np.maximum(o, 0) > 0
        return cls(table(zeros, ones), np.concatenate([table(zeros - 1, ones), table(zeros, ones - 1)]), np.concatenate([some(zeros - 1, ones), some(zeros, ones - 1)]))


# ---- code -----------------------------------------------------------------------------------------------------


def prefix_code(counts: np.ndarray) -> Learned:
    """A Huffman code of all 256 bytes (each counted at least once), and the number of every inner node on a byte's path."""
    heap = [(int(c) + 1, b, b) for b, c in enumerate(counts)]
    heapq.heapify(heap)
    children: dict[int, tuple[int, int]] = {}
    number = 256
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        children[number] = (a[2], b[2])
        heapq.heappush(heap, (a[0] + b[0], number, number))
        number += 1
    paths: dict[int, list[tuple[int, int]]] = {}
    stack = [(number - 1, [])]
    while stack:
        node, path = stack.pop()
        if node < 256:
            paths[node] = path
        else:
            stack += [(child, [*path, (node - 256, bit)]) for bit, child in enumerate(children[node])]
    longest = max(map(len, paths.values()))
    nodes, bits = np.zeros((256, longest), np.uint8), np.zeros((256, longest), np.uint8)
    for b, path in paths.items():
        for j, (node, bit) in enumerate(path):
            nodes[b, j], bits[b, j] = node, bit
    return Learned(code=bits, code_bits=np.array([len(paths[b]) for b in range(256)]), nodes=nodes)


# ---- contexts -------------------------------------------------------------------------------------------------


@dataclass
class Words:
    """Distinct (state, word) pairs, spelled end to end: pair i is data[first[i]:first[i + 1]].

    ``level`` tells by which of LEVELS the pair was dealt; from that place on its range holds all words that begin alike."""

    data: np.ndarray
    first: np.ndarray
    states: np.ndarray
    level: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Words:
        codes = _read(row["codes"])
        return cls(np.frombuffer(row["data"], np.uint8), np.concatenate([[0], np.cumsum(_read(row["lengths"]))]), codes >> 3, codes & 7)

    def __len__(self) -> int:
        return len(self.first) - 1

    def take(self, which: np.ndarray) -> Words:
        n = np.diff(self.first)[which]
        first = np.concatenate([[0], np.cumsum(n)])
        return Words(self.data[np.repeat(self.first[:-1][which] - first[:-1], n) + np.arange(first[-1])], first, self.states[which], self.level[which])

    def packed(self) -> dict:
        return {"data": [self.data.tobytes()], "lengths": [_ints(np.diff(self.first))], "codes": [_ints(self.states << 3 | self.level)]}

    def beginnings(self, length: int | None, which: np.ndarray) -> np.ndarray:
        """Hashes of the first ``length`` bytes of some words."""
        start, end = self.first[:-1][which], self.first[1:][which]
        return word_hashes(Texts(np.concatenate([self.data, np.zeros(8, np.uint8)]), self.first[[0, -1]]), Spans(start, end if length is None else np.minimum(end, start + length), which))


def decisions(words: Words, learned: Learned, model: Model, size: int, orders=range(ORDERS)):
    """By steps of ``size`` bytes, within long words too: each decision's bit, place, word, slots (of the given contexts), and
    whether the range's own contexts may be asked."""
    data, first = words.data, words.first
    least = np.array([*LEVELS, 2**62])[words.level]  # words dealt as a whole share no range with those that begin alike
    carry = np.zeros(1, np.uint64)
    for a in range(0, len(data), size):
        part = data[a : a + size]
        n = len(part)
        inside = np.arange(a, a + n)
        whose = np.searchsorted(first, inside, side="right") - 1
        place = inside - first[whose]
        state = (words.states[whose].astype(np.uint64) + np.uint64(1)) << np.uint64(56)
        lead = data[max(0, a - 6) : a]
        behind = np.concatenate([np.zeros(6 - len(lead), np.uint8), lead, part]).astype(np.uint64)
        keys, run = [], np.zeros(n, np.uint64)
        for k in range(6):
            run |= np.where(place > k, behind[5 - k : 5 - k + n], np.uint64(0)) << np.uint64(8 * k)
            if k < 4:
                keys.append(run | state)
        keys.append(run | np.uint64(1 << 55))
        # the word so far, before this byte: each byte in turn is added and the sum multiplied
        powers, inverse = np.cumprod(np.full(n, _R)), np.cumprod(np.full(n, _RI))
        total = np.concatenate([[np.uint64(0)], np.cumsum((part.astype(np.uint64) + np.uint64(1)) * inverse)])
        begin = np.maximum(inside - place - a, 0)
        prefix = (total[:-1] - total[begin]) * powers
        old = inside - place < a  # bytes of a word that began before this step
        prefix[old] += carry * powers[old] * _RI
        carry = (prefix[-1:] + part[-1:].astype(np.uint64) + np.uint64(1)) * _R
        keys += [mix(prefix), mix(prefix) ^ state]
        bits_of = learned.code_bits[part]
        row = np.repeat(np.arange(n), bits_of)
        at = np.arange(len(row)) - np.repeat(np.cumsum(bits_of) - bits_of, bits_of)
        symbol = part[row]
        bit, node = learned.code[symbol, at], learned.nodes[symbol, at].astype(np.uint64)
        salt = mix(node + np.uint64(1))
        widths = (*model.slots, model.own_slots, model.own_slots)
        slots = [((mix(keys[k] * _R + np.uint64(k))[row] ^ salt) * _R >> np.uint64(64 - widths[k])).astype(np.int64) for k in orders]
        yield bit, at, whose[row], slots, (place >= least[whose])[row]


GATES = (ORDERS + 1) * 3
_BUCKETS = 49


def gated(seen: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """The gate of each decision: the longest context with evidence, and whether the code is at its 1st, 2nd or later bit."""
    longest = np.zeros(len(at), np.int64)
    for k, s in enumerate(seen):
        longest[s] = k + 1
    return longest * 3 + np.minimum(at, 2)


def mixed(values: list[np.ndarray], gate: np.ndarray, weights: np.ndarray) -> np.ndarray:
    columns = weights.T.astype(np.float32)
    total = columns[ORDERS][gate]
    for column, v in zip(columns, values):
        total += column[gate] * v
    return np.clip(total, -14, 14)


def bucket_of(logit: np.ndarray, gate: np.ndarray) -> np.ndarray:
    return gate * _BUCKETS + np.clip(np.round(logit * 3).astype(np.int64) + _BUCKETS // 2, 0, _BUCKETS - 1)


def start_weights() -> np.ndarray:
    """One weight row per gate: the three longest contexts with evidence share the say."""
    weights = np.zeros((GATES, ORDERS + 1))
    for g in range(GATES):
        longest = g // 3
        for k in range(max(0, longest - 3), longest):
            weights[g, k] = 1.0 / max(1, min(3, longest))
    return weights


def own_tables(words: Words, counts: np.ndarray, learned: Learned, model: Model) -> list[np.ndarray]:
    """The counters of a range's own contexts, two bytes a slot."""
    sums = [np.zeros(2 << model.own_slots, np.int64) for _ in range(SHARED, ORDERS)]
    for bit, _, owner, slots, own in decisions(words, learned, model, 1 << 15, range(SHARED, ORDERS)):
        weight = counts[owner[own]]
        for t, s in zip(sums, slots):
            np.add.at(t, s[own] * 2 + bit[own], weight)
    return [encode_counts(t[::2], t[1::2]) for t in sums]


def _codes(tables: list[np.ndarray], slots: list[np.ndarray], own: np.ndarray) -> list[np.ndarray]:
    return [t[s] if k < SHARED else np.where(own, t[s], np.uint16(0)) for k, (t, s) in enumerate(zip(tables, slots))]


def log10_words(words: Words, tables: list[np.ndarray], learned: Learned, model: Model, luts: Logits) -> np.ndarray:
    """log10 probability of each spelled word; tables: the shared ones and the range's own."""
    out = np.zeros(len(words))
    half, one, refine = np.float32(0.5), np.float32(1), learned.refine.astype(np.float32)
    for bit, at, owner, slots, own in decisions(words, learned, model, 1 << 14):
        codes = _codes(tables, slots, own)
        gate = gated([c != 0 for c in codes], at)
        logit = mixed([luts.plain[c] for c in codes], gate, learned.weights)
        p = half / (one + np.exp(-logit)) + half * refine[bucket_of(logit, gate)]
        a, b = owner[0], owner[-1] + 1
        out[a:b] += np.bincount(owner - a, np.log(np.where(bit == 1, p, one - p)), b - a)
    return out / np.log(10)


# ---- chunks ---------------------------------------------------------------------------------------------------


def _ints(array: np.ndarray) -> bytes:
    """Whole numbers from 0 in the narrowest of 1, 2, 4 or 8 bytes each, led by that width; led by 0 if it is shorter to
    store a byte each, 255 for those of at least 255, and these apart."""
    top = int(array.max(initial=0))
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    if width > 1:
        large = array >= 255
        if 8 + 8 * int(large.sum()) < (width - 1) * len(array):
            return bytes([0]) + len(array).to_bytes(8, "little") + np.minimum(array, 255).astype(np.uint8).tobytes() + array[large].astype("<u8").tobytes()
    return bytes([width]) + array.astype(f"<u{width}").tobytes()


def _read(data: bytes) -> np.ndarray:
    if data[0]:
        return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)
    n = int.from_bytes(data[1:9], "little")
    out = np.frombuffer(data, np.uint8, n, 9).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u8", offset=9 + n).astype(np.int64)
    return out


def _planes(array: np.ndarray) -> bytes:
    """Numbers under 2 ** 32, all lowest bytes first, then all second ones and so on: what is mostly zero packs well."""
    width = max(1, -(-int(array.max(initial=0)).bit_length() // 8))
    return bytes([width]) + array.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T.tobytes()


def _read_planes(data: bytes) -> np.ndarray:
    out = np.int32(0)
    for k, plane in enumerate(np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)):
        out = out | plane.astype(np.int32) << 8 * k
    return out


def _cells(counts: np.ndarray) -> bytes:
    """Numbers of which many are 0: a bit each, then the others."""
    return np.packbits(counts > 0).tobytes() + _ints(counts[counts > 0])


def _read_cells(data: bytes, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    out[np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8)), count=n).astype(bool)] = _read(data[-(-n // 8) :])
    return out


def _chunked(docs: DataFrame, model: Model) -> DataFrame:
    """One row per chunk: its documents, its distinct words and its tokens as numbers of words; END is word 0."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = Texts.of(part.column(1)).lowered()
        words = space_words(texts)
        hashes, n = word_hashes(texts, words), texts.n
        _, at, which, often = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(-often, kind="stable")  # the most frequent words have the least numbers
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        at, which = at[order], rank[which]
        raw = texts.data.tobytes()
        spelled = [END, *(raw[a:b] + b" " for a, b in zip(words.start[at].tolist(), words.end[at].tolist()))]
        tokens = np.zeros(words.n + n, dtype=np.uint32)
        ends = words.first[1:] + np.arange(n)
        mask = np.ones(len(tokens), bool)
        mask[ends] = False
        tokens[mask] = which + 1
        first = np.concatenate([[0], ends + 1])
        ids = [x.as_py() for x in part.column(0)]
        held = np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1 for i in ids])
        taught = tokens[~np.repeat(held, np.diff(first))]
        counts = np.bincount(taught, minlength=len(spelled))
        lengths = np.array([len(x) for x in spelled])
        data = np.frombuffer(b"".join(spelled), np.uint8)
        seen = np.bincount(data, np.repeat(counts, lengths), 256)
        most = 1 + np.argsort(-counts[1:], kind="stable")[:_CANDIDATES]
        most_hashes = _words(data, lengths).beginnings(None, most)
        cols = [
            pa.array([uuid.uuid4().bytes]), pa.array([ids], pa.list_(part.schema.field(0).type)), pa.array([held.tolist()]), pa.array([_ints(first)]), pa.array([_planes(tokens)]),
            pa.array([data.tobytes()]), pa.array([_ints(lengths)]), pa.array([_ints(seen)]),
            pa.array([len(spelled)]), pa.array([[{"hash": int(h), "c": int(c)} for h, c in zip(most_hashes.view(np.int64), counts[most]) if c]], pa.list_(pa.struct([("hash", pa.int64()), ("c", pa.int64())]))),
        ]
        return pa.RecordBatch.from_arrays(cols, names=["chunk", "ids", "held", "first", "tokens", "data", "lengths", "seen", "words", "top"])

    schema = f"chunk binary, ids array<{kind}>, held array<boolean>, first binary, tokens binary, data binary, lengths binary, seen binary, words long, top array<struct<hash:long,c:long>>"
    return map_chunks(docs, rows, schema, limit=model.chunk_bytes)


def _words(data: np.ndarray, lengths: np.ndarray) -> Words:
    none = np.zeros(len(lengths), np.int64)
    return Words(data, np.concatenate([[0], np.cumsum(lengths)]), none, none)


def _chunk_words(row: dict) -> Words:
    return _words(np.frombuffer(row["data"], np.uint8), _read(row["lengths"]))


def _states(tokens: np.ndarray, first: np.ndarray, marker: np.ndarray) -> np.ndarray:
    """The state of each token: the marker number (from 1) of the last marked word before it in its text, else 0."""
    marks = marker[tokens]
    if not len(tokens):
        return marks
    last = np.where(marks > 0, np.arange(len(tokens), dtype=np.int32), np.int32(-1))
    np.maximum.accumulate(last, out=last)
    last[1:] = last[:-1].copy()
    last[0] = -1
    begin = np.repeat(first[:-1].astype(np.int32), np.diff(first))
    return np.where(last >= begin, marks[np.maximum(last, 0)], np.int32(0))


def _rows(batches):
    for batch in batches:
        yield from batch.to_pylist()


def _clusters(counts: np.ndarray, states: int) -> np.ndarray:
    """A cluster from 1 for each frequent word, by how they follow each other: k-means of smoothed transition rows."""
    n = len(counts)
    if n == 0:
        return np.zeros(0, np.int64)
    both = counts + counts.T
    share = (both + 0.1) / (both + 0.1).sum(1, keepdims=True)
    rows = np.log(share / ((both.sum(0) + 0.1) / (both.sum() + 0.1 * n)))
    centres = rows[[int(both.sum(1).argmax())]]
    while len(centres) < min(states, n):  # the farthest row is the next centre
        far = ((rows[:, None] - centres[None]) ** 2).sum(2).min(1)
        centres = np.concatenate([centres, rows[[int(far.argmax())]]])
    for _ in range(30):
        near = ((rows[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.stack([rows[near == k].mean(0) if (near == k).any() else centres[k] for k in range(len(centres))])
    return near + 1


def _marker(words: Words, frequent: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Of each word its number if it is frequent, else 0."""
    if not len(frequent):
        return np.zeros(len(words), np.int32)
    hashes = words.beginnings(None, np.arange(len(words)))
    order = np.argsort(frequent)
    at = np.minimum(np.searchsorted(frequent[order], hashes), len(frequent) - 1)
    return np.where(frequent[order][at] == hashes, numbers[order][at], 0).astype(np.int32)


def _transitions(chunks: DataFrame, frequent: np.ndarray) -> np.ndarray:
    """How often a frequent word is the next frequent word after another, over all training texts."""
    n = len(frequent)
    shared = chunks.sparkSession.sparkContext.broadcast(frequent)

    def count(batches):
        total = np.zeros((n + 1) * (n + 1), np.int64)
        for row in _rows(batches):
            tokens, first = _read_planes(row["tokens"]), _read(row["first"])
            marker = _marker(_chunk_words(row), shared.value, np.arange(1, n + 1))
            before, marks = _states(tokens, first, marker), marker[tokens]
            taught = ~np.repeat(np.array(row["held"], bool), np.diff(first)) & (before > 0) & (marks > 0)
            total += np.bincount(before[taught].astype(np.int64) * (n + 1) + marks[taught], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    found = chunks.select("tokens", "first", "held", "data", "lengths").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()  # (frequent + 1) ** 2 rows at most
    out = np.zeros((n + 1) * (n + 1), np.int64)
    for r in found:
        out[r["at"]] = r["n"]
    return out.reshape(n + 1, n + 1)[1:, 1:]


def _split_beginnings(chunks: DataFrame, total: int, n_chunks: int, model: Model) -> np.ndarray:
    """A bit table of the beginnings that more words share than half a range holds; a bit set in error only splits more."""
    least = max(16, model.range_words // (4 * max(n_chunks, 1)))

    def count(batches):
        for row in _rows(batches):
            words = _chunk_words(row)
            rest = np.arange(len(words))
            for level, length in enumerate(LEVELS):
                hashes, which, n = np.unique(mix(words.beginnings(length, rest) + np.uint64(level)), return_inverse=True, return_counts=True)
                hot = n >= least
                yield pa.RecordBatch.from_arrays([pa.array(hashes[hot].view(np.int64)), pa.array(n[hot])], names=["hash", "n"])
                rest = rest[hot[which]]

    hot = chunks.select("data", "lengths").mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") > model.range_words // 2)
    slots = hot.select(F.col("hash").bitwiseAND((1 << model.split_bits) - 1).alias("slot")).distinct().toPandas()["slot"]  # 2 ** split_bits at most
    table = np.zeros(1 << model.split_bits, np.uint8)
    table[slots.to_numpy(dtype=np.int64)] = 1
    return np.packbits(table, bitorder="little")


def _dealt(words: Words, split: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The level by which each word is dealt, and its range."""
    level, part = np.full(len(words), len(LEVELS)), np.zeros(len(words), np.int64)
    rest = np.arange(len(words))
    for k, length in enumerate((*LEVELS, None)):
        hashes = mix(words.beginnings(length, rest) + np.uint64(k))
        slot = hashes & np.uint64(len(split) * 8 - 1)
        shared = (split[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1 if length else np.zeros(len(rest), bool)
        level[rest[~shared]], part[rest[~shared]] = k, (mix(hashes[~shared]) % np.uint64(ranges)).astype(np.int64)
        rest = rest[shared]
    return level, part


def _chunk_pairs(row: dict, shared: tuple, ranges: int):
    """A chunk's tokens as numbers of its (state, word) pairs, these pairs, the order in which they go to the ranges, and
    each range's part of it."""
    frequent, clusters, split = shared
    tokens, first, words = _read_planes(row["tokens"]), _read(row["first"]), _chunk_words(row)
    state = _states(tokens, first, _marker(words, frequent, clusters))
    n = len(words)
    joint, which = np.unique(state * np.int32(n) + tokens if n < 1 << 26 else state.astype(np.int64) * n + tokens, return_inverse=True)
    states, mine = joint.astype(np.int64) // n, joint.astype(np.int64) % n
    words.level, part = _dealt(words, split, ranges)
    pairs, part = words.take(mine), part[mine]
    pairs.states = states
    order = np.argsort(part, kind="stable")
    return first, which, pairs, order, np.searchsorted(part[order], np.arange(ranges + 1))


def _pair_sums(chunks: DataFrame, ranges: int, shared, model: Model) -> DataFrame:
    """One row per range: its distinct (state, word) pairs with their training counts, how many words are known and their
    tokens, and for every chunk that sent pairs their numbers among the distinct ones, in the order sent."""

    def parts(batches):
        for row in _rows(batches):
            first, which, pairs, order, cut = _chunk_pairs(row, shared.value, ranges)
            taught = ~np.repeat(np.array(row["held"], bool), np.diff(first))
            counts = np.bincount(which[taught], minlength=len(pairs))
            for r in np.flatnonzero(np.diff(cut)).tolist():
                mine = order[cut[r] : cut[r + 1]]
                yield pa.RecordBatch.from_pydict({"r": [r], "chunk": [row["chunk"]], "counts": [_ints(counts[mine])], **pairs.take(mine).packed()})

    def add(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        every = [Words.of(x) for x in rows]
        starts = np.cumsum([0, *(x.first[-1] for x in every)])
        words = Words(
            np.concatenate([x.data for x in every]), np.concatenate([[0], *(x.first[1:] + at for x, at in zip(every, starts))]),
            np.concatenate([x.states for x in every]), np.concatenate([x.level for x in every]),
        )
        counts = np.concatenate([_read(x["counts"]) for x in rows])
        hashes = words.beginnings(None, np.arange(len(words)))
        _, at, which = np.unique(mix(hashes + words.states.astype(np.uint64) * _R), return_index=True, return_inverse=True)
        total = np.bincount(which, counts, len(at)).astype(np.int64)
        _, of = np.unique(hashes[at], return_inverse=True)
        sizes = np.cumsum([0, *map(len, every)])
        made = {
            "r": [rows[0]["r"]], **words.take(at).packed(), "counts": [_ints(total)], "known": [int((np.bincount(of, total) > 0).sum())], "tokens": [int(total.sum())],
            "chunks": pa.array([[x["chunk"] for x in rows]], pa.list_(pa.binary())), "sent": pa.array([[_ints(which[a:b]) for a, b in zip(sizes, sizes[1:])]], pa.list_(pa.binary())),
        }
        return pa.table(made)

    split = chunks.select("chunk", "tokens", "first", "held", "lengths", "data").mapInArrow(parts, "r long, chunk binary, counts binary, data binary, lengths binary, codes binary")
    return split.groupBy("r").applyInArrow(add, "r long, data binary, lengths binary, codes binary, counts binary, known long, tokens long, chunks array<binary>, sent array<binary>")


def _counters(pairs: DataFrame, learned: Learned, model: Model) -> list[np.ndarray]:
    """The counters of the shared contexts, two bytes a slot."""
    shared = pairs.sparkSession.sparkContext.broadcast(learned)
    span = 1 << 15

    tasks = pairs.rdd.getNumPartitions()
    salts = max(1, math.isqrt(tasks))  # so many tasks' parts are added up first, then so many sums

    def count(batches):
        task = TaskContext.get().partitionId()
        tables = [np.zeros(2 << s, np.int64) for s in model.slots]
        for row in _rows(batches):
            counts = _read(row["counts"])
            for bit, _, owner, slots, _ in decisions(Words.of(row), shared.value, model, 1 << 15, range(SHARED)):
                weight = counts[owner]
                for t, s in zip(tables, slots):
                    np.add.at(t, s * 2 + bit, weight)
        for k, t in enumerate(tables):
            for at in range(0, len(t), 2 * span):
                part = t[at : at + 2 * span]
                if part.any():
                    yield pa.RecordBatch.from_pydict({"k": [k], "at": [at // 2], "salt": [task % salts], "size": [len(part)], "cells": [_cells(part)]})

    def add(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        total = np.zeros(max(x["size"] for x in rows), np.int64)
        for x in rows:
            total += _read_cells(x["cells"], x["size"])
        return pa.table({"k": pa.array([rows[0]["k"]], pa.int64()), "at": [rows[0]["at"]], "salt": [0], "size": [len(total)], "cells": [_cells(total)]})

    cells = "k long, at long, salt long, size long, cells binary"
    sums = pairs.select("data", "lengths", "codes", "counts").mapInArrow(count, cells)
    if salts > 4:
        sums = sums.groupBy("k", "at", "salt").applyInArrow(add, cells)
    sums = sums.groupBy("k", "at").applyInArrow(add, cells)
    tables = [np.zeros(1 << s, np.uint16) for s in model.slots]
    for r in sums.toLocalIterator():  # the tables' fixed size in all
        part = _read_cells(bytes(r["cells"]), r["size"])
        tables[r["k"]][r["at"] : r["at"] + r["size"] // 2] = encode_counts(part[::2], part[1::2])
    return tables


def _fitted(pairs: DataFrame, tables, learned: Learned, model: Model) -> Learned:
    """Weights learned online in each range and averaged by tokens; the refinement from all ranges' sums."""
    shared = pairs.sparkSession.sparkContext.broadcast((tables, learned))

    def learn(batches):
        tables, learned = shared.value
        luts = Logits.of(model.smooth)
        for row in _rows(batches):
            counts = _read(row["counts"])
            taught = np.flatnonzero(counts)
            words, counts = Words.of(row).take(taught), counts[taught]
            both = [*tables, *own_tables(words, counts, learned, model)]
            weights, weight_sum, steps = start_weights(), np.zeros((GATES, ORDERS + 1)), 0
            ones, alls = np.zeros(GATES * _BUCKETS), np.zeros(GATES * _BUCKETS)
            squares = np.full((GATES, ORDERS + 1), 1e-3)
            for bit, at, owner, slots, own in decisions(words, learned, model, model.step_bytes):
                times = counts[owner].astype(np.float64)
                left = [code.astype(np.int64) + (bit.astype(np.int64) << 16) for code in _codes(both, slots, own)]  # without its own occurrence
                values = [luts.less[x] for x in left]
                gate = gated([luts.left[x] for x in left], at)
                logit = mixed(values, gate, weights)
                p = 1 / (1 + np.exp(-logit))
                where = bucket_of(logit, gate)
                ones += np.bincount(where, times * bit, len(ones))
                alls += np.bincount(where, times, len(alls))
                error = (bit - p) * times
                mass = np.bincount(gate, times, GATES) + 1e-9
                for k in range(ORDERS + 1):
                    g = np.bincount(gate, error * values[k] if k < ORDERS else error, GATES) / mass
                    squares[:, k] += g * g
                    weights[:, k] += model.rate * 10 * g / np.sqrt(squares[:, k]) * (mass > 1)
                weight_sum += weights
                steps += 1
            if steps:
                yield pa.RecordBatch.from_pydict({"tokens": [float(counts.sum())], "weights": [(weight_sum / steps).ravel().tolist()], "ones": [ones.tolist()], "alls": [alls.tolist()]})

    found = pairs.select("data", "lengths", "codes", "counts").mapInArrow(learn, "tokens double, weights array<double>, ones array<double>, alls array<double>")
    cells = found.select("tokens", F.posexplode(F.arrays_zip(F.expr("concat(weights, array_repeat(0D, greatest(0, size(ones) - size(weights))))").alias("w"), "ones", "alls")).alias("i", "x"))
    sums = cells.groupBy("i").agg((F.sum(F.col("x.w") * F.col("tokens")) / F.sum("tokens")).alias("w"), F.sum("x.ones").alias("ones"), F.sum("x.alls").alias("alls")).collect()  # one row per refined cell
    weights, refine = start_weights().ravel(), 1 / (1 + np.exp(-(np.tile(np.arange(_BUCKETS) - _BUCKETS // 2, GATES) / 3.0)))
    for r in sums:
        if r["i"] < len(weights):
            weights[r["i"]] = r["w"]
        refine[r["i"]] = (r["ones"] + 20 * refine[r["i"]]) / (r["alls"] + 20)
    return Learned(learned.code, learned.code_bits, learned.nodes, weights.reshape(GATES, ORDERS + 1), np.clip(refine, 1e-6, 1 - 1e-6))


def scores(docs: DataFrame, model: Model = Model(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte."""
    spark = docs.sparkSession
    slim = docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text"))
    chunks = keep(_chunked(slim, model), "chunks")
    with rows_per_batch(spark, 1):  # a chunk's row is some megabytes
        found = keep(_scored(chunks, model, slim.schema["doc_id"].dataType.simpleString()), "scores")
    drop(chunks)
    return found


def _scored(chunks: DataFrame, model: Model, kind: str) -> DataFrame:
    """Learns from the chunks and scores them."""
    spark = chunks.sparkSession
    n_chunks, words = chunks.agg(F.count("*"), F.coalesce(F.sum("words"), F.lit(0))).first()
    ranges = max(1, -(-words // model.range_words))
    top = chunks.select(F.explode("top").alias("x")).groupBy("x.hash").agg(F.sum("x.c").alias("c")).orderBy(F.desc("c"), "hash").limit(model.frequent).collect()
    frequent = np.array([r["hash"] for r in top], dtype=np.int64).view(np.uint64)
    seen = chunks.select("seen").mapInArrow(_byte_sums, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect()  # 256 rows
    bytes_seen = np.zeros(256, np.int64)
    for r in seen:
        bytes_seen[r["b"]] = r["n"]
    learned = prefix_code(bytes_seen)
    clusters = _clusters(_transitions(chunks, frequent), model.states)
    dealing = spark.sparkContext.broadcast((frequent, clusters, _split_beginnings(chunks, words, n_chunks, model)))
    pairs = keep(_pair_sums(chunks, ranges, dealing, model), "pairs")
    ends = pairs.agg(F.sum("known"), F.sum("tokens")).first()
    vocabulary, total = ends[0] or 0, ends[1] or 0
    tables = _counters(pairs, learned, model)
    shared = spark.sparkContext.broadcast((tables, _fitted(pairs, tables, learned, model)))

    def answer(batches):
        tables, learned = shared.value
        luts = Logits.of(model.smooth)
        for row in _rows(batches):
            words, counts = Words.of(row), _read(row["counts"])
            logs = log10_words(words, [*tables, *own_tables(words, counts, learned, model)], learned, model, luts).astype("<f4")
            _, of = np.unique(words.beginnings(None, np.arange(len(words))), return_inverse=True)
            c = np.bincount(of, counts)[of].astype(np.int64)
            for chunk, sent in zip(row["chunks"], row["sent"]):
                which = _read(sent)
                yield pa.RecordBatch.from_pydict({"chunk": [chunk], "r": [row["r"]], "logs": [logs[which].tobytes()], "sums": [_ints(c[which])]})

    answers = pairs.drop("known", "tokens").mapInArrow(answer, "chunk binary, r long, logs binary, sums binary")
    replies = answers.groupBy("chunk").agg(F.collect_list(F.struct("r", "logs", "sums")).alias("replies"))  # as many pairs as the chunk has
    joined = chunks.drop("seen", "words", "top").join(replies, "chunk")

    def run(batches):
        for row in _rows(batches):
            first, which, pairs, order, cut = _chunk_pairs(row, dealing.value, ranges)
            c, logs = np.zeros(len(pairs)), np.zeros(len(pairs))
            for x in row["replies"]:
                mine = order[cut[x["r"]] : cut[x["r"] + 1]]
                c[mine], logs[mine] = _read(x["sums"]), np.frombuffer(x["logs"], "<f4")
            per = lambda x: np.add.reduceat(x[which], first[:-1]) if len(first) > 1 else np.zeros(0)
            n_bytes, score = per(np.diff(pairs.first)), per(logs)
            arrays = [
                pa.array(row["ids"], pa_type), pa.array(row["held"], pa.bool_()), pa.array(np.diff(first)), pa.array(per((c > 0).astype(np.int64))),
                pa.array(np.full(len(first) - 1, total, np.int64)), pa.array(per(np.log10((c + 0.5) / (total + 0.5 * (vocabulary + 1))))), pa.array(score), pa.array(n_bytes), pa.array(-score / np.log10(2) / n_bytes),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"])

    pa_type = to_arrow_type(chunks.schema["ids"].dataType.elementType)
    return joined.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double")


def _byte_sums(batches):
    total = np.zeros(256, np.int64)
    for row in _rows(batches):
        total += _read(row["seen"])
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(256), pa.int64()), pa.array(total)], names=["b", "n"])
