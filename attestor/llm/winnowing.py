"""Benchmark decontamination by winnowing.

Words are lower-cased; an item's windows are its runs of ``window`` words, or all its words if it has fewer.
Of every k-gram window of ``window - k + 1`` hashes the least is a fingerprint, on both sides, so any shared run
of ``window`` words shares a fingerprint.  Where a document's fingerprint may be a benchmark's (a bit table of fixed
size tells), the hit is extended: the whole windows around it are hashed to 128 bits and those that may be a
benchmark's are joined with the benchmark's windows.  Items shorter than ``window`` words are looked up at every
position.  The words in joined windows are hit.

Nothing sent to all executors grows with either side: the two bit tables have 2 ** bits bits.  If a large benchmark
fills them, more rows reach the join and the result stays the same.

Defined results: null and empty texts have no words and no hits; an item without words is never found; a null item
id can be hit but is not listed; repeated items count once; repeated documents each get a row, rows with one id and
different texts too; very long texts are read whole; extra columns keep their values whatever their names; an empty table of
documents gives an empty result, an empty benchmark hits nothing.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from attestor.llm.frames import columns, keep, map_chunks, private, same_columns
from attestor.llm.text import Texts, alnum_words, inside_runs, mix, run_hashes, word_hashes

_SALT = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Winnow:
    window: int = 10
    k: int = 5
    bits: int = 22

    @property
    def grams(self) -> int:
        return self.window - self.k + 1


def _twin(hashes: np.ndarray, n: int) -> np.ndarray:
    """A second hash of runs of n words that does not follow from the first."""
    return run_hashes(mix(hashes ^ _SALT), n)


def _least(hashes: np.ndarray, winnow: Winnow) -> np.ndarray:
    """For the window from each word on, its fingerprint: the least k-gram hash within it."""
    grams = run_hashes(hashes, winnow.k)
    out = grams[: max(len(grams) - winnow.grams + 1, 0)].copy()
    for j in range(1, winnow.grams):
        np.minimum(out, grams[j : j + len(out)], out=out)
    return out


def fingerprints(items: DataFrame, winnow: Winnow, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """Distinct (h1, h2, n, item_id, fingerprint): an item's windows of n words; no fingerprint if n < window."""
    slim = items.select(items[id_column].alias("item_id"), items[text_column].alias("text"))
    kind = slim.schema["item_id"].dataType.simpleString()

    def rows(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = Texts.of(part.column(1)).lowered()
        words = alnum_words(texts)
        hashes = word_hashes(texts, words)
        at, owner = inside_runs(words, winnow.window)
        counts = np.diff(words.first)
        cols = [[run_hashes(hashes, winnow.window)[at]], [_twin(hashes, winnow.window)[at]], [np.full(len(at), winnow.window)], [owner], [_least(hashes, winnow)[at]]]
        for i in np.flatnonzero((counts > 0) & (counts < winnow.window)):
            own, n = hashes[words.first[i] : words.first[i + 1]], int(counts[i])
            for col, value in zip(cols, (run_hashes(own, n), _twin(own, n), np.array([n]), np.array([i]), np.zeros(1, np.uint64))):
                col.append(value)
        h1, h2, n, owner, least = (np.concatenate(c) for c in cols)
        arrays = [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(n.astype(np.int32)), part.column(0).take(pa.array(owner)), pa.array(least.view(np.int64), mask=n < winnow.window)]
        return pa.RecordBatch.from_arrays(arrays, names=["h1", "h2", "n", "item_id", "fingerprint"])

    return map_chunks(slim, rows, f"h1 long, h2 long, n int, item_id {kind}, fingerprint long").distinct()


def _bit_table(values: DataFrame, bits: int) -> np.ndarray:
    """2 ** bits bits, of which those are set that the column's values end in; at most so many numbers are read."""
    slots = values.select(F.col(values.columns[0]).bitwiseAND((1 << bits) - 1).alias("slot")).where("slot IS NOT NULL").distinct().toPandas()["slot"]
    table = np.zeros(1 << bits, dtype=np.uint8)
    table[slots.to_numpy(dtype=np.int64)] = 1
    return np.packbits(table, bitorder="little")


def _may_be(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & np.uint64(len(table) * 8 - 1)
    return (table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def suspects(docs: DataFrame, windows: DataFrame, winnow: Winnow, passing: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: its words, a row key if any window may be a benchmark's, and those windows (h1, h2, n, at); the
    names of these three are private(docs, "words", "key", "windows") if docs' columns are passing."""
    spark = docs.sparkSession
    short = sorted(r[0] for r in windows.where(F.col("n") < winnow.window).select("n").distinct().collect())  # under window numbers
    tables = spark.sparkContext.broadcast((_bit_table(windows.select("fingerprint"), winnow.bits), _bit_table(windows.select("h1"), winnow.bits)))
    slim = docs if passing else docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text"))
    index = slim.columns.index(text_column if passing else "text")
    own = private(slim, "words", "key", "windows")
    more = f"{own['words']} long, {own['key']} string, {own['windows']} array<struct<h1:long,h2:long,n:int,at:int>>"

    def rows(part: pa.RecordBatch) -> list[pa.Array]:
        first_bits, window_bits = tables.value
        texts = Texts.of(part.column(index)).lowered()
        words = alnum_words(texts)
        hashes = word_hashes(texts, words)
        found = []
        least = _least(hashes, winnow)
        at = np.flatnonzero(_may_be(first_bits, least))
        whose = np.searchsorted(words.first, at, side="right") - 1
        inside = at + winnow.window <= words.first[whose + 1]
        for n, at in [(winnow.window, at[inside]), *((n, inside_runs(words, n)[0]) for n in short)]:
            if not len(at):
                continue
            if n == winnow.window:  # only the runs at a hit are hashed
                h1, h2 = hashes[at].copy(), mix(hashes[at] ^ _SALT)
                for j in range(1, n):
                    h1 = mix(h1 * np.uint64(0x9E3779B97F4A7C15) ^ hashes[at + j])
                    h2 = mix(h2 * np.uint64(0x9E3779B97F4A7C15) ^ mix(hashes[at + j] ^ _SALT))
            else:
                h1, h2 = run_hashes(hashes, n)[at], _twin(hashes, n)[at]
            ok = _may_be(window_bits, h1)
            found.append((h1[ok], h2[ok], np.full(ok.sum(), n), at[ok]))
        h1, h2, n, at = (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 2
        owner = np.searchsorted(words.first, at, side="right") - 1
        order = np.argsort(owner, kind="stable")
        h1, h2, n, at, owner = (x[order] for x in (h1, h2, n, at, owner))
        offsets = np.searchsorted(owner, np.arange(texts.n + 1)).astype(np.int32)
        structs = pa.StructArray.from_arrays(
            [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(n.astype(np.int32)), pa.array((at - words.first[owner]).astype(np.int32))], names=["h1", "h2", "n", "at"]
        )
        keys = [uuid.uuid4().hex if b > a else None for a, b in zip(offsets, offsets[1:])]
        shown = part.columns if passing else [part.column(0), pa.nulls(part.num_rows, pa.string())]  # the text need not come back
        return [*shown, pa.array(np.diff(words.first)), pa.array(keys, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), structs)]

    found = same_columns(slim, rows, slim.columns[index], more)
    return found if passing else found.drop("text")


#: Words in the union of windows sorted by place, each a struct (at, n).
_COVERED = """aggregate(array_sort(spans), named_struct('reach', 0, 'total', 0L), (s, x) -> named_struct(
    'reach', greatest(s.reach, x.at + x.n),
    'total', s.total + greatest(0, x.at + x.n - greatest(s.reach, x.at))), s -> s.total)"""


def _hits(seen: DataFrame, windows: DataFrame) -> DataFrame:
    """(_key, n_hit, items) of the documents with a window of the benchmark."""
    maybe = seen.where("_key IS NOT NULL").select("_key", F.explode("_windows").alias("w")).select("_key", "w.*")
    spans = maybe.join(windows.select("h1", "h2", "n").distinct(), ["h1", "h2", "n"], "left_semi").groupBy("_key").agg(F.collect_set(F.struct("at", "n")).alias("spans"))
    items = (
        maybe.select("_key", "h1", "h2", "n").distinct().join(windows.select("h1", "h2", "n", "item_id"), ["h1", "h2", "n"])
        .groupBy("_key").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    return spans.withColumn("n_hit", F.expr(_COVERED)).select("_key", "n_hit").join(items, "_key")


def contamination(docs: DataFrame, benchmark: DataFrame, winnow: Winnow = Winnow()) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (ids found, as sorted strings), contaminated."""
    windows = keep(fingerprints(benchmark, winnow), "windows")
    seen = keep(suspects(docs, windows, winnow), "suspects")
    none = F.array().cast("array<string>")
    hit = seen.where("_key IS NOT NULL").drop("_windows").join(_hits(seen, windows), "_key", "left")
    rest = seen.where("_key IS NULL").drop("_windows").select("_key", *(c for c in hit.columns if c in ("doc_id", "_words")), F.lit(0).cast("long").alias("n_hit"), none.alias("items"))
    return hit.unionByName(rest).select(
        "doc_id", F.col("_words").alias("n_words"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", none).alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, winnow: Winnow = Winnow()) -> DataFrame:
    """The rows of docs without a benchmark window, with all their columns."""
    windows = keep(fingerprints(benchmark, winnow), "windows")
    seen = keep(suspects(docs, windows, winnow, passing=True), "suspects")
    own = private(docs, "words", "key", "windows")
    key = F.col(own["key"])
    hit = _hits(seen.select(key.alias("_key"), F.col(own["windows"]).alias("_windows")), windows).select(F.col("_key").alias(own["words"]))
    left = seen.where(key.isNotNull()).join(hit, seen[own["key"]] == hit[own["words"]], "left_anti")
    return seen.where(key.isNull()).select(*columns(docs)).unionByName(left.select(*columns(docs)))
