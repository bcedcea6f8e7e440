"""Token ids in files of patched frame-of-reference blocks.

File: magic, block size, then blocks, then an index (start of every block; id and first token of every document), then
the index's place and magic again.  A block of ids holds its minimum, a bit width, the ids less the minimum in that many
bits each, and an exception list: place and full difference of each id that needs more bits.  The width is the least
that fits ``percentile`` of the block's differences.  All numbers are little-endian.

Ranges of doc_id, one per file, are set from its quantiles: a thousand at most, between which further files share the
numbers evenly.  An id that spans whole quantiles has their files to itself, dealt by a checksum of the document's ids.
Documents are encoded (each distinct piece of text once per chunk) and dealt out by range; a task sorts its ranges and writes
a file for each, which appears only when whole.  A manifest row per file gives the ids before it.

Defined results: a null or empty text is the end id alone; null ids come first; documents with equal doc_id lie side by
side, ordered by their ids' bytes (within a file, where they fill several); a very long text is one document of many blocks; other columns are ignored whatever their names;
an empty table writes no file and gives an empty result.
"""

from __future__ import annotations

import json
import struct
import zlib
from itertools import accumulate, chain, groupby
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, Window, functions as F

from attestor.llm.files import opened, whole_file
from attestor.llm.frames import fresh_path, keep, map_chunks
from attestor.llm.text import SPACES, Texts, space_words, word_hashes
from attestor.llm.tokencount import byte_alphabet, loaded, once, tokenizer_text

MAGIC = b"PFORTOK1"
#: White space of the tokenizer's pattern beyond ASCII; texts with any are left to the library whole.
OTHER_SPACE = "[\u0085   -     　]"

#: The pattern by which a byte-level pre-tokenizer cuts (a fixed value of such vocabularies).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words encoded in one call.
_TOGETHER = 512
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(SPACES)] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b".,;:!?)")] = True
_ASCII_ALNUM = np.zeros(256, dtype=bool)
_ASCII_ALNUM[48:58] = _ASCII_ALNUM[65:91] = _ASCII_ALNUM[97:123] = True


@dataclass(frozen=True)
class Layout:
    block: int = 1024
    percentile: float = 0.9
    #: Ids in a file, about.
    file_ids: int = 4_000_000
    end_id: int = 2


def _cut(ids: np.ndarray, ends) -> list[bytes]:
    raw, ends = ids.tobytes(), [4 * n for n in ends]
    return [raw[a:b] for a, b in zip(ends, ends[1:])]


# ---- encoding -------------------------------------------------------------------------------------------------


def same_merges(spec: dict, tokenizer) -> dict[bytes, int] | None:
    """The ranks (bytes of a token: its id) by which merging the pair of least rank gives the library's ids for every text, or
    None where that is not proved.

    The tokenizer must be byte-level BPE with nothing before or after, cut by PATTERN, with all single bytes and with ids that
    ascend in the order of the merges.  Tokens that the library's model does not give for their own string are left out.  Then
    both merge alike: they could differ only where two neighbours make a token t that is no listed pair (or the other way
    round) while no merge has yet crossed t's borders; but then the library, alone on t's string, would stand at the same two
    neighbours and could not give t.
    """
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or spec.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        return None
    vocabulary, alphabet = model["vocab"], byte_alphabet()
    merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(a >= b for a, b in zip(merged, merged[1:])) or any(c not in vocabulary for c in alphabet):
        return None
    if merged and max(vocabulary[c] for c in alphabet) >= merged[0]:
        return None
    special = {x["content"] for x in spec.get("added_tokens", [])}
    alone = (x for x in vocabulary if x not in special and all(c in alphabet for c in x) and [t.id for t in tokenizer.model.tokenize(x)] == [vocabulary[x]])
    return {bytes(alphabet[c] for c in x): vocabulary[x] for x in alone}


class Encoder:
    """Ids of whole texts by a byte-level tokenizer, each distinct piece of a chunk encoded once.

    Pieces are words with the one blank before them, and runs of white space less that blank; where a run does not end in
    a blank its last character is a piece of its own.  One stop, comma or the like that ends a word after an ASCII letter
    or digit is a piece of its own too.  The tokenizer's pattern never matches across these borders.

    The ids are the tokenizers library's.  Texts with an added token's string or other white space and runs of white space
    go through it; words go joined by line feeds, some hundreds a call: a line feed before a word or blank is always a token
    of its own and never part of a word's.  Where ``same_merges`` proves that merging by rank gives the same ids, words are
    merged so, which is twice as fast; else the library merges them.
    """

    def __init__(self, text: str, remembered: int = 300_000):
        self.tokenizer = loaded(text)
        spec = json.loads(text)
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        ranks = same_merges(spec, self.tokenizer)
        self.ranked = ranks and tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        (self.feed,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.remembered = remembered
        self.memo: dict[int, bytes] = {}

    def _encode(self, strings: list[str]) -> list[bytes]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
        return _cut(np.fromiter(chain.from_iterable(found), "<u4"), accumulate(map(len, found), initial=0))

    def _encode_words(self, words: list[bytes]) -> list[bytes]:
        """Words hold no line feed and no white space but one leading blank."""
        out: list[bytes] = []
        parts = ["\n" + b"\n".join(words[i : i + _TOGETHER]).decode() for i in range(0, len(words), _TOGETHER)]
        if self.ranked:
            found = (self.ranked.encode_to_numpy(part, disallowed_special=()).astype("<u4", copy=False) for part in parts)
        else:
            found = (np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False))
        for ids in found:
            feeds = np.flatnonzero(ids == self.feed)
            # the feeds go; word k begins k + 1 ids earlier than behind its feed
            out += _cut(ids[ids != self.feed], (*(feeds - np.arange(len(feeds))).tolist(), len(ids) - len(feeds)))
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the texts' offsets among them."""
        column = pc.fill_null(column, "").cast(pa.large_string())
        odd = pc.match_substring_regex(column, OTHER_SPACE).to_numpy(zero_copy_only=False).copy()
        for s in self.special:
            odd |= pc.match_substring(column, s).to_numpy(zero_copy_only=False)
        whole = {}
        if odd.any():
            at = np.flatnonzero(odd)
            whole = dict(zip(at.tolist(), self._encode(column.take(pa.array(at)).to_pylist())))
            column = pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), column)
        ids, offsets = self._pieces(Texts.of(column))
        if whole:
            parts = [np.frombuffer(whole[i], "<u4") if i in whole else ids[offsets[i] : offsets[i + 1]] for i in range(len(column))]
            ids, offsets = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, offsets

    def _pieces(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        words = space_words(texts)
        data, n = texts.data, words.n
        owner = words.owner()
        left, right = texts.offsets[:-1], texts.offsets[1:]
        # the gap before each word reaches back to the word before it or to the text's start
        gap = np.concatenate([[0], words.end[:-1]]) if n else np.empty(0, np.int64)
        gap = np.maximum(gap, left[owner]) if n else gap
        blank = (words.start > gap) & (data[np.maximum(words.start - 1, 0)] == 32)
        start = words.start - blank
        lone = (start > gap) & ~blank  # the run ends in another white space: its last character stands alone
        run_end = start - lone
        has_run = run_end > gap
        last = np.where(words.first[1:] > words.first[:-1], words.end[np.maximum(words.first[1:] - 1, 0)] if n else 0, left)
        tail = right > last
        marked = (words.end - words.start > 1) & _MARK[data[words.end - 1]] & _ASCII_ALNUM[data[np.maximum(words.end - 2, 0)]]
        end = words.end - marked
        begin = np.concatenate([gap[has_run], run_end[lone], start, end[marked], last[tail]])
        stop = np.concatenate([run_end[has_run], start[lone], end, words.end[marked], right[tail]])
        whose = np.concatenate([owner[has_run], owner[lone], owner, owner[marked], np.flatnonzero(tail)])
        order = np.argsort(begin, kind="stable")
        begin, stop, whose = begin[order], stop[order], whose[order]
        hashes = word_hashes(texts, type(words)(begin, stop, np.array([0, len(begin)])))
        keys, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        listed = keys.tolist()
        if len(self.memo) + len(listed) > self.remembered:
            self.memo.clear()
        new = np.array([i for i, k in enumerate(listed) if k not in self.memo], dtype=np.int64)
        raw = data.tobytes()
        spaced = _SPACE[data[stop[first[new]] - 1]]  # a piece that ends in white space is all white space
        for part, run in ((new[~spaced], self._encode_words), (new[spaced], lambda x: self._encode([y.decode() for y in x]))):
            self.memo.update(zip((listed[i] for i in part.tolist()), run([raw[i:j] for i, j in zip(begin[first[part]].tolist(), stop[first[part]].tolist())])))
        pieces = [self.memo[k] for k in listed]
        flat = np.frombuffer(b"".join(pieces), "<u4")
        lengths = np.fromiter((len(p) // 4 for p in pieces), np.int64, len(pieces))
        at = np.cumsum(lengths) - lengths
        per = lengths[which]
        total = np.concatenate([[0], np.cumsum(per)])
        ids = flat[np.arange(total[-1]) - np.repeat(total[:-1] - at[which], per)] if len(per) else flat
        return ids, total[np.searchsorted(whose, np.arange(texts.n + 1))]


#: What a null doc_id counts as.
_NULL = -(2**63)
#: Most quantiles of doc_id that are asked for.
_QUANTILES = 1000


def parts_of(ids: np.ndarray, sums: np.ndarray, cuts: np.ndarray, between: int) -> np.ndarray:
    """The file of each document, ascending with its id; cuts: ascending quantiles, each the first id of a new range;
    between: the files of a range; sums: checksums, by which the documents of an id that fills whole ranges are dealt."""
    left, right = np.searchsorted(cuts, ids, side="left"), np.searchsorted(cuts, ids, side="right")
    edges = np.concatenate([[cuts[0] if len(cuts) else 0], cuts, [cuts[-1] if len(cuts) else 0]]).astype(np.float64)
    low, high = edges[right], edges[np.minimum(right + 1, len(edges) - 1)]
    share = np.divide(ids - low, high - low, out=np.zeros(len(ids)), where=high > low)  # the first and last range are not divided
    inner = (right > 0) & (right < len(cuts))
    part = right * between + np.where(inner, np.clip(np.floor(share * between), 0, between - 1), 0).astype(np.int64)
    whole = (right - left - 1) * between  # files of ranges that hold this id alone
    return np.where(whole > 0, (left + 1) * between + sums % np.maximum(whole, 1), part)


def encoded(docs: DataFrame, path: str, layout: Layout, cuts: list[int], between: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: its file, doc_id, n_tokens with the end id, ids (little-endian, 2 bytes each if all fit, else 4)."""
    shared = docs.sparkSession.sparkContext.broadcast((tokenizer_text(path), np.array(cuts, dtype=np.int64)))  # the vocabulary file, and some numbers
    slim = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))

    def rows(part: pa.RecordBatch) -> pa.RecordBatch:
        text, borders = shared.value
        encoder = once(Encoder, text)
        ids, offsets = encoder.encode(part.column(1))
        n = part.num_rows
        out = np.empty(len(ids) + n, dtype="<u4")
        ends = offsets[1:] + np.arange(n)
        mask = np.ones(len(out), dtype=bool)
        mask[ends] = False
        out[mask] = ids
        out[ends] = layout.end_id
        narrow = out.astype("<u2") if encoder.tokenizer.get_vocab_size() <= 65536 else out
        cuts = np.concatenate([[0], ends + 1])
        raw, size = narrow.tobytes(), narrow.itemsize
        values = pa.array([raw[a * size : b * size] for a, b in zip(cuts, cuts[1:])], pa.binary())
        known = pc.fill_null(part.column(0), _NULL).to_numpy(zero_copy_only=False)
        sums = np.fromiter((zlib.crc32(x) for x in values.to_pylist()), np.int64, n) if len(np.unique(borders)) < len(borders) else np.zeros(n, np.int64)
        files = parts_of(known, sums, borders, between)
        return pa.RecordBatch.from_arrays([pa.array(files), part.column(0), pa.array(np.diff(cuts)), values], names=["part", "doc_id", "n_tokens", "ids"])

    return map_chunks(slim, rows, "part long, doc_id long, n_tokens long, ids binary", limit=4 << 20)


# ---- blocks ---------------------------------------------------------------------------------------------------


def _bits(values: np.ndarray) -> np.ndarray:
    return np.where(values > 0, np.floor(np.log2(np.maximum(values, 1))).astype(np.int64) + 1, 0)


def pack_blocks(ids: np.ndarray, layout: Layout) -> list[bytes]:
    """The blocks' bytes; the last block may be shorter."""
    out: list[bytes] = []
    full = len(ids) // layout.block
    for at in range(0, full, 512):
        out.extend(_pack(ids[at * layout.block : min(full, at + 512) * layout.block].reshape(-1, layout.block), layout))
    if len(ids) % layout.block:
        out.extend(_pack(ids[full * layout.block :].reshape(1, -1), layout))
    return out


def _pack(blocks: np.ndarray, layout: Layout) -> list[bytes]:
    count, size = blocks.shape
    least = blocks.min(1)
    over = (blocks - least[:, None]).astype(np.uint32)
    width = _bits(np.partition(over, max(0, int(np.ceil(layout.percentile * size)) - 1), axis=1)[:, max(0, int(np.ceil(layout.percentile * size)) - 1)].astype(np.int64))
    out: list[bytes] = [b""] * count
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        part = over[at]
        beyond = part >> np.uint32(w) != 0 if w < 32 else np.zeros_like(part, dtype=bool)
        bits = np.unpackbits(part.astype("<u4").view(np.uint8).reshape(len(at), size, 4), axis=2, bitorder="little")[:, :, :w]
        packed = np.packbits(bits.reshape(len(at), -1), axis=1, bitorder="little")
        for k, i in enumerate(at):
            places = np.flatnonzero(beyond[k])
            out[i] = struct.pack("<IIBH", least[i], size, w, len(places)) + packed[k].tobytes() + places.astype("<u2").tobytes() + part[k][places].astype("<u4").tobytes()
    return out


def unpack_block(data: bytes, at: int = 0) -> np.ndarray:
    least, size, w, n = struct.unpack_from("<IIBH", data, at)
    at += 11
    length = -(-size * w // 8)
    bits = np.unpackbits(np.frombuffer(data, np.uint8, length, at), bitorder="little", count=size * w).reshape(size, w) if w else np.zeros((size, 0), np.uint8)
    wide = np.zeros((size, 32), dtype=np.uint8)
    wide[:, :w] = bits
    over = np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()
    at += length
    over[np.frombuffer(data, "<u2", n, at)] = np.frombuffer(data, "<u4", n, at + 2 * n)
    return over + np.uint32(least)


class Writer:
    """Writes one file; add() documents in order, then close()."""

    def __init__(self, out, layout: Layout):
        self.out, self.layout, self.at = out, layout, 0
        self.starts, self.docs, self.firsts, self.ids = [], [], [], 0
        self.held: list[np.ndarray] = []
        self.held_ids = 0
        self._write(MAGIC + struct.pack("<I", layout.block))

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.firsts.append(self.ids)
        self.ids += len(ids)
        self.held.append(ids)
        self.held_ids += len(ids)
        if self.held_ids >= 256 * self.layout.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        cut = len(ids) if last else len(ids) // self.layout.block * self.layout.block
        for block in pack_blocks(ids[:cut], self.layout):
            self.starts.append(self.at)
            self._write(block)
        self.held, self.held_ids = [ids[cut:]], len(ids) - cut

    def close(self) -> None:
        self._flush(True)
        known = np.array([d is not None for d in self.docs], dtype=np.uint8)
        place = self.at
        self._write(struct.pack("<QQQ", len(self.starts), len(self.docs), self.ids))
        self._write(np.array(self.starts, "<u8").tobytes() + np.array([d or 0 for d in self.docs], "<i8").tobytes() + np.array(self.firsts, "<u8").tobytes() + known.tobytes())
        self._write(struct.pack("<Q", place) + MAGIC)


def read_file(file):
    """(doc_id or None, first, ids) of each document of an open file, block by block."""
    size = file.size()
    place, magic = struct.unpack("<Q8s", file.read_at(16, size - 16))
    if magic != MAGIC:
        raise ValueError("not a token file")
    index = file.read_at(size - 16 - place, place)
    n_blocks, n_docs, n_ids = struct.unpack_from("<QQQ", index)
    starts = np.append(np.frombuffer(index, "<u8", n_blocks, 24).astype(np.int64), place)
    docs = np.frombuffer(index, "<i8", n_docs, 24 + 8 * n_blocks).tolist()
    firsts = np.append(np.frombuffer(index, "<u8", n_docs, 24 + 8 * (n_blocks + n_docs)).astype(np.int64), n_ids).tolist()
    known = np.frombuffer(index, np.uint8, n_docs, 24 + 8 * (n_blocks + 2 * n_docs)).tolist()
    held, held_from, block = np.empty(0, np.uint32), 0, 0
    for doc, known_id, first, stop in zip(docs, known, firsts, firsts[1:]):
        if held_from + len(held) < stop:
            parts, have = [held[first - held_from :]], held_from + len(held)
            while have < stop:
                upto = min(block + 64, n_blocks)
                data = file.read_at(int(starts[upto] - starts[block]), int(starts[block]))
                for k in range(block, upto):
                    parts.append(unpack_block(data, int(starts[k] - starts[block])))
                    have += len(parts[-1])
                block = upto
            held, held_from = np.concatenate(parts), first
        yield doc if known_id else None, first, held[first - held_from : stop - held_from]


# ---- tables ---------------------------------------------------------------------------------------------------


def write_tokens(docs: DataFrame, path: str, layout: Layout = Layout(), folder: str | None = None) -> DataFrame:
    """Writes the files and returns their manifest: part, file, n_docs, n_ids, before (ids of all files before it)."""
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "tokens")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    files = max(1, -(-size // (4 * layout.file_ids)))  # four bytes a token, about
    ranges = min(files, _QUANTILES)
    between = -(-files // ranges)
    ids = F.coalesce(docs["doc_id"].cast("long"), F.lit(_NULL))
    cuts = docs.agg(F.percentile_approx(ids, [i / ranges for i in range(1, ranges)], 20 * _QUANTILES)).first()[0] if ranges > 1 else None
    rows = encoded(docs, path, layout, sorted(cuts or ()), between)
    ordered = rows.repartition(files, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "ids")

    def run(batches):
        rows = ((part, doc, n, ids) for batch in batches for part, doc, n, ids in zip(*(batch.column(k).to_pylist() for k in range(4))))
        for part, mine in groupby(rows, key=lambda r: r[0]):
            name = f"{folder}/part-{part:09d}.pfor"
            with whole_file(name) as out:
                made = Writer(out, layout)
                for _, doc, n, ids in mine:
                    made.add(doc, np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype(np.uint32))
                made.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "n_docs": [len(made.docs)], "n_ids": [made.ids]})

    manifest = keep(ordered.mapInArrow(run, "part long, file string, n_docs long, n_ids long"), "manifest")
    group = F.floor(F.col("part") / 1024).alias("group")
    earlier = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    groups = manifest.groupBy(group).agg(F.sum("n_ids").alias("n_ids")).select("group", earlier(Window.orderBy("group")).alias("start"))  # a row per 1024 files
    placed = manifest.withColumn("group", group).withColumn("within", earlier(Window.partitionBy("group").orderBy("part"))).join(groups, "group")
    return placed.select("part", "file", "n_docs", "n_ids", (F.col("start") + F.col("within")).alias("before"))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32."""
    files = manifest.select("file", "before").repartition(max(1, manifest.count()), "file")

    def run(batches):
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, path = opened(name)
                with system.open_input_file(path) as file:
                    found = [(doc, before + first, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for doc, first, ids in read_file(file)]
                cols = [pa.array(c, pa.int64()) for c in zip(*found)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
