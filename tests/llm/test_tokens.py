import json
import zlib

import numpy as np
import pyarrow as pa
import pytest

from attestor.llm import pfor, tokencount

from tests.llm.cases import clashing, edge_docs, empty_docs

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")

#: White space of every kind, contractions, added tokens' strings, broken marks, composed and decomposed letters.
ODD = [
    None, "", " ", "  ", "\n", " \n a", "a  b\n\nc\t\td \n e  ", "  lead", "a\x0bb\x1cc d e x́ ́y", "It's DON'T we'll 12345 ½ ²",
    "<|endoftext|> hi  <|endoftext|>x", "<|startoftext|>", "<|endoftext|", "ÉTUDE étude étude 中文 \U0001f642\U0001f642", "a  b  c", "x\n y\n\n  z",
    "foo</w> bar", "K ſ \x85 ", "word.' word'. (a). 'tis 's.", "İstanbul ΟΔΟΣ Σ", "tail \n", "tail\t ", "a,.b ..c d.,", "\r\n\r\n x\r\n",
]


def test_counts_equal_the_library(spark):
    text = tokencount.tokenizer_text(WORDS)
    library = tokencount.loaded(text)
    docs = clashing(edge_docs(spark)).unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"), allowMissingColumns=True)
    docs = docs.unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), allowMissingColumns=True)
    got = sorted(map(tuple, tokencount.token_counts(docs, WORDS, 100).collect()), key=str)
    want = []
    for r in docs.select("doc_id", "text").collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        want.append((r.doc_id, len((r.text or "").encode()), n, n > 100))
    assert got == sorted(want, key=str)
    assert tokencount.token_counts(empty_docs(spark), WORDS, 1).count() == 0


def test_proved_strings_are_single_tokens():
    text = tokencount.tokenizer_text(WORDS)
    whole = tokencount.proved_whole(text)
    library = tokencount.loaded(text)
    assert len(whole) > 30_000 and all(len(e.ids) == 1 for e in library.encode_batch(whole[::50], add_special_tokens=False))


def test_encoder_equals_the_library():
    encoder = pfor.Encoder(tokencount.tokenizer_text(BYTES), remembered=20)
    for column in (pa.array(ODD), pa.array(ODD[::-1])):
        ids, offsets = encoder.encode(column)
        for i, text in enumerate(column.to_pylist()):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, text


def test_ranks_are_used_only_where_they_are_proved():
    spec = json.loads(tokencount.tokenizer_text(BYTES))
    library = tokencount.loaded(json.dumps(spec))
    ranks = pfor.same_merges(spec, library)
    assert len(ranks) >= 50_000
    for key, value in (("pre_tokenizer", None), ("normalizer", {"type": "NFC"}), ("pre_tokenizer", spec["pre_tokenizer"] | {"add_prefix_space": True})):
        assert pfor.same_merges(spec | {key: value}, library) is None
    for key, value in (("dropout", 0.1), ("ignore_merges", True), ("merges", spec["model"]["merges"][::-1])):
        assert pfor.same_merges(spec | {"model": spec["model"] | {key: value}}, library) is None
    # without its merge a token cannot be made: it is no rank, and words come out as the library has them
    fewer = spec | {"model": spec["model"] | {"merges": [m for m in spec["model"]["merges"] if "".join(m) != "the"]}}
    assert b"the" not in pfor.same_merges(fewer, tokencount.loaded(json.dumps(fewer)))


@pytest.mark.parametrize("proved", [True, False])
def test_words_equal_the_library_either_way(proved):
    text = tokencount.tokenizer_text(BYTES)
    encoder = pfor.Encoder(text if proved else text.replace('"ignore_merges": false', '"ignore_merges": true').replace('"ignore_merges":false', '"ignore_merges":true'))
    assert bool(encoder.ranked) == proved
    rng = np.random.default_rng(1)
    words = ["".join(chr(c) for c in rng.choice([*range(33, 127), 233, 223, 0x4E2D, 0x1F642, 0x301], rng.integers(1, 12))) for _ in range(5000)]
    column = pa.array([" ".join(words[i : i + 50]) for i in range(0, 5000, 50)])
    ids, offsets = encoder.encode(column)
    for i, t in enumerate(column.to_pylist()):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    layout = pfor.Layout(block=256)
    for n in (1, 5, 255, 256, 257, 3000):
        for high in (1, 2, 50_000, 2**32 - 1):
            ids = rng.integers(0, high, n).astype(np.uint32)
            ids[: n // 20] = rng.integers(0, 2**32 - 1, n // 20)
            assert (np.concatenate([pfor.unpack_block(b) for b in pfor.pack_blocks(ids, layout)]) == ids).all()


def test_outliers_become_exceptions():
    ids = np.full(1024, 7, np.uint32)
    ids[3] = 2**31
    assert len(pfor.pack_blocks(ids, pfor.Layout())[0]) == 11 + 6


@pytest.mark.parametrize("file_ids", [500, 10**7])
def test_files_round_trip(spark, file_ids):
    docs = clashing(edge_docs(spark)).unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"), allowMissingColumns=True)
    library = tokencount.loaded(tokencount.tokenizer_text(BYTES))
    manifest = pfor.write_tokens(docs, BYTES, pfor.Layout(block=64, file_ids=file_ids))
    got = sorted(pfor.read_tokens(manifest).collect(), key=lambda r: r.start)
    rows = []
    for r in docs.select("doc_id", "text").collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2])
        rows.append((r.doc_id is not None, r.doc_id or 0, ids.astype("<u2").tobytes(), ids))
    rows.sort(key=lambda x: x[:3])
    start = 0
    for r, (known, doc, _, ids) in zip(got, rows, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc if known else None, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
        start += len(ids)


def test_no_rows_no_files(spark):
    assert pfor.read_tokens(pfor.write_tokens(empty_docs(spark), BYTES)).count() == 0


def test_very_long_texts_and_repeated_ids(spark):
    rows = [(1, "one"), (1, "two words"), (None, "x"), (2, "abc" * 350_000), (3, "some words of a long text. " * 60_000)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    library = tokencount.loaded(tokencount.tokenizer_text(BYTES))
    got = sorted(pfor.read_tokens(pfor.write_tokens(docs, BYTES)).collect(), key=lambda r: r.start)
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == sorted((i is not None, i or 0) for i, _ in rows)
    sums = {zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for _, t in rows}
    assert {r.ids_crc32 for r in got} == sums
    words = tokencount.loaded(tokencount.tokenizer_text(WORDS))
    counts = sorted((r.n_bytes, r.n_tokens) for r in tokencount.token_counts(docs, WORDS, 100).collect())
    assert counts == sorted((len(t), len(words.encode(t, add_special_tokens=False).ids)) for _, t in rows)


def test_files_ascend_with_the_ids_and_a_frequent_id_has_several():
    rng = np.random.default_rng(5)
    ids = np.sort(np.concatenate([rng.integers(-(2**40), 2**40, 6000), np.full(3000, 77), np.full(1000, -(2**63))]))
    for quantiles, between in ((20, 1), (20, 4), (1, 1), (4, 50)):
        cuts = ids[[i * len(ids) // quantiles for i in range(1, quantiles)]]
        parts = pfor.parts_of(ids, rng.integers(0, 2**32, len(ids)), cuts, between)
        known = np.unique(ids[ids != 77])
        assert (np.diff(parts[ids != 77]) >= 0).all()
        if quantiles > 4:
            hot = parts[ids == 77]
            assert len(set(hot.tolist())) >= 3 * between and parts[ids < 77].max() <= hot.min() and hot.max() <= parts[ids > 77].min()
            assert len(set(parts.tolist())) >= 0.6 * quantiles * between
        assert len(known) > 5000
    assert pfor.parts_of(np.array([5, 6]), np.zeros(2, np.int64), np.array([], np.int64), 1).tolist() == [0, 0]


def test_many_rows_of_one_id_round_trip(spark):
    rows = [(7 if i % 3 else i, f"text number {i} of some words") for i in range(3000)] + [(None, f"none {i}") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = pfor.write_tokens(docs, BYTES, pfor.Layout(block=64, file_ids=500))
    got = sorted(pfor.read_tokens(manifest).collect(), key=lambda r: r.start)
    library = tokencount.loaded(tokencount.tokenizer_text(BYTES))
    assert [-1 if r.doc_id is None else r.doc_id for r in got] == sorted(-1 if i is None else i for i, _ in rows)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    crc = lambda t: zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids_crc32) for r in got) == sorted((i is not None, i or 0, crc(t)) for i, t in rows)
    assert manifest.where("n_docs > 0").count() > 10
