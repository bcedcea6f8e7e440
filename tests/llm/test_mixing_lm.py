import math
import zlib
from collections import Counter

import numpy as np
import pytest

from attestor.llm import mixing_lm as M

from tests.llm.cases import LOWER, SPACE_WORD, clashing, edge_docs, empty_docs

SMALL = M.Model(slots=(12, 12, 14, 14, 14), own_slots=14, chunk_bytes=3000, range_words=300)


def tokens_of(text):
    return [*SPACE_WORD.findall((text or "").translate(LOWER)), None]  # None: the end


def brute_base(rows):
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1 for i, _ in rows]
    counts = Counter(t for (_, x), h in zip(rows, held) if not h for t in tokens_of(x))
    n, v = sum(counts.values()), len(counts)
    out = []
    for (i, x), h in zip(rows, held):
        words = tokens_of(x)
        out.append((i, h, len(words), sum(counts[w] > 0 for w in words), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)))
    return sorted(out, key=str)


def check(docs, model):
    got = M.scores(docs, model).collect()
    want = brute_base([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    for r, w in zip(sorted(got, key=lambda r: str((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score))), want, strict=True):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:5] and r.base_score == pytest.approx(w[5])
        assert r.score < 0 and r.bits_per_byte == pytest.approx(-r.score / math.log10(2) / r.n_bytes)
    return got


def test_base_equals_brute_force_on_edges(spark):
    check(clashing(edge_docs(spark)), SMALL)


def test_model_beats_base_on_held_out_documents(spark):
    got = [r for r in check(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), M.Model()) if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def bytes_as_words():
    return M.Words(np.arange(256, dtype=np.uint8), np.arange(257), np.zeros(256, np.int64), np.zeros(256, np.int64))


def test_probabilities_of_all_words_sum_to_one():
    """Of all words of one byte, each without the rest of the word; so of all next bytes."""
    rng = np.random.default_rng(0)
    learned = M.prefix_code(rng.integers(0, 50, 256))
    learned.weights, learned.refine = rng.normal(0, 0.3, (M.GATES, M.ORDERS + 1)), rng.uniform(0.2, 0.8, M.GATES * M._BUCKETS)
    model = M.Model(slots=(8,) * M.SHARED, own_slots=8)
    tables = [M.encode_counts(rng.integers(0, 9, 1 << 8), rng.integers(0, 9, 1 << 8)) for _ in range(M.ORDERS)]
    logs = M.log10_words(bytes_as_words(), tables, learned, model, M.Logits.of(model.smooth))
    assert np.sum(10**logs) == pytest.approx(1.0, abs=1e-4)


def spelled(words, level=0):
    data = b"".join(words)
    return M.Words(np.frombuffer(data, np.uint8), np.cumsum([0, *map(len, words)]), np.arange(len(words)) % 3, np.full(len(words), level))


def brute_contexts(word, i, state, level):
    """The seven contexts of a byte: the state with up to 4 bytes before it, 6 bytes, and the word so far."""
    back = lambda k: word[max(0, i - k) : i]
    own = (word[:i], (state, word[:i])) if level < len(M.LEVELS) and i >= M.LEVELS[level] else (None, None)
    return [*((state, k, back(k)) for k in range(1, 5)), back(6), *own]


@pytest.mark.parametrize("level", [0, 1, len(M.LEVELS)])
def test_scores_equal_brute_force(level):
    """Counters by plain dictionaries, the mix by plain sums, with weights that tell the contexts apart."""
    rng = np.random.default_rng(1)
    words = [w.encode() + b" " for w in ("the", "then", "thesis", "stone", "stones", "étude", "x", "rivers", "river", "thesis")] + [M.END, b"long" * 40 + b" "]
    counts = np.array([9, 4, 0, 2, 1, 70, 3, 0, 5, 6, 12, 2])
    learned = M.prefix_code(rng.integers(0, 50, 256))
    learned.weights, learned.refine = rng.normal(0, 0.3, (M.GATES, M.ORDERS + 1)), rng.uniform(0.2, 0.8, M.GATES * M._BUCKETS)
    model = M.Model(slots=(22,) * M.SHARED, own_slots=22)
    pairs = spelled(words, level)
    tables = [np.zeros((1 << 22, 2), np.int64) for _ in range(M.SHARED)]
    for bit, _, owner, slots, _ in M.decisions(pairs, learned, model, 7, range(M.SHARED)):
        for t, s in zip(tables, slots):
            np.add.at(t, (s, bit), counts[owner])
    tables = [M.encode_counts(t[:, 0], t[:, 1]) for t in tables]
    got = M.log10_words(pairs, [*tables, *M.own_tables(pairs, counts, learned, model)], learned, model, M.Logits.of(model.smooth))
    path = lambda byte: [(int(learned.nodes[byte, j]), int(learned.code[byte, j])) for j in range(learned.code_bits[byte])]
    seen = [Counter() for _ in range(M.ORDERS)]
    for w, state, n in zip(words, pairs.states.tolist(), counts.tolist()):
        for i, byte in enumerate(w):
            for node, bit in path(byte):
                for table, c in zip(seen, brute_contexts(w, i, state, level)):
                    table[c, node, bit] += n if c is not None else 0
    for w, state, found in zip(words, pairs.states.tolist(), got):
        total = 0.0
        for i, byte in enumerate(w):
            for at, (node, bit) in enumerate(path(byte)):
                logits, longest = [], 0
                for k, (table, c) in enumerate(zip(seen, brute_contexts(w, i, state, level))):
                    zeros, ones = (M._LEVELS[M._LEVELS <= table[c, node, b]].max() for b in (0, 1))
                    logits.append(math.log((ones + model.smooth) / (zeros + model.smooth)) if zeros + ones else 0.0)
                    longest = k + 1 if zeros + ones else longest
                gate = longest * 3 + min(at, 2)
                logit = max(-14.0, min(14.0, learned.weights[gate, M.ORDERS] + sum(x * y for x, y in zip(learned.weights[gate], logits))))
                place = max(0, min(M._BUCKETS - 1, round(logit * 3) + M._BUCKETS // 2))
                p = 0.5 / (1 + math.exp(-logit)) + 0.5 * learned.refine[gate * M._BUCKETS + place]
                total += math.log10(p if bit else 1 - p)
        assert found == pytest.approx(total, rel=2e-3)


def test_steps_do_not_change_decisions():
    words, learned, model = spelled([b"abcdefgh" * 50 + b" ", b"ab ", b"abcdefghi "]), M.prefix_code(np.ones(256)), M.Model()
    whole, parts = ([np.concatenate([np.asarray(x[i]) for x in M.decisions(words, learned, model, size)]) for i in (0, 1, 2, 4)] for size in (10**6, 5))
    assert all((x == y).all() for x, y in zip(whole, parts))
    whole, parts = ([np.concatenate([x[3][k] for x in M.decisions(words, learned, model, size)]) for k in range(M.ORDERS)] for size in (10**6, 5))
    assert all((x == y).all() for x, y in zip(whole, parts))


def test_scores_do_not_depend_on_chunks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, two = ({r.doc_id: r.score for r in M.scores(docs, M.Model(slots=SMALL.slots, chunk_bytes=size, range_words=10**6)).collect()} for size in (20_000, 10**8))
    assert all(one[k] == pytest.approx(two[k], rel=1e-3) for k in one)


def test_words_that_begin_alike_meet(spark):
    """In one range, by the least length at which not too many do; scores stay near those of one range for all words."""
    text = " ".join(f"https://www.site{i % 7}.example/{i}" for i in range(3000)) + " the then thesis"
    docs = spark.createDataFrame([(i, text) for i in range(4)], "doc_id long, text string")
    model = M.Model(slots=(16,) * M.SHARED, own_slots=16, range_words=2000)
    chunks = M.keep(M._chunked(docs, model), "chunks")
    split = M._split_beginnings(chunks, 12_000, 4, model)
    words = M._chunk_words(chunks.first().asDict())
    level, part = M._dealt(words, split, 6)
    spelt = [bytes(words.data[a:b]) for a, b in zip(words.first, words.first[1:])]
    long = [k for k, w in zip(level, spelt) if w.startswith(b"https")]
    assert min(long) >= 3 and {k for k, w in zip(level, spelt) if w.startswith(b"the")} == {0}
    groups = {}
    for k, r, w in zip(level.tolist(), part.tolist(), spelt):
        groups.setdefault((k, w[: (*M.LEVELS, None)[k]]), set()).add(r)
    assert all(len(g) == 1 for g in groups.values()) and len(set(part.tolist())) > 1
    assert all(r.score < 0 for r in M.scores(docs, model).collect())


def test_ids_that_repeat_and_very_long_texts(spark):
    """Rows are scored each by itself; a word of a megabyte and a text of many words are whole."""
    rows = [(1, "one text"), (1, "quite another"), (None, "third"), (None, None), (2, "x" * (1 << 20)), (3, "ab cd " * 200_000)]
    check(clashing(spark.createDataFrame(rows, "doc_id long, text string")), M.Model())


def test_counters_grow_with_the_input(spark):
    """More words make more ranges, each with counters of its own."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sizes = []
    for n in (1, 4):
        chunks = M.keep(M._chunked(docs.where(f"doc_id % 4 < {n}"), SMALL), "chunks")
        words = chunks.agg({"words": "sum"}).first()[0]
        sizes.append(-(-words // SMALL.range_words))
    assert sizes[1] >= 3 * sizes[0]


def test_count_codes_are_exact_when_small_and_near_when_large():
    for n in (0, 1, 7, 63):
        assert M._LEVELS[M.encode_counts(np.array([n]), np.array([0]))[0] & 255] == n
    for n in (100, 10**6, 10**12):
        assert abs(M._LEVELS[M.encode_counts(np.array([n]), np.array([0]))[0] & 255] / n - 1) < 0.15


def test_widths():
    for top in (0, 254, 255, 256, 70_000, 2**33):
        for zeros in (1, 100):
            numbers = [*[0] * zeros, top, 254, 255, top]
            assert M._read(M._ints(np.array(numbers))).tolist() == numbers
            assert M._read_cells(M._cells(np.array(numbers)), len(numbers)).tolist() == numbers
            if top < 2**31:
                assert M._read_planes(M._planes(np.array(numbers))).tolist() == numbers
    assert M._read_planes(M._planes(np.zeros(3, np.int64))).tolist() == [0, 0, 0]
    assert M._read(M._ints(np.array([], np.int64))).tolist() == [] == M._read_cells(M._cells(np.zeros(0, np.int64)), 0).tolist()


def test_empty_and_untrained(spark):
    assert M.scores(empty_docs(spark), SMALL).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = M.scores(spark.createDataFrame([(held, "some words")], "doc_id long, text string"), SMALL).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.base_score == pytest.approx(0.0) and r.score < 0
