import math
import zlib

import pytest
from pyspark.sql import functions as F

from attestor.llm.kdtree import Tree, _prepared, assign

from tests.llm.cases import clashing, edge_docs, empty_docs


def check(docs, tree):
    got = assign(docs, tree).collect()
    want = sorted(((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.select("doc_id", "text").collect()), key=str)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=str) == want
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r)
    for rows in shards.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    return shards


def test_sizes_are_near_equal(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for n in (16, 5, 1):
        shards = check(docs, Tree(shards=n, slot_rows=20))
        sizes = [sum(r["size"] for r in rows) for rows in shards.values()]
        largest = max(r["size"] for rows in shards.values() for r in rows)
        assert sorted(shards) == list(range(n)) and max(sizes) - min(sizes) <= 5 * largest


def test_equal_texts_stay_together_but_for_cuts(spark):
    shards = check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), Tree())
    where = {}
    for s, rows in shards.items():
        for r in rows:
            where.setdefault(r.group, set()).add(s)
    assert sum(len(x) > 1 for x in where.values()) <= 15


def test_a_group_of_most_rows_is_divided(spark):
    rows = [(i, "same text here", "en", "src0", 3) for i in range(4000)] + [(9000 + i, f"text number {i}", "en", "src1", 3) for i in range(1000)]
    shards = check(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), Tree())
    sizes = [sum(r["size"] for r in rows) for rows in shards.values()]
    assert max(sizes) < 1.05 * min(sizes)


def test_target_bytes_and_repeatable(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tree = Tree(target_bytes=50_000)
    one, two = ({(r.doc_id, r.shard, r.slot) for r in assign(docs, tree).collect()} for _ in range(2))
    assert one == two and len({x[1] for x in one}) > 4


def test_edges(spark):
    check(clashing(edge_docs(spark)), Tree())
    assert assign(empty_docs(spark)).count() == 0


def brute(docs, tree, shards):
    """The tree by sorted lists: {(doc_id, size, text_crc32): shards of its rows}."""
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    hashes = docs.select("doc_id", "text", F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(65536)).alias("t"), F.pmod(F.xxhash64("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))), F.lit(65536)).alias("o")).collect()
    low = {(r.text or "", r.doc_id): (r.t, r.o) for r in hashes}
    lead = {}
    for _, text, lang, source in rows:  # equal texts share their least labels
        label = ["\x00" if x is None else x for x in (lang, source)]
        old = lead.get(text or "", label)
        lead[text or ""] = [min(a, b) for a, b in zip(old, label)]
    names = [sorted({"\x00" if x is None else x for x in col}) for col in ([r[2] for r in rows], [r[3] for r in rows])]
    points = []
    for doc, text, _, _ in rows:
        text = text or ""
        size = len(text.encode()) + 1
        places = {"size": math.floor(math.log2(size) * 1048576), "lang": names[0].index(lead[text][0]), "source": names[1].index(lead[text][1])}
        points.append(((doc, size, zlib.crc32(text.encode())), size, [places[d] for d in tree.dimensions], low[text, doc]))
    whole = [max(p[2][i] for p in points) - min(p[2][i] for p in points) for i in range(len(tree.dimensions))]
    found, todo = {}, [(points, shards, 0)]
    while todo:
        part, n, first = todo.pop()
        if n == 1:
            for p in part:
                found.setdefault(p[0], []).append(first)
            continue
        lo = [min(p[2][i] for p in part) for i in range(len(whole))]
        hi = [max(p[2][i] for p in part) for i in range(len(whole))]
        width = [(h - a) / max(w, 1) for h, a, w in zip(hi, lo, whole)]
        axis = max(range(len(width)), key=lambda i: (width[i], -i))
        scaled = lambda p: math.floor((p[2][axis] - lo[axis]) * float((1 << 31) - 1) / (hi[axis] - lo[axis])) if hi[axis] > lo[axis] else 0
        order = sorted((scaled(p), *p[3]) for p in part)
        bytes_of = {}
        for p in part:
            key = (scaled(p), *p[3])
            bytes_of[key] = bytes_of.get(key, 0) + p[1]
        wanted, through, cut = sum(p[1] for p in part) * (n // 2) / n, 0, None
        for key in dict.fromkeys(order):
            through += bytes_of[key]
            if through >= wanted:  # the key that holds the quantile goes to the nearer side
                cut = (key, through - wanted < wanted - (through - bytes_of[key]))
                break
        left = lambda p: (scaled(p), *p[3]) < cut[0] or ((scaled(p), *p[3]) == cut[0] and cut[1])
        todo += [([p for p in part if left(p)], n // 2, first), ([p for p in part if not left(p)], n - n // 2, first + n // 2)]
    return found


@pytest.mark.parametrize("shards", [2, 5, 16])
def test_equals_brute_force(spark, shards):
    for docs in (spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), edge_docs(spark).union(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))):
        tree = Tree(shards=shards)
        got = {}
        for r in assign(docs, tree).collect():
            got.setdefault((r.doc_id, r["size"], r.text_crc32), []).append(r.shard)
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in brute(docs, tree, shards).items()}


def test_every_label_has_a_coordinate(spark):
    """20 sources have 20 places, by the order of their names, whatever their first letters."""
    rows = [(i, f"text {i}", None, f"https://source-{i % 20:02d}", 3) for i in range(60)]
    placed = _prepared(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), Tree(), "doc_id", "text").collect()
    assert all(r.x2 == r.doc_id % 20 and r.x1 == 0 for r in placed)


def test_repeated_ids_and_very_long_texts(spark):
    rows = [(1, "one", "en", "a", 1), (1, "two", "en", "a", 1), (None, "three", "en", "a", 1), (None, "four", "en", "a", 1), (2, "x" * (1 << 20), "en", "b", 1)]
    check(clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")), Tree(shards=3))
