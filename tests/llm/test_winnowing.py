import hashlib
import re

from attestor.llm.queries import op10_winnowing  # noqa: F401
from attestor.llm.winnowing import Winnow, contamination, drop_contaminated

from tests.llm.cases import LOWER, clashing, edge_docs, empty_docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words_of(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    lengths = {len(x) for x in windows}
    out = []
    for doc, text in docs:
        w = words_of(text)
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (items_of := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= items_of
        out.append((doc, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=str)


def check(docs, benchmark, winnow=Winnow()):
    got = [(r.doc_id, r.n_words, r.n_hit, list(r.items)) for r in contamination(docs, benchmark, winnow).collect()]
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], [(r.item_id, r.text) for r in benchmark.select("item_id", "text").collect()])
    assert sorted(got, key=str) == want
    return want


def items_for(spark):
    base = " ".join(f"q{i}" for i in range(30))
    rows = [(1, "One, TWO!"), (2, base), (2, base), (3, None), (4, "..."), (5, "naïve Étude  (a) b|c"), (None, "tied text of"), (6, "a a a a a a a a a a"), (7, "line a b line"), (8, "q7 q8 q9 q10 q11 q12 q13 q14 q15 q16")]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_edges_equal_brute_force(spark):
    docs = clashing(edge_docs(spark))
    extra = " ".join(f"q{i}" for i in range(30))
    more = spark.createDataFrame([(900, "x " + extra[:60] + " y"), (901, extra.upper()), (902, " ".join(extra.split()[5:15])), (903, " ".join(extra.split()[5:14]))], "doc_id long, text string")
    docs = docs.unionByName(more, allowMissingColumns=True)
    want = check(docs, items_for(spark))
    assert any(r[2] for r in want)
    check(docs, items_for(spark), Winnow(bits=4))  # full bit tables change nothing
    check(docs, items_for(spark), Winnow(k=10))


def test_sample_equals_brute_force(spark):
    at = "/root/testdata/sf0.001/"
    docs, benchmark = spark.read.parquet(at + "documents.parquet"), spark.read.parquet(at + "benchmark.parquet")
    want = check(docs, benchmark)
    clean = {r[0] for r in want if not r[2]}
    left = drop_contaminated(docs, benchmark)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == clean


def test_every_shared_window_is_found_wherever_it_starts(spark):
    words = [f"t{i}" for i in range(200)]
    benchmark = spark.createDataFrame([(0, " ".join(words))], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"pre{i} " + " ".join(words[i : i + 10]) + " post") for i in range(190)], "doc_id long, text string")
    assert all(r.n_hit == 10 for r in contamination(docs, benchmark).collect())


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_empty_tables(spark):
    assert contamination(empty_docs(spark), items_for(spark)).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(edge_docs(spark), none).where("contaminated").count() == 0
