from collections import Counter

from attestor.llm.repetition import Limits, keep_good, measure

from tests.llm.cases import SPACE_WORD, clashing, edge_docs, empty_docs


def brute(text, limits=Limits()):
    words = SPACE_WORD.findall(text or "")
    n = len(words)
    windows = Counter(zip(words, words[1:], words[2:]))
    again = {i + j for i in range(n - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    size, covered, longest = limits.min_words, set(), 0
    places = {}
    for i in range(n - size + 1):
        places.setdefault(tuple(words[i : i + size]), []).append(i)
    for at in places.values():
        if len(at) > 1:
            for i in at:
                covered |= set(range(i, i + size))
            for a in at[:3]:
                for b in at:
                    if a < b:
                        k = size
                        while b + k < n and words[a + k] == words[b + k]:
                            k += 1
                        longest = max(longest, k)
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    failed = n < 50 or 100 * len(again) > 50 * n
    return {
        "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(again), "covered_words": len(covered), "longest_repeat": longest, "base_failed": failed,
        "kept": not failed and len(covered) <= limits.max_covered * n and longest <= limits.max_longest,
    }


def check(docs):
    texts = Counter((r.doc_id, str(brute(r.text))) for r in docs.select("doc_id", "text").collect())
    got = Counter((r.doc_id, str({k: v for k, v in r.asDict().items() if k != "doc_id"})) for r in measure(docs).collect())
    assert got == texts


def test_edges_equal_brute_force(spark):
    check(edge_docs(spark))


def test_sample_equals_brute_force(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_extra_columns_and_filter(spark):
    docs = clashing(edge_docs(spark))
    good = {r.doc_id for r in measure(docs).where("kept").collect()}
    left = keep_good(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == good


def test_repeats_over_the_limits_are_rejected(spark):
    block = " ".join(f"u{i}" for i in range(450))
    rows = [(1, block + " " + " ".join(f"v{i}" for i in range(1500)) + " " + block), (2, " ".join(f"u{i}" for i in range(900)))]
    got = {r.doc_id: r for r in measure(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].longest_repeat == 450 and not got[1].base_failed and not got[1].kept
    assert got[2].longest_repeat == 0 and got[2].kept


def test_covered_words_alone_reject(spark):
    block, rest = ([f"{c}{i}" for i in range(n)] for c, n in (("u", 90), ("v", 420)))
    long, other = ([f"{c}{i}" for i in range(n)] for c, n in (("u", 170), ("v", 360)))
    short, more = ([f"{c}{i}" for i in range(n)] for c, n in (("u", 40), ("v", 420)))
    rows = [(1, " ".join(block + rest + block)), (2, " ".join(long + other + long)), (3, " ".join(short + more + short))]
    got = {r.doc_id: r for r in measure(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].covered_words, got[1].longest_repeat, got[1].base_failed, got[1].kept) == (180, 90, False, False)
    assert got[1].longest_repeat <= Limits().max_longest
    assert (got[2].covered_words, got[2].base_failed, got[2].kept) == (340, False, False)
    assert got[3].covered_words == 80 and got[3].kept


def test_clean_documents_stay(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = measure(docs).where("NOT base_failed").join(labels.where("quality = 1"), "doc_id")
    assert found.count() > 0 and found.where("NOT kept").count() == 0


def test_empty_table(spark):
    assert measure(empty_docs(spark)).count() == 0
