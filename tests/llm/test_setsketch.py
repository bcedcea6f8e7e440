import numpy as np

from attestor.llm.setsketch import Sketch, drop_copies, likeliest_jaccard, near_duplicates, registers
from attestor.operators.graph import components

from tests.llm.cases import LOWER, SPACE_WORD, clashing, edge_docs, empty_docs


def brute(rows, k):
    sets = []
    for _, text in rows:
        w = SPACE_WORD.findall((text or "").translate(LOWER))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=str)


def check(docs, sketch):
    got = near_duplicates(docs, sketch).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], sketch.words)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want


def test_edges_equal_brute_force(spark):
    check(clashing(edge_docs(spark)), Sketch(words=2))


def test_sample_equals_brute_force(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), Sketch(words=2))


def test_near_group_in_blocks_equals_brute_force(spark):
    """One centre, many edited copies around the threshold; tiny blocks so that buckets and meetings are divided."""
    rng = np.random.default_rng(3)
    centre = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(160):
        words = list(centre)
        for p in rng.choice(60, rng.integers(0, 7), replace=False):
            words[p] = f"z{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(words)))
    check(spark.createDataFrame(rows, "doc_id long, text string"), Sketch(words=2, block=16, meeting=16, crowd=70))


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 30)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(21)) and all(got[i] == 100 for i in range(100, 130))


def shared_id_rows():
    """Two null ids and one repeated id, each on two texts of different sets, and near copies of all of them."""
    texts = {x: [f"{x}{i}" for i in range(60)] for x in "abcd"}
    near = lambda x, k: " ".join([*texts[x][:-k], *(f"{x}z{k}{i}" for i in range(k))])
    rows = [(None, " ".join(texts["a"])), (None, " ".join(texts["b"])), (None, near("a", 1)), (None, near("b", 2)), (7, " ".join(texts["c"])), (7, " ".join(texts["d"])), (7, near("c", 1)), (8, near("d", 1)), (9, near("c", 2)), (10, near("d", 2))]
    return rows + [(11, None), (11, None), (None, "")]


def test_null_and_repeated_ids_are_compared_by_their_own_texts(spark):
    check(spark.createDataFrame(shared_id_rows(), "doc_id long, text string"), Sketch(words=2))


def test_one_row_of_each_group_is_left_where_ids_are_null_or_repeated(spark):
    left = drop_copies(spark.createDataFrame(shared_id_rows(), "doc_id long, text string"), Sketch(words=2)).collect()
    groups = sorted((str(r.doc_id), r.text[0]) for r in left if r.text)
    assert groups == [("7", "c"), ("7", "d"), ("None", "a"), ("None", "b")]
    assert sorted(str(r.doc_id) for r in left if not r.text) == ["11", "None"]


def test_likelihood_estimates_similarity():
    rng = np.random.default_rng(0)
    sketch = Sketch(words=2, bands=256)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    for shared in (200, 500, 800):
        a, b = np.sort(pool[:1000]), np.sort(pool[1000 - shared : 2000 - shared])
        regs = registers(np.concatenate([a, b]), np.array([0, 1000, 2000]), sketch)
        true = shared / (2000 - shared)
        assert abs(likeliest_jaccard(regs[:1], regs[1:], np.array([1000]), np.array([1000]), sketch)[0] - true) < 0.05


def test_registers_merge_by_maximum():
    rng = np.random.default_rng(1)
    sketch = Sketch()
    x = rng.integers(0, 2**63, 500, dtype=np.uint64)
    parts = registers(x, np.array([0, 200, 500]), sketch)
    assert (registers(x, np.array([0, 500]), sketch)[0] == parts.max(0)).all()


def test_empty_table(spark):
    assert near_duplicates(empty_docs(spark)).count() == 0
