import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.llm.frames import columns
from attestor.llm.raking import Mix, added, calibrated, cell_weights, missed, rake, sample, with_probabilities

from tests.llm.cases import SPACE_WORD, clashing, edge_docs, empty_docs


def test_marginals_match_targets():
    rng = np.random.default_rng(2)
    tokens = rng.integers(1, 1000, 24)
    codes = [np.arange(24) % 4, np.arange(24) // 4 % 3, np.arange(24) // 12]
    targets = [rng.dirichlet(np.ones(n)) * tokens.sum() for n in (4, 3, 2)]
    fitted = rake(tokens, codes, targets, 500, 1e-12)
    for code, target in zip(codes, targets):
        assert np.allclose(np.bincount(code, fitted), target)


def flattened(rows, dim):
    """Target shares of a dimension's values: own shares to the power 0.7."""
    own = {}
    for r in rows:
        own[r[dim]] = own.get(r[dim], 0) + r._tokens
    total = sum(own.values())
    aim = {k: (v / total) ** 0.7 for k, v in own.items()}
    return {k: v / sum(aim.values()) for k, v in aim.items()}


def expected(rows, dim):
    have = {}
    for r in rows:
        have[r[dim]] = have.get(r[dim], 0) + r._tokens * r._probability
    return {k: v / sum(have.values()) for k, v in have.items()}


def test_probabilities_are_calibrated():
    """No greater than 1, with the targets' marginals, and no smaller a sample than weights over the greatest weight give."""
    rng = np.random.default_rng(4)
    for _ in range(5):
        tokens = rng.integers(0, 500, 60)
        codes = [np.arange(60) % 4, np.arange(60) // 4 % 5, np.arange(60) // 20]
        shares = [np.bincount(c, tokens) ** 0.7 for c in codes]
        targets = [x / x.sum() * tokens.sum() for x in shares]
        weight = np.divide(rake(tokens, codes, targets, 500, 1e-12), tokens, out=np.ones(60), where=tokens > 0)
        p, miss = calibrated(tokens, weight, codes, targets, Mix())
        kept = (tokens * p).sum() / tokens.sum()
        assert miss <= 1e-6 and p.max() <= 1 and missed(tokens * p / kept, codes, targets) <= 1e-5
        assert kept >= 1 / weight[tokens > 0].max() - 1e-9
        few, miss = calibrated(tokens, weight, codes, targets, Mix(keep_tokens=0.1))
        assert miss <= 1e-6 and (tokens * few).sum() / tokens.sum() == pytest.approx(0.1, rel=1e-4)


def test_targets_out_of_reach_are_told():
    """Two values that always go together cannot have different shares."""
    tokens, codes = np.array([100, 300]), [np.array([0, 1]), np.array([0, 1])]
    targets = [np.array([200.0, 200.0]), np.array([100.0, 300.0])]
    p, miss = calibrated(tokens, rake(tokens, codes, targets, 200, 1e-9) / tokens, codes, targets, Mix())
    assert miss > 0.2 and p.max() <= 1


def test_too_many_combinations_are_refused(spark):
    cells = spark.createDataFrame([(f"s{i}", "l", "t", 1) for i in range(11)], "source string, lang string, topic string, tokens long")
    with pytest.raises(ValueError, match="11 combinations"):
        cell_weights(cells, Mix(most_cells=10))


def test_expected_sample_has_the_target_marginals(spark):
    got = with_probabilities(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    for d in ("source", "lang", "_topic"):
        have, aim = expected(got, d), flattened(got, d)
        assert all(abs(have[k] / aim[k] - 1) < 1e-5 for k in aim)
    assert max(r._residual for r in got) < 1e-5


def test_given_targets(spark):
    targets = {"lang": {"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2}}
    got = with_probabilities(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), targets=targets).collect()
    have = expected(got, "lang")
    assert all(have[k] == pytest.approx(v, rel=1e-5) for k, v in targets["lang"].items())


def test_sampling_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = with_probabilities(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        draw = int(hashlib.md5(f"{r.doc_id}|mix".encode()).hexdigest()[:13], 16) / 2**52
        assert r._tokens == len(SPACE_WORD.findall(r.text)) and r._sampled == (draw < r._probability)
    total = sum(r._tokens for r in got)
    for d in ("source", "lang", "_topic"):  # weighted tokens meet the flattened shares
        have = {}
        for r in got:
            have[r[d]] = have.get(r[d], 0) + r._tokens * r._weight / total
        assert all(abs(have[k] - v) < 1e-6 for k, v in flattened(got, d).items())
    assert sorted(r.doc_id for r in sample(docs).collect()) == sorted(r.doc_id for r in got if r._sampled)


def test_edges(spark):
    docs = clashing(edge_docs(spark))
    names = added(docs)
    got = with_probabilities(docs)
    assert got.count() == docs.count() and got.columns == [*docs.columns, *(names[k] for k in ("topic", "tokens", "weight", "probability", "residual", "sampled"))]
    assert got.where(F.col(names["probability"]).isNull() | F.col(names["weight"]).isNull() | F.col(names["sampled"]).isNull()).count() == 0
    assert with_probabilities(empty_docs(spark)).count() == 0
    alike = {}
    for r in got.collect():
        alike.setdefault((r.doc_id, r.source, r.lang, r[names["topic"]]), set()).add(r[names["sampled"]])
    assert all(len(x) == 1 for x in alike.values())


def test_users_columns_keep_their_values(spark):
    docs = clashing(edge_docs(spark))
    kept = sample(docs)
    assert kept.columns == docs.columns
    extra = columns(kept)[5:]
    assert {tuple(r) for r in kept.select(*extra).distinct().collect()} == {("extra",) * len(extra)}
