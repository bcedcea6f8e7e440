"""Operators whose queries have no SQL twin, and driver-side helpers, on small inputs."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from attestor.functions import text as T
from attestor.operators import audit, content, duplicates, extraction, ledger, records


def test_near_duplicates_equal_all_pairs(spark):
    """Against every pair, among those that share a band or four minhash positions."""
    from attestor.functions import hashing as H

    base = [" ".join(f"w{(i * 7 + k) % 90}" for k in range(60)) for i in range(4)]
    corpus = [(i, x) for i, x in enumerate(base)] + [(10, None), (11, "short")]
    texts = [(100 + i, x + " changed at the end") for i, x in enumerate(base)] + [(200, "nothing like the others at all, of other words"), (201, "")]
    prints = lambda rows, key: duplicates.fingerprints(spark.createDataFrame(rows, f"{key} long, text string"), key)
    a, b = prints(texts, "text_id"), prints(corpus, "document_id")
    got = {(r.text_id, r.document_id): r.similarity for r in audit.near_duplicates(a, b).collect()}
    want = {}
    for x in a.collect():
        for y in b.collect():
            if x.simhash is None or y.simhash is None:
                continue
            bits = ((x.simhash ^ y.simhash) & (2**64 - 1)).bit_count()
            same = sum(p == q for p, q in zip(x.minhash, y.minhash)) / 64
            band = any((x.simhash >> s) & 65535 == (y.simhash >> s) & 65535 for s in (0, 16, 32, 48))
            rows = any(x.minhash[k : k + 4] == y.minhash[k : k + 4] for k in range(0, 64, 4))
            if (band or rows) and (bits <= 12 or same >= 0.5):
                want[x.text_id, y.document_id] = same
    assert got == want and {(100 + i, i) for i in range(4)} <= set(got)
    assert H.minhash_of("") is None


def test_copies_are_not_expanded_into_pairs(spark, tmp_path):
    """m63: one pair for two classes and a row per member; expanded, the pairs of fingerprints() on every text."""
    from attestor.functions import hashing as H
    from attestor.plans import text_queries as Q

    copy, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i % 7}" for i in range(30))
    rows = [(i, copy + " end") for i in range(40)] + [(50, copy + " other"), (51, other), (52, None), (53, ""), (54, "one"), (55, "caf\u00e9 \u039f\u03b4\u03cc\u03c2 e\u0301 \ufb01n " + copy)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s")).write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.near_duplicates(spark, str(tmp_path)).collect()
    pairs = [r for r in got if r.member_of is None]
    texts, documents = ({r[key]: r.member_of for r in got if r.member_of is not None and r[key] is not None} for key in ("text_id", "document_id"))
    assert len(pairs) < 20 and len(texts) == 46 and len(documents) == 44 and {texts[i] for i in (*range(40), 50)} == {0} and {documents[i] for i in range(40)} == {0}
    alike = {(r.text_id, r.document_id) for r in pairs}
    assert {(texts[50], documents[0]), (texts[0], documents[50])} <= alike and (texts[51], documents[0]) not in alike
    for _, text in rows:
        plain = T.fold_text.func(pd.Series([text]))[0] if text is None or text.isascii() else spark.createDataFrame([(text,)], "t string").select(T.folded_column(F.col("t"))).first()[0]
        h = H.simhash_of(text)
        assert H.signatures([text], [plain])[0] == (h if h is None or not h >> 63 else h - (1 << 64), H.minhash_of(plain))


def test_verbatim_overlaps_of_odd_rows(spark, tmp_path):
    """h15 against its SQL: rows with one id or none, runs that repeat, texts of many pieces; only runs that may meet leave Python."""
    import duckdb

    from attestor.plans import text_queries as Q

    words = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    shared = words(0, 40)
    docs = [(1, shared), (1, words(20, 60)), (None, shared), (2, None), (3, ""), (4, "x " * 600 + shared), (5, words(0, 11)), (6, words(29, 41).upper()), (7, words(0, 8) + ". " + words(8, 12)), (8, words(100, 3_000) + " " + shared)]
    items = [(1, shared), (1, words(30, 70)), (2, "x " * 200), (3, None), (None, shared), (4, words(0, 11))]
    spark.createDataFrame(docs, "doc_id long, text string").withColumn("source", F.lit("s")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(Q.ORACLE_SQL["h15_verbatim_overlaps"]).fetchall()
    got = Q.verbatim_overlaps(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and (1, 1, 48) in want and (4, 2, 1) in want
    folded = spark.createDataFrame([(1, words(100, 250_000) + " " + shared), (2, ""), (3, shared)], "text_id long, folded string")
    table = spark.sparkContext.broadcast(audit._bit_table(audit._runs(spark.createDataFrame([(1, shared)], "k long, folded string"), 12)))
    assert audit._runs(folded, 12).count() == 249_929 + 29 and 58 <= audit._runs(folded, 12, table).count() < 100


def test_target_coverage_and_exclusions(spark):
    text = "Harbor Trust opens. " + "x " * 300 + "John Carver of the Harbor Trust spoke; the harbor  trust grew. Harbor Trust."
    df = spark.createDataFrame([("a", "The Harbor Trust", text), ("b", "Else", "Nothing here.")], "text_id string, title string, text string")
    got = {r.text_id: r for r in content.target_coverage(df, "Harbor Trust", [], ["John Carver"]).collect()}
    assert (got["a"].mentions, got["a"].counted, got["a"].beside_name, got["a"].in_title, got["a"].in_opening) == (4, 3, True, True, True)
    assert (got["b"].mentions, got["b"].beside_name, got["b"].in_title, got["b"].in_opening) == (0, False, False, False)
    assert [(r.text_id, r.hits) for r in audit.exclusion_breaches(df, ["harbor trust", "xx"]).collect()] == [("a", 4)]


def test_merge_suggestions(spark):
    rows = [("concept", "venture capital fund"), ("concept", "fund venture capital"), ("concept", "museum"), ("named_entity", "venture capital fund")]
    got = extraction.merge_suggestions(spark.createDataFrame(rows, "kind string, label_key string"), 0.5).collect()
    assert {(r.kind, r.a, r.b) for r in got} == {("concept", "fund venture capital", "venture capital fund")}


def test_signoffs_hold_for_the_current_text(spark):
    drafts = spark.createDataFrame([(1, "h2")], "draft_id int, text_hash string")
    signs = spark.createDataFrame([(1, "h1", "old"), (1, "h2", "new"), (2, "h2", "other")], "draft_id int, text_hash string, user string")
    assert [r.user for r in records.current_signoffs(signs, drafts).collect()] == ["new"]


def test_driver_side_helpers():
    schema = {"type": "object", "properties": {"a": {"type": "string"}, "b": {"type": "array", "items": {"type": "object", "properties": {"c": {}}}}}, "required": ["a"]}
    strict = records.strict_schema(schema)
    assert strict["required"] == ["a", "b"] and strict["additionalProperties"] is False
    assert strict["properties"]["b"]["items"]["required"] == ["c"] and schema["required"] == ["a"]
    state, ran = ledger.skip_steps([("one", lambda s: {"x": 1}), ("two", lambda s: {"y": s["x"] + 1}), ("three", lambda s: None)], ["one"], {"x": 5})
    assert state == {"x": 5, "y": 6} and ran == ["two", "three"]


def test_clusters_move_no_signatures_of_far_pairs(spark):
    """m15: texts cross to Python once, and a pair that shares a band but differs in more bits is dropped where it is met."""
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "v w x y z")], "document_id long, text string")
    plan = duplicates.fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Join" not in plan
    rows = [(k, f"h{k}", s, [k] * 64) for k, s in enumerate([0, 7, 0x7FFF_0000_0000_0000, 0xFFFF << 16])]
    prints = spark.createDataFrame(rows, "document_id long, content_hash string, simhash long, minhash array<long>")
    assert {(r.document_id_a, r.document_id_b) for r in duplicates.near_pairs(prints).collect()} == {(0, 1)}
    assert duplicates.banded_pairs(prints).count() == 6 and not [c for c in duplicates.banded_pairs(prints).columns if "minhash" in c]


@pytest.mark.parametrize("name,passes,written", [("f7_gap_order", 1, 2), ("m32_full_board", 1, 2), ("m49_alerts", 2, 3), ("m50_entity_summary", 2, 3), ("m62_what_if", 2, 2), ("f8_by_movement", 2, 2)])
def test_readings_of_a_board_share_its_scores(spark, monkeypatch, name, passes, written):
    """The evidence is scored once for each state of the documents, and what each pass moved is deleted before the next."""
    from attestor.operators import scoring
    from attestor.plans import insight_queries, inventory_queries, registry

    calls, kept, real = [], [], scoring.evidence_scores
    monkeypatch.setattr(scoring, "evidence_scores", lambda *a, **k: calls.append(1) or real(*a, **k))
    for module in (insight_queries, inventory_queries):
        monkeypatch.setattr(module, "settle", lambda df, what: kept.append(what) or df)
    registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert (len(calls), len(kept)) == (passes, written)
