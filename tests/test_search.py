from pyspark.sql import functions as F

from attestor.operators import search as R
from attestor.operators import graph


def test_probe_budget(spark):
    def run(most, explicit, automatic):
        cols = R.probe_budget(F.lit(float(most)), F.lit(explicit), F.lit(automatic))
        return tuple(spark.range(1).select(*(c.alias(k) for k, c in cols.items())).first())

    assert run(1000, 1, 4) == (400, 300, 25) and run(1000, 2, 0) == (400, 200, 0) and run(0, 1, 1) == (0, 20, 10)


def test_trace_stages(spark):
    results = spark.createDataFrame([("e", i, i) for i in range(8)], "entity_id string, rank int, document_id long")
    docs = spark.createDataFrame([(1, None, "fetched", 9000), (2, "reject", "fetched", 9000), (3, "review", "fetched", 9000), (4, "accept", "failed", 0), (5, "accept", "fetched", 9000), (6, "accept", "fetched", 9000), (7, "accept", "fetched", 9000)], "document_id long, verdict string, fetch_status string, body_chars int")
    ev = spark.createDataFrame([(6, "heuristic"), (7, "heuristic"), (7, "model")], "document_id long, extractor string")
    got = [r.stage for r in R.page_trace(results, docs, ev).orderBy("rank").collect()]
    assert got == ["not_collected", "not_checked", "rejected", "in_review", "not_read", "no_evidence", "fallback_only", "evidence"]


def test_text_matches(spark):
    results = spark.createDataFrame([("e", 1, "Gala at the Modern Art Museum"), ("e", 2, "Art fair"), ("f", 1, "Modern art")], "entity_id string, rank int, title string")
    labels = spark.createDataFrame([("e", 1, "modern art"), ("e", 2, "Art"), ("f", 3, "Legal")], "entity_id string, association_id int, label string")
    assert {tuple(r) for r in R.match_by_text(results, labels).collect()} == {("e", 1, 1), ("e", 1, 2), ("e", 2, 2)}


def test_surfaces(spark):
    classified = spark.createDataFrame([("e", 1, 1), ("e", 2, None)], "entity_id string, rank int, association_id int")
    signals = spark.createDataFrame([("e", "related", "modern art prices"), ("e", "panel", "nothing")], "entity_id string, surface string, text string")
    labels = spark.createDataFrame([("e", 1, "Modern Art")], "entity_id string, association_id int, label string")
    r = R.surfaces(classified, signals, labels).first()
    assert (r.organic_share, r.related, r.panel) == (0.5, True, False)


def test_links_by_address(spark):
    docs = spark.createDataFrame([(1, "http://a.example/x", "https://a.example/x"), (2, "http://b.example/", "https://b.example")], "document_id long, url string, canonical_url string")
    results = spark.createDataFrame([("e", 1, "http://a.example/x"), ("e", 2, "https://www.b.example/?utm_source=q"), ("e", 3, "http://c.example/")], "entity_id string, rank int, url string")
    assert {r["rank"]: r.document_id for r in R.link_results(results, docs).collect()} == {1: 1, 2: 2, 3: None}


def test_default_hierarchy(spark):
    got = {tuple(r) for r in R.default_hierarchy(spark.createDataFrame([("Lawsuit",), ("Settlements",), ("Collecting",), ("Controversy",), ("Allegations",)], "label string")).collect()}
    assert got == {("Legal", "Lawsuit"), ("Legal", "Settlements"), ("Controversy", "Allegations")}


def test_draft_states(spark):
    events = [("a", 1, "publish"), ("a", 2, "approve"), ("a", 3, "publish"), ("b", 1, "approve"), ("b", 2, "edit")]
    assert dict(tuple(r) for r in R.draft_states(spark.createDataFrame(events, "draft_id string, at int, event string")).collect()) == {"a": "published", "b": "draft"}


def test_probe_terms(spark):
    related = spark.createDataFrame([(0, "John Carver lawsuit"), (1, "carver net worth"), (2, "John Carver company"), (3, "JOHN CARVER Lawsuit")], "place int, query string")
    assert [r.term for r in R.probe_terms(related, ["John Carver"]).collect()] == ["lawsuit", "net worth"]


def test_paths(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "parent string, child string")
    assert {tuple(r) for r in graph.hierarchy_paths(edges).collect()} == {("a", "b", 1), ("b", "c", 1), ("a", "c", 2)}
