"""A small invented corpus: clusters, identity, extraction, scoring and corrections together."""

import pytest
from pyspark.sql import functions as F

from attestor.functions import html as P
from attestor.operators import audit, content, corrections, duplicates, extraction, graph, identity
from attestor.operators import scoring as S
from attestor.sources import candidates

def now():
    return F.lit("2026-09-01 00:00:00").cast("timestamp")
RELEASE = "John Carver donated to the Harbor Foundation on Monday. The charitable giving by Northway Capital founder John Carver supports schools in Boston and the gift to pupils continues for years. " + " ".join(f"note{i} of the fund" for i in range(80)) + "."
PROFILE = identity.Profile("John Carver", markers=(identity.Marker("organization", "Northway Capital"), identity.Marker("location", "Boston"), identity.Marker("other", "chess player", polarity=-1)))
ROWS = [
    ("a.example", RELEASE, "2026-08-01", 80.0), ("b.example", RELEASE, "2026-08-02", 60.0), ("c.example", RELEASE + " End.", "2026-08-03", 40.0),
    ("d.example", "John Carver of Northway Capital faces a lawsuit in Boston over fees. The litigation began early.", "2020-03-01", 70.0),
    ("e.example", "John Carver, the chess player, won again.", "2026-07-01", 30.0), ("f.example", "Nothing about anyone here.", "2026-07-01", 30.0),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, *r) for i, r in enumerate(ROWS)]
    df = spark.createDataFrame(rows, "document_id long, root_domain string, text string, day string, domain_rank double")
    return df.withColumn("effective_date", F.to_timestamp("day")).drop("day")


def test_identity(docs):
    got = {r.document_id: r for r in identity.score_documents(docs, PROFILE).collect()}
    assert [got[i].verdict for i in range(4)] == ["accept"] * 4 and got[4].verdict == "reject" and got[5].confidence == 0.0
    ranked = identity.with_search_prior(identity.score_documents(docs, PROFILE), docs.where("document_id = 4").select("document_id", F.lit(2).alias("rank")))
    assert {r.document_id: r.confidence for r in ranked.collect()}[4] > got[4].confidence


def test_clusters(docs):
    got = {r.document_id: r for r in duplicates.cluster_documents(duplicates.fingerprints(docs)).collect()}
    assert set(got) == {0, 1, 2} and {r.cluster_id for r in got.values()} == {0} and [r.document_id for r in got.values() if r.is_primary] == [0]


def test_clusters_equal_brute_force(spark):
    """Over all pairs that share a band, by the definition."""
    from attestor.functions import hashing as H

    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("document_id"), "text")
    prints = duplicates.fingerprints(base)
    rows = {r.document_id: r for r in prints.collect()}
    parent = {i: i for i in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(rows)
    bits = {i: H.simhash_of(rows[i].text) for i in ids}
    for a in ids:
        for b in ids:
            if a < b and bits[a] is not None and bits[b] is not None:
                band = any((bits[a] >> s) & 65535 == (bits[b] >> s) & 65535 for s in (0, 16, 32, 48))
                d = (bits[a] ^ bits[b]).bit_count()
                same = sum(x == y for x, y in zip(rows[a].minhash, rows[b].minhash)) / 64
                if rows[a].content_hash == rows[b].content_hash or (band and (d <= 3 or (d <= 12 and same >= 0.6))):
                    parent[max(find(a), find(b))] = min(find(a), find(b))
    want = {i: find(i) for i in ids if sum(find(j) == find(i) for j in ids) > 1}
    assert {r.document_id: r.cluster_id for r in duplicates.cluster_documents(prints).collect()} == want


def test_extraction_and_labels(docs):
    found = extraction.extract_associations(docs, PROFILE)
    rows = {(r.document_id, r.label): r for r in found.collect()}
    assert rows[(0, "Harbor Foundation")].relationship == "donated_to" and rows[(0, "Philanthropy")].kind == "concept" and rows[(3, "Lawsuit")].sentiment == "negative"
    merged = {r.label_key: r for r in extraction.canonical_associations(found).collect()}
    assert merged["harbor foundation"].documents == 3 and merged["harbor foundation"].category == "organization"


def test_generic_variants_merge(spark):
    rows = [("concept", "venture capital", "Venture Capital"), ("concept", "venture capital fund", "Venture Capital Fund"), ("concept", "art", "Art")]
    got = {r.label_key: r.merged_into for r in extraction.merge_generic_variants(spark.createDataFrame(rows, "kind string, label_key string, label string")).collect()}
    assert got == {"venture capital": None, "venture capital fund": "venture capital", "art": None}


def test_scores_from_text(docs):
    found = extraction.extract_associations(docs, PROFILE)
    clusters = duplicates.cluster_documents(duplicates.fingerprints(docs)).select("document_id", "cluster_id", F.col("kind").alias("cluster_kind"), "is_primary")
    matched = identity.score_documents(docs, PROFILE).join(clusters, "document_id", "left").select(
        F.lit("carver").alias("entity_id"), "document_id", "root_domain", "domain_rank", F.lit(None).cast("double").alias("url_rank"), F.lit(None).cast("double").alias("prominence"), F.col("confidence").alias("entity_confidence"),
        "verdict", "effective_date", "cluster_id", "cluster_kind", F.coalesce("is_primary", F.lit(False)).alias("is_primary"),
    )
    ev = found.select(F.col("label").alias("association_id"), "document_id", "occurrence", "token_distance", "boundary", "relationship_confidence", F.lit(0.0).alias("positive"), (F.col("sentiment") == "negative").cast("double").alias("negative"))
    board = {r.association_id: r for r in S.leaderboard(matched, ev, now()).collect()}
    assert board["Philanthropy"].independent_sources <= 1.2 and board["Lawsuit"].current_pias < board["Lawsuit"].historical_pias and board["Philanthropy"].current_pias > board["Lawsuit"].current_pias


def test_merge_pointers(spark):
    rows = [("a", "b"), ("b", "c"), ("c", None), ("d", None)]
    got = dict(tuple(r) for r in graph.follow_merges(spark.createDataFrame(rows, "id string, merged_into string")).collect())
    assert got == {"a": "c", "b": "c", "c": "c", "d": "d"}


def test_merge_sources_fills_nulls(spark):
    a = spark.createDataFrame([("u", None, "x")], "k string, title string, body string")
    b = spark.createDataFrame([("u", "t", "y"), ("v", "w", None)], "k string, title string, body string")
    got = {r.k: r for r in corrections.merge_sources([a, b], "k").collect()}
    assert (got["u"].title, got["u"].body, got["u"].owner) == ("t", "x", 0) and got["v"].owner == 1


def test_candidates(spark, tmp_path):
    rows = candidates.manual(spark, ["http://www.Example.co.uk/a?utm_x=1", {"url": "https://b.example/index.html", "title": "B", "domain_rank": 120.0}, {"url": None}]).collect()
    assert [(r.canonical_url, r.root_domain, r.domain_rank) for r in rows] == [("https://example.co.uk/a", "example.co.uk", 0.0), ("https://b.example", "b.example", 100.0)]
    (tmp_path / "index.jsonl").write_text('{"url":"http://a.example/x","status":"200","timestamp":"20240105120000"}\n{"url":"http://a.example/y","status":"404","timestamp":"20240105120000"}\n')
    got = candidates.url_index(spark, str(tmp_path)).collect()
    assert len(got) == 1 and str(got[0].group_date) == "2024-01-05 00:00:00"
    assert candidates.robots_allow("/a/b", [("disallow", "/a"), ("allow", "/a/b")]) and not candidates.robots_allow("/a/c", [("disallow", "/a"), ("allow", "/a/b")])


def test_addresses(spark):
    hosts = spark.createDataFrame([("10.0.0.1",), ("8.8.8.8",), ("::1",), ("name",)], "h string")
    assert [r.p for r in hosts.select(candidates.is_private_address("h").alias("p")).collect()] == [True, False, True, True]
    urls = spark.createDataFrame([("http://a.example/",), ("ftp://a.example/",), ("http://u:p@a.example/",), ("http://localhost/",), ("x",)], "u string")
    assert [r.p for r in urls.select(candidates.is_public_url(F.col("u")).alias("p")).collect()] == [True, False, False, False, False]


def test_pages(spark):
    html = '<html><head><title> A &amp; B </title><script>x()</script></head><body><nav><a href="/n">N</a></nav><p>One &#233;<br>two</p><!-- gone --><div>Three <a href="https://t.example/p">it</a></div></body></html>'
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(P.extract_text(df.h).alias("t")).first().t == "A & B One é\ntwo\n\nThree it"
    found = P.links_in(html)
    assert [(x["href"], x["anchor"], x["place"]) for x in found] == [("/n", "N", "boilerplate"), ("https://t.example/p", "it", "body")]
    assert P.person_entries('<script type="application/ld+json">{"@graph":[{"@type":"Person","name":"J","sameAs":"u"}]}</script><script type="application/ld+json">{</script>') == ([{"name": "J", "same_as": ["u"]}], 1)


def test_audit_rules(spark):
    rows = [("x", 1, None, "a.example", None), ("x", 1, None, "b.example", None), ("x", None, "owner", "c.example", None), ("x", None, "owner", "d.example", None), ("x", None, None, "e.example", None), ("x", None, None, "e.example", None)]
    got = audit.independent_sources(spark.createDataFrame(rows, "text_id string, cluster_id long, owner_key string, root_domain string, name string"), ["text_id"]).first()
    assert (got.attributions, got.independent) == (6, 3)
    text = 'John Carver leads Northway. He said "we will build more schools" on Monday. Mary Jones left. She resigned. According to the Post, he stays. They agree. He wins.'
    texts = spark.createDataFrame([("x", text)], "text_id string, text string")
    share = audit.subject_share(texts, ["John Carver"], ["Mary Jones"]).first()
    assert (share.sentences, share.client) == (6, 2)
    assert audit.attribution_load(audit.sentences_of(texts)).first().attributed >= 1
    assert [r.quote for r in audit.unverified_quotes(texts, ["nothing like it"]).collect()] == ["we will build more schools"] and audit.unverified_quotes(texts, [text]).count() == 0
    news = spark.createDataFrame([("x", "Carver appointed", "# Northway launches a fund\n\nHe joined early.\n\nTwo.\n\nThree hired him.")], "text_id string, title string, text string")
    assert {r.event for r in audit.unsupported_events(news, F.array(F.lit("he joins them"))).collect()} == {"appoint", "launch"}
    marks = spark.createDataFrame([("a", "occupation", "Financial adviser"), ("a", "other", "FINRA CRD 123"), ("b", "occupation", "painter")], "entity_id string, kind string, value string")
    assert {r.entity_id: (r.regulated, r.registered) for r in audit.regulated_profiles(marks).collect()} == {"a": (True, True), "b": (False, False)}
    assert audit.quotation_check(texts).first().longest == 5
    waste = audit.repetition_waste(spark.createDataFrame([("x", "art " * 5)], "text_id string, text string"), {"Art": []}).first()
    assert (waste.mentions, waste.counted, waste.wasted) == (5, 3, 2)
    kinds = spark.createDataFrame([("sec.gov",), ("x.ac.uk",), ("own.example",), ("press.example",)], "d string").select(audit.source_class(F.col("d"), ["own.example"]).alias("c"))
    assert [r.c for r in kinds.collect()] == ["statutory_register", "academic_institutional", "self_asserted", "press_other"]


def test_passages_do_not_cut_sentences(spark):
    text = ("A sentence of some length stands here. " * 40).strip() + "\n\nShort."
    got = [r.passage for r in content.passages(spark.createDataFrame([("x", text)], "text_id string, text string")).collect()]
    assert all(len(p) <= 700 and p.endswith(".") for p in got) and len(got) == 3
