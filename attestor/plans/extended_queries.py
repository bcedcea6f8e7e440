"""Queries over records, ledgers, wording and search signals, by inventory id, with DuckDB twins."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from attestor.functions import exprs as X
from attestor.functions import phrases as P
from attestor.operators import ledger as L
from attestor.operators import records as R
from attestor.operators import scoring as S
from attestor.operators import search
from attestor.operators import insight as I
from attestor.plans import star
from attestor.plans.insight_queries import GRS, PAGE, _scored, _labelled, _page, classify_results, retrieval_scores
from attestor.plans.scoring_queries import BOARD_SQL, SENTIMENT, _scores
from attestor.plans.star import BASE_SQL, EVENTS_NOW, SCORES_SQL, age, r

QUERIES, ORACLE_SQL = {}, {}
t = star.table


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


def _events_now():
    return F.lit(EVENTS_NOW).cast("timestamp")


_EVENTS = f"(SELECT *, TIMESTAMP '{EVENTS_NOW}' AS now_ts FROM events)"


# ---- sources ----


@query("a8_contains_filter", "SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%ed%' OR lower(p_type) LIKE '%ed%'")
def contains_filter(spark, sf):
    return t(spark, sf, "part").where(R.contains_any(["p_name", "p_type"], "ED")).select("p_partkey")


@query("a15_spam_scores", f"{BASE_SQL} SELECT document_id, CASE WHEN root_domain % 3 = 0 THEN (root_domain % 100)::DOUBLE END AS spam_score, CASE WHEN root_domain % 3 = 0 AND root_domain % 100 >= 60 THEN 'spam' ELSE {star.CLASS} END AS classification FROM docs")
def spam_scores(spark, sf):
    known = t(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("root_domain"), (F.col("c_custkey") % 100).cast("double").alias("spam_score"))
    rows = R.with_spam(star.documents(spark, sf), known)
    return rows.select("document_id", "spam_score", X.classify_domain(F.col("domain_rank"), F.col("spam_score")).alias("classification"))


@query("a16_page_content", """WITH x AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT n_nationkey, array_to_string(list_filter([trim(r_name), CASE WHEN n_nationkey % 2 = 0 THEN n_name || ' and more' END, 'One.', CASE WHEN n_nationkey % 3 = 0 THEN 'Two.' END, 'end of ' || n_name], lambda s: s IS NOT NULL), chr(10) || chr(10)) AS text FROM x""")
def page_content(spark, sf):
    rows = t(spark, sf, "nation").join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    none = F.lit(None).cast("array<string>")
    page = F.struct(
        F.array(F.concat(F.lit("  "), "r_name", F.lit(" ")), F.when(F.col("n_nationkey") % 2 == 0, F.concat("n_name", F.lit("  and more"))).otherwise(" ")).alias("header"),
        F.when(F.col("n_nationkey") % 3 == 0, F.array(F.lit("One."), F.lit("Two."))).otherwise(F.array(F.lit("One."))).alias("main"), none.alias("secondary"), F.array(F.concat(F.lit("end of\n"), "n_name")).alias("footer"),
    )
    return rows.select("n_nationkey", R.page_content(page).alias("text"))


@query("a21_fresh_responses", f"""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS k FROM {_EVENTS} WHERE ts > now_ts - INTERVAL 3 DAY AND ts <= now_ts) WHERE k = 1""")
def fresh_responses(spark, sf):
    cache = t(spark, sf, "events").select(F.struct("user_id", "event_type").alias("key"), F.col("ts").cast("timestamp").alias("stored_at"), "event_id")
    return L.fresh_responses(cache, _events_now(), 3).select("key.user_id", "key.event_type", "event_id")


@query("a22_stored_vectors", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dimensions, md5(array_to_string(list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * 1000 + 0.5) AS BIGINT)::VARCHAR), ',')) AS digest FROM embeddings")
def stored_vectors(spark, sf):
    """Written as arrays of floats and read back."""
    from attestor.durable import keep

    stored = keep(t(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<float>").alias("vector")), "vectors")
    plain = F.array_join(F.transform("vector", lambda x: F.floor(x.cast("double") * 1000 + 0.5).cast("string")), ",")
    return stored.select("vec_id", F.size("vector").alias("dimensions"), F.md5(plain.cast("binary")).alias("digest"))


@query("a23_request_pages", """WITH q AS (SELECT n_name AS query, (n_nationkey * 700)::BIGINT AS total FROM nation), w AS (SELECT *, least(total, 9000) AS wanted FROM q)
SELECT query, o::BIGINT AS "offset", least(1000, wanted - o)::BIGINT AS "limit", CASE WHEN total <= 9000 THEN 'exhausted' ELSE 'max_documents' END AS stop_reason FROM (SELECT *, unnest(CASE WHEN wanted > 0 THEN range(0, wanted, 1000) ELSE [0] END) AS o FROM w)""")
def request_pages(spark, sf):
    totals = t(spark, sf, "nation").select(F.col("n_name").alias("query"), (F.col("n_nationkey") * 700).cast("long").alias("total"))
    return L.request_pages(totals, page=5000, ceiling=9000)


@query("a24_pasted_pages", """SELECT page_id, CASE WHEN use_direct THEN 'direct' ELSE 'provider' END AS via, CAST(length(CASE WHEN use_direct THEN d ELSE f END) AS BIGINT) AS chars FROM (
SELECT *, length(d) >= 1500 OR length(f) <= length(d) AS use_direct FROM (SELECT page_id, CASE WHEN page_id % 6 <= 4 THEN coalesce(html, '') ELSE '' END AS d, repeat(coalesce(url, ''), 20) AS f FROM pages))""")
def pasted_pages(spark, sf):
    pages = t(spark, sf, "pages")
    found = pages.select("page_id", R.pasted_page(F.col("html"), F.repeat(F.coalesce("url", F.lit("")), 20), F.col("page_id") % 6).alias("x"))
    return found.select("page_id", "x.via", F.length("x.text").cast("long").alias("chars"))


@query("a26_search_requests", f"""SELECT n_regionkey::BIGINT AS entity_id, 'association' AS query_kind, '"' || r_name || '" ' || n_name AS query FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_regionkey, 'entity', '"' || r_name || '"' FROM region""")
def search_requests(spark, sf):
    entities = t(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("entity_id"), F.col("r_name").alias("name"))
    labels = t(spark, sf, "nation").select(F.col("n_regionkey").cast("long").alias("entity_id"), F.col("n_name").alias("label"))
    return L.search_requests(entities, labels)


@query("a28_map_pool", "SELECT c_custkey, CAST(length(c_name) AS BIGINT) AS n FROM customer")
def map_pool(spark, sf):
    return L.map_pool(t(spark, sf, "customer").select("c_custkey", "c_name"), lambda b: b.assign(n=b["c_name"].str.len())[["c_custkey", "n"]], "c_custkey long, n long", 4)


# ---- listings, ledgers, queues ----


@query("b10_optional_filter", "SELECT 'all' AS listing, o_orderkey FROM orders UNION ALL SELECT 'one', o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def optional_filter(spark, sf):
    orders = t(spark, sf, "orders")
    both = [L.listing(orders, o_orderstatus=status).select(F.lit(name).alias("listing"), "o_orderkey") for name, status in (("all", None), ("one", "P"))]
    return both[0].unionByName(both[1])


@query("d20_spend", "SELECT n_regionkey::BIGINT AS entity_id, floor(sum(CAST(c_acctbal * 100 AS BIGINT)) / 100.0::DOUBLE * 10000 + 0.5) / 10000 AS spent FROM (SELECT c_nationkey, round(c_acctbal, 2) AS c_acctbal FROM customer) JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def spend(spark, sf):
    calls = t(spark, sf, "customer").join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").cast("long").alias("entity_id"), F.round("c_acctbal", 2).cast("decimal(12,2)").alias("cost"))
    return L.spend(calls)


@query("f9_clamped_limit", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200")
def clamped_limit(spark, sf):
    """A listing asked for 500 rows gives the 200 it may: the limit is the feature."""
    return L.listing(t(spark, sf, "orders"), limit=500, order=[F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_orderkey")


@query("n6_job_states", f"""WITH e AS (SELECT user_id AS job_id, ts AS "at", CASE event_type WHEN 'purchase' THEN 'done' WHEN 'click' THEN 'progress' WHEN 'view' THEN 'running' ELSE event_type END AS event, now_ts FROM {_EVENTS}),
l AS (SELECT job_id, max("at") AS seen, arg_max(event, ("at", event)) AS last, count(*) FILTER (WHERE event = 'progress') AS steps, any_value(now_ts) AS now_ts FROM e GROUP BY 1)
SELECT job_id, CASE WHEN last IN ('running', 'progress') AND epoch_us(now_ts) - epoch_us(seen) > 300 * 60000000::BIGINT THEN 'orphaned' WHEN last IN ('running', 'progress') THEN 'running' ELSE last END AS state, steps FROM l""")
def job_states(spark, sf):
    kind = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "click", "progress").when(F.col("event_type") == "view", "running").otherwise(F.col("event_type"))
    return L.job_states(t(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("at"), kind.alias("event")), _events_now(), 300)


@query("n7_due", f"SELECT u AS entity_id FROM (SELECT u::BIGINT AS u FROM range(0, 400) x(u)) LEFT JOIN (SELECT user_id, max(ts) AS ran, any_value(now_ts) AS now_ts FROM {_EVENTS} WHERE event_type = 'purchase' GROUP BY 1) ON u = user_id WHERE ran IS NULL OR ran <= now_ts - INTERVAL 1 DAY")
def due(spark, sf):
    runs = t(spark, sf, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("entity_id"), F.col("ts").cast("timestamp").alias("ran_at"))
    return L.due(spark.range(400).toDF("entity_id"), runs, _events_now(), 1)


@query("p7_ceilings", "SELECT user_id AS entity_id, event_id AS call_id, user_id % 5 = 0 OR coalesce(sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 100000 AS allowed FROM (SELECT *, CAST(floor(value * 100) AS BIGINT) AS c FROM events)")
def ceilings(spark, sf):
    calls = t(spark, sf, "events").select(F.col("user_id").alias("entity_id"), F.col("ts").alias("called_at"), F.col("event_id").alias("call_id"), F.floor(F.col("value") * 100).cast("long").alias("cost"))
    limits = calls.select("entity_id").distinct().where("entity_id % 5 <> 0").withColumn("ceiling", F.lit(100_000.0))
    return L.over_ceiling(calls, limits)


@query("p8_breaker", """WITH RECURSIVE c AS (SELECT user_id, event_id, event_type <> 'view' AND value > 30 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS call_id, TRUE AS available, 0 AS streak FROM (SELECT DISTINCT user_id FROM c) UNION ALL
SELECT c.user_id, c.k, c.event_id, w.streak < 5, CASE WHEN c.ok THEN 0 ELSE w.streak + 1 END FROM w JOIN c ON c.user_id = w.user_id AND c.k = w.k + 1)
SELECT user_id AS provider, call_id, available FROM w WHERE k > 0""")
def breaker(spark, sf):
    calls = t(spark, sf, "events").select(F.col("user_id").alias("provider"), F.col("ts").alias("called_at"), F.col("event_id").alias("call_id"), ((F.col("event_type") != "view") & (F.col("value") > 30)).alias("ok"))
    return L.breaker_states(calls)


@query("p9_statement", "SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = 2 AND n_nationkey > 3")
def statement(spark, sf):
    tables = {"st_nation": t(spark, sf, "nation"), "st_region": t(spark, sf, "region")}
    return L.run_statement(spark, "SELECT n_nationkey, r_name FROM st_nation JOIN st_region ON n_regionkey = r_regionkey WHERE r_regionkey = :region AND n_nationkey > :least", tables, region=2, least=3)


# ---- wording ----


@query("h14_surnames", """SELECT * FROM (VALUES (1, 'Carver'), (2, 'Carver'), (3, NULL), (4, NULL), (5, NULL), (6, 'O''Neill'), (7, NULL)) v(k, surname)""")
def surnames(spark, sf):
    rows = [(1, "John Carver", "person"), (2, "Dr. John Q. Carver, Jr. PhD", "person"), (3, "John Lee", "person"), (4, "Carver", "person"), (5, "Carver Holdings", "organization"), (6, "Mary  O'Neill", "person"), (7, None, "person")]
    return spark.createDataFrame(rows, "k int, name string, kind string").select("k", P.surname(F.col("name"), F.col("kind")).alias("surname"))


@query("h19_usable_aliases", """SELECT * FROM (VALUES (1, 'Harbor Trust,The Harbor', 'Harbor Foundation:block,Harbor Trust:block,The Harbor:block,North Way:warn'), (2, 'Ray Gilmore', 'Raymond Gilmore:block,Ray Gilmore:block,gilmore:block')) v(k, usable, avoid)""")
def usable_aliases(spark, sf):
    rows = [
        (1, "Harbor Foundation", "named_entity", "organization", ["Harbor Trust", "harbor foundation", "gift of John Carver", " The Harbor ", "harbor-trust", "a name of far too many words here"], "John Carver", ["North Way", "Carver"]),
        (2, "Raymond Gilmore", "named_entity", "person", ["Ray Gilmore"], "John Carver", ["xy"]),
    ]
    df = spark.createDataFrame(rows, "k int, label string, kind string, category string, aliases array<string>, entity string, carriers array<string>")
    c = F.col
    avoid = P.avoid_terms(c("label"), c("kind"), c("category"), c("aliases"), c("entity"), c("carriers"))
    return df.select("k", F.array_join(P.usable_aliases(c("aliases"), c("entity"), c("label")), ",").alias("usable"), F.array_join(F.transform(avoid, lambda x: F.concat(x["term"], F.lit(":"), x["severity"])), ",").alias("avoid"))


@query("h21_page_titles", """SELECT * FROM (VALUES (1, 'A real title', FALSE), (2, 'The line that is a headline', TRUE), (3, 'First words of it', TRUE), (4, NULL, FALSE)) v(k, title, byline)""")
def page_titles(spark, sf):
    rows = [
        (1, " A real   title ", "text", "<p>by John Carver</p>", "Represented by John Carver"), (2, "Just a moment...", "Menu\n\nThe line that is a headline\nmore of it here", '<meta name="author" content="John  Carver">', ""),
        (3, None, "404 not found here\nFirst words of it", "", "Title\nBy John Carver\ntext"), (4, "Access denied", "short", None, None),
    ]
    df = spark.createDataFrame(rows, "k int, title string, text string, html string, body string")
    return df.select("k", P.page_title(F.col("title"), F.col("text")).alias("title"), P.byline_names(F.col("html"), F.col("body"), ["John Carver"]).alias("byline"))


@query("h23_number_words", "SELECT n_nationkey, coalesce(['no', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten'][n_nationkey + 1], n_nationkey::VARCHAR) || CASE WHEN n_nationkey = 1 THEN ' source' ELSE ' sources' END AS counted, upper(substr(lower(n_name), 1, 1)) || substr(lower(n_name), 2) AS name FROM nation")
def number_words(spark, sf):
    return t(spark, sf, "nation").select("n_nationkey", P.plural(F.col("n_nationkey"), "source").alias("counted"), P.capitalise(F.lower("n_name")).alias("name"))


@query("h26_formats", """WITH s AS (SELECT document_id, change, share FROM (SELECT o_orderkey AS document_id, (o_orderkey % 400 - 150) / 100.0::DOUBLE AS change, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE (o_orderkey % 1000) / 1000.0::DOUBLE END AS share FROM orders))
SELECT document_id, CASE WHEN change >= 0 THEN '+' ELSE '' END || CAST(floor(change * 100 + 0.5) AS BIGINT)::VARCHAR || '%' AS change, CASE WHEN share IS NULL THEN '—' WHEN (document_id % 1000) % 10 = 0 THEN ((document_id % 1000) // 10)::VARCHAR || '%' ELSE printf('%.1f', floor(share * 100 * 10 + 0.5) / 10) || '%' END AS share,
CASE document_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'a' WHEN 2 THEN 'a and b' ELSE 'a, b and c' END AS listed, CASE WHEN document_id % 2 = 0 THEN repeat('x', 109) || '…' ELSE repeat('x', 110) END AS short FROM s""")
def formats(spark, sf):
    key = F.col("o_orderkey")
    share = F.when(key % 9 != 0, (key % 1000) / 1000.0)
    listed = F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 1, (key % 4).cast("int"))
    return t(spark, sf, "orders").select(
        key.alias("document_id"), P.change((key % 400 - 150) / 100.0).alias("change"), P.percent(share).alias("share"), P.list_of(listed).alias("listed"), P.shorten(F.repeat(F.lit("x"), F.when(key % 2 == 0, 111).otherwise(110))).alias("short"),
    )


@query("h31_stop_reasons", """SELECT * FROM (VALUES (1, 'provider corpus exhausted'), (2, 'stopped at the document ceiling of 12,345 available'), (3, 'stopped at the document ceiling'), (4, 'stopped at the cost ceiling'), (5, 'stopped: cancelled'), (6, 'unknown')) v(k, reason)""")
def stop_reasons(spark, sf):
    rows = [(1, "exhausted", 5), (2, "max_documents", 12_345), (3, "max_documents", None), (4, "budget", 9), (5, "cancelled", None), (6, None, None)]
    return spark.createDataFrame(rows, "k int, r string, n long").select("k", I.stop_reason_text(F.col("r"), F.col("n")).alias("reason"))


# ---- search page ----

_PAGE_ITEMS = [
    {"type": "organic", "title": "x"}, {"type": "related_searches", "items": ["carver lawsuit", " carver lawsuit ", "", {"title": "no string"}, "carver wife"]},
    {"type": "people_also_ask", "items": [{"title": "Who is Carver?"}, {"title": None}, {}]}, {"type": "people_also_search", "items": ["Mary Jones", {"title": "Bob Lee"}]},
    {"type": "top_stories", "items": [{"title": "S1", "url": "u1", "domain": "d.example"}, {"url": "u2"}]},
    {"type": "knowledge_graph", "title": "John Carver", "subtitle": "Lawyer", "items": [{"type": "knowledge_graph_row_item", "title": "Born", "text": "1960", "links": [{"domain": "w.example"}, {"domain": "w.example"}]}, {"type": "other", "text": "no"}]},
]


@query("l2_search_signals", """SELECT * FROM (VALUES (1, 'carver lawsuit,carver wife', 'Who is Carver?', 'Mary Jones,Bob Lee', 'S1@d.example', 'Lawyer', 'Born=1960', 'w.example', 'Lawyer | 1960'), (2, '', '', '', '', NULL, NULL, NULL, '')) v(k, related, asked, searched, stories, subtitle, facts, sources, panel)""")
def search_signals(spark, sf):
    found = spark.createDataFrame([(1, json.dumps(_PAGE_ITEMS)), (2, "not json")], "k int, items string").select("k", search.search_signals(F.col("items")).alias("s"))
    g = F.col("s.knowledge_graph")
    return found.select(
        "k", F.array_join("s.related_searches", ",").alias("related"), F.array_join("s.people_also_ask", ",").alias("asked"), F.array_join("s.people_also_search", ",").alias("searched"),
        F.array_join(F.transform("s.top_stories", lambda x: F.concat(x["title"], F.lit("@"), x["source"])), ",").alias("stories"), g["subtitle"].alias("subtitle"),
        F.array_join(F.transform(g["facts"], lambda x: F.concat(x["label"], F.lit("="), x["text"])), ",").alias("facts"), F.array_join(g["sources"], ",").alias("sources"), search.surface_texts(F.col("s"))["panel"].alias("panel"),
    )


@query("m40_search_view", f"""{SCORES_SQL}, {PAGE}, shown AS (SELECT r_regionkey::BIGINT AS entity_id, 'brand 1 reviews | brand ' || (r_regionkey + 2) AS related, 'who owns brand 12?' AS also_ask, 'maker of Brand-' || (r_regionkey + 3) AS panel FROM region),
total AS (SELECT entity_id, count(*) AS total FROM page GROUP BY 1), x AS (SELECT entity_id, association_id, count(*) AS results, count(*) FILTER (WHERE rank <= 10) AS top10, min(rank) AS best_rank FROM (SELECT DISTINCT entity_id, association_id, rank FROM classified WHERE association_id IS NOT NULL) GROUP BY 1, 2),
y AS (SELECT *, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY results DESC, best_rank, association_id) AS INTEGER) AS place, ' ' || lower(replace(association_id, '#', ' ')) || ' ' AS form FROM x)
SELECT y.entity_id, association_id, place, results, top10, best_rank, {r('results::DOUBLE / total', 3)} AS organic_share, contains(' ' || trim(regexp_replace(lower(related), '[^a-z0-9]+', ' ', 'g')) || ' ', form) AS in_related,
contains(' ' || trim(regexp_replace(lower(also_ask), '[^a-z0-9]+', ' ', 'g')) || ' ', form) AS in_also_ask, contains(' ' || trim(regexp_replace(lower(panel), '[^a-z0-9]+', ' ', 'g')) || ' ', form) AS in_panel
FROM y JOIN total USING (entity_id) JOIN shown USING (entity_id) WHERE place <= 30""")
def search_view(spark, sf):
    region = t(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("entity_id"))
    shown = region.select(
        "entity_id", F.concat(F.lit("brand 1 reviews | brand "), F.col("entity_id") + 2).alias("related"), F.lit("who owns brand 12?").alias("also_ask"), F.concat(F.lit("maker of Brand-"), F.col("entity_id") + 3).alias("panel")
    )
    labels = t(spark, sf, "part").select(F.col("p_brand").alias("association_id")).distinct().withColumn("forms", F.array("association_id"))
    return search.search_view(classify_results(spark, sf), _page(spark, sf), labels, shown)


@query("e16_top_by_document", f"""{SCORES_SQL} SELECT document_id, association_id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, association_id) AS place FROM (SELECT document_id, association_id, max(evidence_score) AS score FROM evidence_scores GROUP BY 1, 2)) WHERE place <= 5""")
def top_by_document(spark, sf):
    return search.top_by_document(S.evidence_scores(star.documents(spark, sf), star.evidence(spark, sf), star.now()))


_FULL = f"""{BOARD_SQL}, {SENTIMENT}, {PAGE}, {GRS}, aged AS (SELECT *, CASE WHEN effective_date IS NOT NULL THEN {age('effective_date')} END AS age FROM adscores, params),
fresh AS (SELECT entity_id, association_id, {r('min(age)', 1)} AS latest_mention_age_days, {r('median(age)', 1)} AS median_age_days, {r("sum(CASE WHEN age < 365 THEN undecayed_micros ELSE 0 END)::DOUBLE / nullif(sum(undecayed_micros), 0)", 4)} AS evidence_share_under_365d FROM aged GROUP BY 1, 2)"""


@query("m32_full_board", f"""{_FULL} SELECT b.entity_id, b.association_id, b.pias, b.band, b.momentum, coalesce(g.grs, 0.0) AS grs, {r('coalesce(g.grs, 0.0) - b.current_corpus_share * 100', 1)} AS retrieval_gap, s.label AS sentiment, f.latest_mention_age_days, f.median_age_days, f.evidence_share_under_365d, b.association_id = 'Brand#1' AS identity
FROM board b LEFT JOIN grs g ON g.entity_id = b.entity_id AND g.association_id = b.association_id JOIN sent s ON s.entity_id = b.entity_id AND s.association_id = b.association_id JOIN fresh f ON f.entity_id = b.entity_id AND f.association_id = b.association_id""")
def full_board(spark, sf):
    """The leaderboard with retrieval, freshness, sentiment and the mark of what is part of the identity."""
    scores, board = _scored(spark, sf)
    markers = t(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("entity_id"), F.lit("brand 1").alias("value"))
    board = I.full_board(board, retrieval_scores(spark, sf, scores), S.freshness(scores, star.now()), S.sentiment(scores, star.documents(spark, sf)), markers)
    return board.select("entity_id", "association_id", "pias", "band", "momentum", "grs", "retrieval_gap", "sentiment", "latest_mention_age_days", "median_age_days", "evidence_share_under_365d", "identity")


# ---- records ----


@query("m12_split", "SELECT l_orderkey, l_partkey, CASE WHEN l_returnflag = 'R' AND l_linenumber % 2 = 0 THEN 'split-' || l_linenumber ELSE 'a' || l_linenumber END AS association_id FROM lineitem")
def split(spark, sf):
    ev = t(spark, sf, "lineitem").select(F.concat(F.lit("a"), "l_linenumber").alias("association_id"), F.col("l_returnflag").alias("surface_form"), "l_orderkey", "l_partkey", "l_linenumber")
    splits = ev.where("l_linenumber % 2 = 0 AND surface_form = 'R'").select("association_id", "surface_form", F.concat(F.lit("split-"), "l_linenumber").alias("new_association_id")).distinct()
    return R.split_association(ev, splits).select("l_orderkey", "l_partkey", "association_id")


@query("m12_surface_forms", "SELECT l_linenumber::VARCHAR AS association_id, l_returnflag AS surface_form, count(*) AS occurrences FROM lineitem GROUP BY 1, 2")
def surface_forms(spark, sf):
    return R.surface_forms(t(spark, sf, "lineitem").select(F.col("l_linenumber").cast("string").alias("association_id"), F.concat(F.lit(" "), "l_returnflag", F.lit("  ")).alias("surface_form")))


@query("p3_rekeyed", "SELECT CASE WHEN l_linenumber > 2 THEN 2 ELSE l_linenumber END AS association_id, l_orderkey AS document_id, count(*) AS mentions, max(l_quantity) AS best FROM lineitem GROUP BY 1, 2")
def rekeyed(spark, sf):
    rows = t(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("association_id"), F.col("l_orderkey").alias("document_id")).agg(F.count("*").alias("mentions"), F.max("l_quantity").alias("best"))
    merges = spark.createDataFrame([(i, 2) for i in range(3, 20)], "association_id int, target int")
    return R.rekeyed(rows, merges, ["mentions"], ["best"])


@query("m53_support", f"{BASE_SQL} SELECT d.entity_id, e.association_id, count(*) AS sources, count(DISTINCT coalesce('c' || cluster_id::VARCHAR, 'd' || root_domain::VARCHAR)) AS independent_sources FROM (SELECT DISTINCT association_id, document_id FROM ev) e JOIN docs d USING (document_id) WHERE verdict = 'accept' AND document_id % 10 <> 0 GROUP BY 1, 2")
def support(spark, sf):
    docs = star.documents(spark, sf).withColumn("canonical_url", F.concat(F.lit("u"), "document_id"))
    return R.support(star.evidence(spark, sf), docs, docs.where("document_id % 10 = 0").select("canonical_url"))


@query("m53_resolved_facts", """SELECT * FROM (VALUES (1, 'x', 3, 'resolved'), (2, 'x', 3, 'resolved'), (3, NULL, 0, 'unsupported'), (4, 'x', 3, 'resolved'), (5, 'z', 0, 'unsupported'), (6, NULL, 0, 'unsupported')) v(claim_id, association_id, sources, resolution)""")
def resolved_facts(spark, sf):
    known = spark.createDataFrame([(1, "x", "Venture Capital", "active", None), (1, "y", "VC funds", "merged", "x"), (1, "z", "Art", "active", None), (1, "q", "Chess", "retired", None)], "entity_id long, association_id string, label string, status string, merged_into string")
    claims = [(1, 1, "venture capital"), (1, 2, "VC Fund"), (1, 3, "chess"), (1, 4, "risk money"), (1, 5, "art"), (2, 6, "art")]
    aliases = spark.createDataFrame([("x", "Risk Money"), ("z", "Venture Capital")], "association_id string, surface_form string")
    supported = spark.createDataFrame([(1, "x", 3)], "entity_id long, association_id string, sources long")
    found = R.resolve_facts(spark.createDataFrame(claims, "entity_id long, claim_id int, claim string"), known, aliases, supported)
    return found.select("claim_id", "association_id", F.col("sources").cast("int").alias("sources"), "resolution")


@query("m54_suggest_adverse", f"""{BASE_SQL}, s AS (SELECT d.entity_id, e.association_id, sum(e.negative) / count(*) AS share, count(DISTINCT e.document_id) AS documents FROM ev e JOIN docs d USING (document_id) WHERE e.association_id NOT IN ('Brand#2', 'Brand#3') GROUP BY 1, 2)
SELECT entity_id, association_id, documents, {r('share', 2)} AS negative_share, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY documents DESC, association_id) AS place FROM s WHERE documents >= 5 AND share >= 0.3) WHERE place <= 10""")
def suggest_adverse(spark, sf):
    docs = star.documents(spark, sf)
    entities = t(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("entity_id"))
    settings = entities.select("entity_id", F.lit("Brand#2").alias("association_id"), F.lit("adverse").alias("polarity"), F.lit(1).alias("set_at"))
    markers = entities.select("entity_id", F.lit("brand 3").alias("value"))
    return R.suggest_adverse(star.evidence(spark, sf), docs, R.polarity(settings), markers, share=0.3)


@query("m54_polarity", "SELECT user_id AS entity_id, event_type AS association_id, polarity FROM (SELECT user_id, event_type, CASE WHEN value > 40 THEN 'adverse' ELSE NULL END AS polarity, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, CASE WHEN value > 40 THEN 'adverse' ELSE '' END DESC) AS k FROM events) WHERE k = 1 AND polarity IS NOT NULL")
def polarity(spark, sf):
    rows = t(spark, sf, "events").select(F.col("user_id").alias("entity_id"), F.col("event_type").alias("association_id"), F.when(F.col("value") > 40, "adverse").alias("polarity"), F.col("ts").alias("set_at"))
    return R.polarity(rows)


@query("m69_asset_report", """WITH a AS (SELECT o_custkey % 50 AS entity_id, o_orderkey AS asset_id, o_orderkey % 7 AS k FROM orders), c AS (SELECT asset_id, entity_id, CASE WHEN k = 0 THEN NULL WHEN k < 3 THEN 'pass' WHEN k = 3 THEN 'insufficient' ELSE 'warn' END AS c5, CASE WHEN k = 0 THEN NULL WHEN k % 2 = 0 THEN 'warn' ELSE 'pass' END AS c8, CASE WHEN k = 0 THEN NULL WHEN k = 5 THEN 'fail' ELSE 'pass' END AS c9 FROM a)
SELECT entity_id, count(*) AS live, count(c5) AS audited, floor(count(*) FILTER (WHERE c9 = 'fail')::DOUBLE / nullif(count(c5), 0) * 10000 + 0.5) / 10000 AS restatement_share, count(*) FILTER (WHERE c5 NOT IN ('pass', 'insufficient') AND c8 = 'warn') AS rewrite_candidates FROM c GROUP BY 1""")
def asset_report(spark, sf):
    rows = t(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("entity_id"), F.col("o_orderkey").alias("asset_id"), (F.col("o_orderkey") % 7).alias("k"))
    k = F.col("k")
    results = {"C5": F.when(k < 3, "pass").when(k == 3, "insufficient").otherwise("warn"), "C8": F.when(k % 2 == 0, "warn").otherwise("pass"), "C9": F.when(k == 5, "fail").otherwise("pass")}
    checks = rows.where("k > 0").select("asset_id", F.explode(F.array(*(F.struct(F.lit(c).alias("check_id"), v.alias("result")) for c, v in results.items()))).alias("x")).select("asset_id", "x.*")
    return R.asset_report(rows.drop("k"), checks)


@query("m69_assets", """SELECT user_id AS entity_id, 'https://www.s' || (event_id % 3) || '.example/p' AS url, arg_max(CASE WHEN event_type = 'purchase' THEN 'owned' ELSE 'placed' END, (ts, event_id)) AS kind, arg_max(CASE WHEN event_type = 'click' THEN 'retired' ELSE 'live' END, (ts, event_id)) AS status, arg_max(event_type, (ts, event_id)) FILTER (WHERE event_type <> 'view') AS label, 's' || (event_id % 3) || '.example' AS host_domain FROM events GROUP BY 1, 2, 6""")
def assets(spark, sf):
    e = t(spark, sf, "events")
    url = F.concat(F.lit("https://www.s"), F.col("event_id") % 3, F.lit(".example/p"))
    return R.assets(e.select(
        F.col("user_id").alias("entity_id"), url.alias("url"), F.when(F.col("event_type") == "purchase", "owned").otherwise("placed").alias("kind"), F.when(F.col("event_type") == "click", "retired").otherwise("live").alias("status"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("label"), F.struct("ts", "event_id").alias("at"),
    ))


@query("m72_markers", """SELECT entity_id, kind, value, weight::DOUBLE AS weight, polarity FROM (VALUES (1, 'url', 'carver.example', 0.9, 1), (1, 'other', 'plays chess', 0.4, -1), (1, 'occupation', 'lawyer', 0.5, 1)) v(entity_id, kind, value, weight, polarity)""")
def markers(spark, sf):
    rows = [(1, "url", "https://www.carver.example/about", None, 1, 1), (1, "url", "carver.example", 0.9, 1, 2), (1, "hobby", " plays  chess", None, -1, 1), (1, "occupation", "lawyer", None, 1, 1), (1, "other", "  ", None, 1, 1)]
    found = R.normal_markers(spark.createDataFrame(rows, "entity_id int, kind string, value string, weight double, polarity int, at int"))
    return found.select("entity_id", "kind", "value", "weight", "polarity")


@query("m72_aliases", "SELECT n_regionkey AS entity_id, n_name AS alias, CASE WHEN n_nationkey % 2 = 0 THEN 'profile' ELSE 'user' END AS origin FROM nation")
def aliases(spark, sf):
    n = t(spark, sf, "nation").select(F.col("n_regionkey").alias("entity_id"), F.col("n_name").alias("alias"), "n_nationkey")
    known = n.where("n_nationkey % 2 = 0").select("entity_id", "alias", F.lit("profile").alias("origin"), F.lit(True).alias("searchable"))
    added = n.select("entity_id", F.concat(F.lit(" "), "alias", F.lit("  ")).alias("alias"), F.lit("user").alias("origin"), F.lit(True).alias("searchable"))
    return R.add_aliases(known, added).drop("searchable")


@query("m73_new_drafts", r"SELECT doc_id AS draft_id, sha256(b) AS text_hash, doc_id % 2 = 0 AS reused FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\s\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{3000}]+', ' ', 'g')) AS b FROM documents) WHERE length(b) >= 80")
def new_drafts(spark, sf):
    from attestor.functions.hashing import content_hash

    docs = t(spark, sf, "documents").select(F.col("doc_id").alias("draft_id"), "text")
    audited = docs.where("draft_id % 2 = 0").select("draft_id", content_hash(F.col("text")).alias("text_hash"))
    return R.new_drafts(docs, audited)


@query("m74_own_domains", "SELECT DISTINCT n_regionkey AS entity_id, 's' || n_nationkey || '.example' AS domain FROM nation WHERE n_nationkey % 3 <> 2")
def own_domains(spark, sf):
    n = t(spark, sf, "nation").select(F.col("n_regionkey").alias("entity_id"), "n_nationkey", F.concat(F.lit("WWW.S"), "n_nationkey", F.lit(".example")).alias("host"))
    m = n.select("entity_id", F.lit("url").alias("kind"), F.col("host").alias("value"), F.when(F.col("n_nationkey") % 3 == 0, 1).otherwise(-1).alias("polarity"))
    a = n.select("entity_id", F.when(F.col("n_nationkey") % 3 == 1, "owned").otherwise("placed").alias("kind"), F.col("host").alias("host_domain"))
    return R.own_domains(m, a)


@query("m78_tier_evidence", f"{SCORES_SQL} SELECT DISTINCT classification AS tier, {r('0.95::DOUBLE * 0.85 * 0.75 * (CASE classification WHEN ' + chr(39) + 'major' + chr(39) + ' THEN 1.0 WHEN ' + chr(39) + 'specialist' + chr(39) + ' THEN 0.8 WHEN ' + chr(39) + 'ordinary' + chr(39) + ' THEN 0.6 WHEN ' + chr(39) + 'blog' + chr(39) + ' THEN 0.35 ELSE 0.2 END)', 6)} AS evidence FROM reliable")
def tier_evidence(spark, sf):
    return S.document_reliability(star.documents(spark, sf)).select(F.col("classification").alias("tier")).distinct().select("tier", R.tier_evidence(F.col("tier")).alias("evidence"))
