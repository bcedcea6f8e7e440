"""Further queries by inventory id, small ones first, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from attestor.durable import settle
from attestor.functions import exprs as X
from attestor.functions import hashing as H
from attestor.functions import html as P
from attestor.functions import text as T
from attestor.operators import audit, content, duplicates, identity
from attestor.operators import corrections as K
from attestor.operators import insight as I
from attestor.operators import scoring as S
from attestor.operators import search as R
from attestor.plans import insight_queries, star
from attestor.plans.insight_queries import GRS, LABELLED, PAGE, _board, _labelled, _page, _scored, classify_results, older_board_sql, retrieval_gap, retrieval_scores, what_if
from attestor.plans.scoring_queries import BOARD_SQL, _scores
from attestor.plans.star import BASE_SQL, SCORES_SQL, age, r
from attestor.plans.text_queries import SQUEEZE, _docs
from attestor.sources import candidates

QUERIES, ORACLE_SQL = {}, {}
t = star.table
_WHAT_IF_SQL = insight_queries.ORACLE_SQL["m62_what_if"]


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


@query("a5_normalise_candidates", r"SELECT page_id FROM pages WHERE url IS NOT NULL AND trim(url) <> ''")
def normalise(spark, sf):
    rows = candidates.normalise(t(spark, sf, "pages").select("url", F.col("page_id").cast("string").alias("provider_ref")))
    return rows.select(F.col("provider_ref").cast("long").alias("page_id"))


@query("a18_public_urls", r"SELECT page_id FROM pages WHERE regexp_matches(url, '^https?://[^/@]+([/?#]|$)') AND NOT regexp_matches(lower(url), '^https?://([^/]*\.)?(localhost|local|internal)([/:?#]|$)')")
def public_urls(spark, sf):
    return t(spark, sf, "pages").where(candidates.is_public_url(F.col("url"))).select("page_id")


@query("b8_sentence_like", rf"""WITH l AS (SELECT DISTINCT text FROM conversations), n AS (SELECT text, {SQUEEZE} AS s FROM l) SELECT md5(coalesce(text, '')) AS k, s = '' OR len(string_split(s, ' ')) > 8 OR (len(string_split(s, ' ')) >= 5
AND regexp_matches(s, '(?i)\b(is|was|are|were|has|have|had|formed by|owned by|founded by|which|that|who)\b')) AS sentence_like FROM n""")
def sentence_like(spark, sf):
    rows = t(spark, sf, "conversations").select(F.col("text").alias("label")).distinct()
    return rows.select(F.md5(F.coalesce("label", F.lit("")).cast("binary")).alias("k"), T.sentence_like_column(F.col("label")).alias("sentence_like"))


@query("c7_displaced_documents", f"{BASE_SQL} SELECT entity_id, document_id FROM docs WHERE verdict = 'accept' AND document_id NOT IN (SELECT document_id FROM ev WHERE association_id = 'Brand#1')")
def displaced(spark, sf):
    return content.displaced_documents(star.evidence(spark, sf), star.documents(spark, sf), "Brand#1")


@query("c12_band_pairs", None)
def band_pairs(spark, sf):
    return duplicates.banded_pairs(duplicates.fingerprints(_docs(spark, sf))).select("document_id_a", "document_id_b", H.hamming(F.col("simhash_a"), F.col("simhash_b")).alias("bits"))


@query("c21_text_match", f"""WITH b AS (SELECT DISTINCT p_brand AS label, lower(replace(p_brand, '#', ' ')) AS run FROM part), p AS (SELECT p_partkey, ' ' || lower(replace(p_brand, '#', ' ')) || ' of ' || lower(p_name) || ' ' AS title FROM part)
SELECT p_partkey AS rank, label AS association_id FROM p JOIN b ON contains(p.title, ' ' || b.run || ' ')""")
def text_match(spark, sf):
    part = t(spark, sf, "part")
    results = part.select(F.lit(1).alias("entity_id"), F.col("p_partkey").alias("rank"), F.concat("p_brand", F.lit(" of "), "p_name").alias("title"))
    labels = part.select(F.lit(1).alias("entity_id"), F.col("p_brand").alias("association_id"), F.col("p_brand").alias("label")).distinct()
    return R.match_by_text(results, labels).select("rank", "association_id")


@query("d5_domains_per_month", f"{SCORES_SQL} SELECT a.association_id, strftime(a.effective_date, '%Y-%m') AS month, count(DISTINCT d.root_domain) AS domains FROM adscores a JOIN docs d USING (document_id) WHERE a.effective_date IS NOT NULL GROUP BY 1, 2")
def domains_per_month(spark, sf):
    rows = _scores(spark, sf).where("effective_date IS NOT NULL").join(star.documents(spark, sf).select("document_id", "root_domain"), "document_id")
    return rows.groupBy("association_id", F.date_format("effective_date", "yyyy-MM").alias("month")).agg(F.countDistinct("root_domain").alias("domains"))


@query("d10_max_normalised", f"{SCORES_SQL}, s AS (SELECT entity_id, association_id, CAST(sum(undecayed_micros) AS BIGINT) AS w FROM adscores GROUP BY 1, 2) SELECT entity_id, association_id, {r('w::DOUBLE / (max(w) OVER (PARTITION BY entity_id))::DOUBLE * 100', 4)} AS share FROM s")
def max_normalised(spark, sf):
    sums = _scores(spark, sf).groupBy("entity_id", "association_id").agg(F.sum("undecayed_micros").cast("double").alias("w"))
    return sums.select("entity_id", "association_id", X.half_up(X.normalise_within(F.col("w"), F.max("w").over(Window.partitionBy("entity_id"))), 4).alias("share"))


@query("d19_usage", "SELECT event_type AS provider, 'k' AS endpoint, count(*) AS calls, count(*) FILTER (WHERE value <= 0) AS failures FROM events GROUP BY 1")
def usage(spark, sf):
    calls = t(spark, sf, "events").select(F.col("event_type").alias("provider"), F.lit("k").alias("endpoint"), (F.col("value") > 0).alias("ok"), F.col("value").alias("cost"))
    return K.usage(calls).drop("cost")


@query("d23_document_ranks", f"{SCORES_SQL}, {PAGE} SELECT document_id, min(rank) AS rank FROM page GROUP BY 1")
def document_ranks(spark, sf):
    return R.document_ranks(_page(spark, sf))


@query("e3_domain_ordinal", f"{SCORES_SQL} SELECT association_id, root_domain, max(ordinal) AS last FROM independent GROUP BY 1, 2")
def domain_ordinal(spark, sf):
    docs, ev = star.documents(spark, sf), star.evidence(spark, sf)
    pairs = ev.select("association_id", "document_id").distinct().join(S.document_reliability(docs).select("entity_id", "document_id", "root_domain", "cluster_id", "cluster_kind", "is_primary", "reliability"), "document_id")
    return S.assign_independence(pairs).groupBy("association_id", "root_domain").agg(F.max(F.col("ordinal").cast("long")).alias("last"))


@query("e7_renumber", f"{BASE_SQL} SELECT entity_id, document_id, row_number() OVER (PARTITION BY entity_id ORDER BY coalesce(-prominence, 0), document_id) AS rank FROM docs")
def renumber(spark, sf):
    order = Window.partitionBy("entity_id").orderBy(F.coalesce(-F.col("prominence"), F.lit(0.0)), "document_id")
    return star.documents(spark, sf).select("entity_id", "document_id", F.row_number().over(order).cast("long").alias("rank"))


@query("e13_carry_forward", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS asked FROM conversations")
def carry_forward(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return t(spark, sf, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w).alias("asked"))


@query("f1_ranked_board", f"{BOARD_SQL} SELECT entity_id, association_id, row_number() OVER (PARTITION BY entity_id ORDER BY pias DESC, association_id) AS place FROM board")
def ranked_board(spark, sf):
    return _board(spark, sf).select("entity_id", "association_id", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("pias"), "association_id")).cast("long").alias("place"))


@query("f7_gap_order", f"{BOARD_SQL}, {PAGE}, {GRS}, g AS (SELECT b.entity_id, b.association_id, {r('coalesce(grs.grs, 0.0) - current_corpus_share * 100', 1)} AS gap FROM board b LEFT JOIN grs ON grs.entity_id = b.entity_id AND grs.association_id = b.association_id) SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY abs(gap) DESC, association_id) AS place FROM g")
def gap_order(spark, sf):
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc(F.abs("gap")), "association_id")).cast("long")
    return retrieval_gap(spark, sf).select("entity_id", "association_id", "gap", place.alias("place"))


@query("g3_missing_aliases", "SELECT n_nationkey, len(list_filter([lower(n_name), n_name || ' x'], lambda a: NOT list_contains([lower(n_name)], lower(a)))) AS missing FROM nation")
def missing_aliases(spark, sf):
    known, queried = F.array(F.lower("n_name"), F.concat("n_name", F.lit(" x"))), F.array(F.upper("n_name"))
    return t(spark, sf, "nation").select("n_nationkey", F.size(identity.missing_aliases(known, queried)).cast("long").alias("missing"))


@query("g6_title_similarity", r"""WITH w AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type), ' ')) AS b FROM part) SELECT p_partkey, len(list_intersect(a, b))::DOUBLE / greatest(len(a), len(b)) AS similarity FROM w""")
def title_similarity(spark, sf):
    return t(spark, sf, "part").select("p_partkey", H.title_similarity(F.col("p_name"), F.col("p_type")).alias("similarity"))


@query("g8_ordered_dedupe", "SELECT lower(o_orderpriority) AS term, min(o_orderkey) AS place FROM orders GROUP BY 1")
def ordered_dedupe(spark, sf):
    return t(spark, sf, "orders").groupBy(F.lower("o_orderpriority").alias("term")).agg(F.min("o_orderkey").alias("place"))


@query("h11_occurrences")
def occurrences(spark, sf):
    return _docs(spark, sf).select("document_id", F.explode(T.occurrence_spans(F.col("text"), ["of the", "de la", "und"])).alias("s")).select("document_id", "s.*")


@query("h17_unverified_quotes", """SELECT p_partkey AS text_id, p_name || ' of ' || p_type AS quote FROM part WHERE NOT (p_type = 'ECONOMY' AND p_name IN ('small ring', 'red widget')) AND p_partkey % 3 <> 0""")
def unverified_quotes(spark, sf):
    """Every part is quoted, by name and type; the passages hold two of them, and a third of the quotes are to be confirmed."""
    quote = F.concat(F.when(F.col("p_partkey") % 3 == 0, "[CONFIRM: who] ").otherwise(""), "p_name", F.lit(" of "), "p_type")
    texts = t(spark, sf, "part").select(F.col("p_partkey").alias("text_id"), F.concat(F.lit("They said “"), quote, F.lit("” and \"so it is\" today.")).alias("text"))
    return audit.unverified_quotes(texts, ["A small ring of economy, they say.", "Red Widget: of economy!", "so it is"])


@query("h20_target_coverage")
def target_coverage(spark, sf):
    return content.target_coverage(_docs(spark, sf).withColumn("title", F.substring("text", 1, 60)), "the", ["of the"], ["and"])


@query("h24_unsupported_events", """SELECT n_nationkey AS text_id, unnest(list_filter([CASE WHEN n_nationkey % 3 = 0 THEN 'join' END, CASE WHEN n_nationkey % 2 = 0 THEN 'launch' END, CASE WHEN n_nationkey % 5 = 0 THEN 'appoint' END], lambda e: e IS NOT NULL)) AS event FROM nation""")
def unsupported_events(spark, sf):
    """Events in the title, a heading and the second paragraph; those of the third paragraph and of the passages do not count."""
    k = F.col("n_nationkey")
    title = F.concat("n_name", F.when(k % 3 == 0, " joins the board").otherwise(" at work"))
    heading = F.when(k % 2 == 0, "# A fund is launched\n\n").otherwise("# A fund\n\n")
    second = F.when(k % 5 == 0, "He was appointed and hired.").otherwise("He works and was hired.")
    text = F.concat(heading, F.lit("First paragraph.\n\n"), second, F.lit("\n\nOthers announced and promoted him."))
    return audit.unsupported_events(t(spark, sf, "nation").select(k.alias("text_id"), title.alias("title"), text.alias("text")), F.array(F.lit("They hire many people.")))


@query("h25_probe_terms", """SELECT term, min(p_partkey) AS place FROM (SELECT p_partkey, regexp_replace(p_name, '^small ', '') AS term FROM part) GROUP BY 1 ORDER BY place, term LIMIT 8""")
def probe_terms(spark, sf):
    """Eight terms are the feature."""
    return R.probe_terms(t(spark, sf, "part").select(F.col("p_partkey").alias("place"), F.col("p_name").alias("query")), ["Small"])


_SIGNED = """s AS (SELECT md5(concat_ws(' ', p_name, p_type, p_brand, 'is a part of common words')) AS k, concat_ws(' ', p_name, lower(p_type), lower(replace(p_brand, '#', ' ')), 'is a part of common words') AS folded FROM (SELECT DISTINCT p_name, p_type, p_brand FROM part)),
g AS (SELECT DISTINCT k, array_to_string(w[i:i+2], ' ') AS g FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT k, string_split(folded, ' ') AS w FROM s))),
h AS (SELECT k, ('0x' || substr(md5(g), 1, 8))::BIGINT AS h1, ('0x' || substr(md5(g), 9, 8))::BIGINT | 1 AS h2 FROM g),
m AS (SELECT k, i, min((h1 + i * h2) % 4294967296) AS m FROM h, range(64) t(i) GROUP BY 1, 2), z AS (SELECT k, m FROM m WHERE i = 0)"""


@query("i7_signature_pairs", f"""WITH {_SIGNED}, p AS (SELECT a.k AS a, b.k AS b FROM z a JOIN z b ON a.m = b.m AND a.k < b.k)
SELECT p.a, p.b, count(*) FILTER (WHERE x.m = y.m) / 64.0::DOUBLE AS similarity FROM p JOIN m x ON x.k = p.a JOIN m y ON y.k = p.b AND y.i = x.i GROUP BY 1, 2""")
def signature_pairs(spark, sf):
    """Signatures of part descriptions that share their first minimum, compared with one another."""
    parts = t(spark, sf, "part").select("p_name", "p_type", "p_brand").distinct().select(F.concat_ws(" ", "p_name", "p_type", "p_brand", F.lit("is a part of common words")).alias("text"))
    signed = H.minhash(parts.withColumn("k", F.md5(F.col("text").cast("binary"))), "k", "text")
    a, b = signed.alias("a"), signed.alias("b")
    pairs = a.join(b, (F.col("a.signature")[0] == F.col("b.signature")[0]) & (F.col("a.k") < F.col("b.k")))
    return pairs.select(F.col("a.k").alias("a"), F.col("b.k").alias("b"), H.minhash_similarity(F.col("a.signature"), F.col("b.signature")).alias("similarity"))


@query("i13_is_linked", r"SELECT page_id FROM pages WHERE regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\.', '') IN (SELECT regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\.', '') FROM pages WHERE page_id = 0)")
def is_linked(spark, sf):
    pages = t(spark, sf, "pages")
    first = F.broadcast(pages.where("page_id = 0").select(P.host_of(F.col("url")).alias("host")))
    return pages.withColumn("host", P.host_of(F.col("url"))).join(first, "host", "left_semi").select("page_id")


@query("j4_month_keys", "SELECT strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n FROM orders GROUP BY 1, 2")
def month_keys(spark, sf):
    return t(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("j6_human_age", f"""{BASE_SQL}, a AS (SELECT document_id, {age('effective_date')} AS d FROM docs, params WHERE effective_date IS NOT NULL) SELECT document_id, CASE WHEN d < 1 THEN 'today' WHEN d < 45 THEN floor(d + 0.5)::BIGINT::VARCHAR || CASE WHEN floor(d + 0.5) = 1 THEN ' day' ELSE ' days' END
WHEN d < 545 THEN floor(d / 30.44 + 0.5)::BIGINT::VARCHAR || CASE WHEN floor(d / 30.44 + 0.5) = 1 THEN ' month' ELSE ' months' END WHEN d / 365.25 < 10 THEN printf('%.1f', d / 365.25) || ' years' ELSE floor(d / 365.25 + 0.5)::BIGINT::VARCHAR || ' years' END AS age FROM a""")
def human_age(spark, sf):
    return star.documents(spark, sf).where("effective_date IS NOT NULL").select("document_id", X.human_age(X.age_days(F.col("effective_date"), star.now())).alias("age"))


@query("k1_clamp_and_division", f"SELECT l_orderkey, l_linenumber, l_partkey, {r('least(1.0::DOUBLE, greatest(0.0::DOUBLE, l_quantity / 25))', 2)} AS clamped, CASE WHEN l_discount = 0 THEN -1.0 ELSE {r('l_tax / l_discount', 4)} END AS ratio FROM lineitem")
def clamp_and_division(spark, sf):
    q = X.half_up(X.clamp(F.col("l_quantity") / 25), 2)
    ratio = F.when(F.col("l_discount") == 0, -1.0).otherwise(X.half_up(X.safe_div(F.col("l_tax"), F.col("l_discount")), 4))
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", q.alias("clamped"), ratio.alias("ratio"))


@query("l1_safe_json", "SELECT event_id, coalesce(TRY_CAST(props->>'k' AS BIGINT), -1) AS k FROM events")
def safe_json(spark, sf):
    parsed = candidates.parsed_or(F.col("props"), "k long", F.struct(F.lit(-1).cast("long").alias("k")))
    return t(spark, sf, "events").select("event_id", F.coalesce(parsed["k"], F.lit(-1).cast("long")).alias("k"))


@query("l8_link_placement", """SELECT n_nationkey AS text_id, 1::BIGINT AS links, CASE WHEN n_nationkey % 4 IN (0, 3) THEN 1::BIGINT ELSE 0::BIGINT END AS in_body, CASE n_nationkey % 4 WHEN 0 THEN 'pass' WHEN 3 THEN 'warn' ELSE 'fail' END AS result FROM nation WHERE n_nationkey % 4 <> 2""")
def link_placement(spark, sf):
    """A link to the target early in the body, in the footer, nowhere, and late in the body."""
    k = F.col("n_nationkey")
    own = F.concat(F.lit('<a href="https://www.target.example/'), k.cast("string"), F.lit('">own</a>'))
    other = F.lit('<p>Some words stand here and <a href="https://other.example/x">another</a> link.</p>')
    html = F.concat(
        F.lit("<html><body><p>Words "), F.when(k % 4 == 0, own).otherwise(""), F.lit(" go on.</p>"), F.repeat(other, 8), F.when(k % 4 == 3, F.concat(F.lit("<p>Late "), own, F.lit("</p>"))).otherwise(""),
        F.lit("<footer>"), F.when(k % 4 == 1, own).otherwise(""), F.lit("</footer></body></html>"),
    )
    found = t(spark, sf, "nation").select(k.alias("text_id"), F.explode(P.links(html)).alias("l")).select("text_id", "l.*")
    return audit.link_placement(found, F.array(F.lit("https://target.example/"))).select("text_id", "links", "in_body", "result")


@query("m3_verdict_bands", f"{BASE_SQL} SELECT document_id, CASE WHEN entity_confidence >= 0.7 THEN 'accept' WHEN entity_confidence >= 0.4 THEN 'review' ELSE 'reject' END AS verdict FROM docs")
def verdict_bands(spark, sf):
    return star.documents(spark, sf).select("document_id", X.verdict(F.col("entity_confidence")).alias("verdict"))


@query("m4_search_prior", f"""{SCORES_SQL}, {PAGE} SELECT document_id, CASE WHEN rank IS NULL THEN entity_confidence ELSE {r('1 - (1 - entity_confidence) * (1 - CASE WHEN rank <= 3 THEN 0.6 WHEN rank <= 10 THEN 0.5 WHEN rank <= 30 THEN 0.35 ELSE 0.2 END::DOUBLE)', 3)} END AS confidence FROM docs LEFT JOIN page USING (document_id)""")
def search_prior(spark, sf):
    scored = star.documents(spark, sf).select("document_id", F.col("entity_confidence").alias("confidence"), F.lit("markers").alias("method"))
    return identity.with_search_prior(scored, _page(spark, sf).select("document_id", "rank")).select("document_id", "confidence")


@query("m14_default_hierarchy", """SELECT * FROM (VALUES ('Arts & Culture', 'Contemporary Art'), ('Arts & Culture', 'Museum Patronage'), ('Legal', 'Lawsuit'), ('Controversy', 'Investigation'), ('Controversy', 'Criticism')) v(parent, child)""")
def default_hierarchy(spark, sf):
    """Two children make a parent; one child needs the parent to be there."""
    labels = ["Contemporary Art", "Museum Patronage", "Education Philanthropy", "Legal", "Lawsuit", "Investigation", "Criticism", "Chess"]
    return R.default_hierarchy(spark.createDataFrame([(x,) for x in labels], "label string"))


@query("m17_cluster_members", f"{BASE_SQL} SELECT cluster_id, document_id, is_primary FROM docs WHERE cluster_id IS NOT NULL")
def cluster_members(spark, sf):
    return star.documents(spark, sf).where("cluster_id IS NOT NULL").select("cluster_id", "document_id", "is_primary")


@query("m18_proximity", f"{BASE_SQL} SELECT DISTINCT token_distance, boundary, {star.PROXIMITY} AS proximity FROM ev")
def proximity(spark, sf):
    return star.evidence(spark, sf).select("token_distance", "boundary", X.proximity(F.col("token_distance"), F.col("boundary")).alias("proximity")).distinct()


@query("m19_recency", f"{BASE_SQL} SELECT document_id, {star.recency('effective_date', 180.0)} AS h180, {star.recency('effective_date', 365.0)} AS h365, {star.recency('effective_date', 730.0)} AS h730 FROM docs, params")
def recency(spark, sf):
    return star.documents(spark, sf).select("document_id", *(X.recency(F.col("effective_date"), star.now(), h).alias(f"h{h}") for h in (180, 365, 730)))


@query("m37_overlay", f"{SCORES_SQL}, {PAGE} SELECT entity_id, rank, document_id, string_agg(association_id, ',' ORDER BY association_id) AS associations FROM classified GROUP BY 1, 2, 3")
def overlay(spark, sf):
    return R.overlay(classify_results(spark, sf))


@query("c6_unclassified_results", f"{SCORES_SQL}, {PAGE} SELECT entity_id, rank FROM page p WHERE NOT EXISTS (SELECT 1 FROM classified c WHERE c.entity_id = p.entity_id AND c.rank = p.rank AND c.association_id IS NOT NULL)")
def unclassified(spark, sf):
    return R.unclassified(_page(spark, sf), classify_results(spark, sf)).select("entity_id", "rank")


@query("m41_page_trace", f"""{SCORES_SQL}, {PAGE}, n AS (SELECT document_id, count(*) AS rows FROM ev GROUP BY 1) SELECT p.entity_id, p.rank, p.document_id, coalesce(n.rows, 0) AS rows,
CASE WHEN d.verdict = 'review' THEN 'in_review' WHEN coalesce(n.rows, 0) = 0 AND p.document_id % 3 = 0 THEN 'not_read' WHEN coalesce(n.rows, 0) = 0 THEN 'no_evidence' WHEN p.document_id % 2 = 0 THEN 'fallback_only' ELSE 'evidence' END AS stage
FROM page p JOIN docs d USING (document_id) LEFT JOIN n USING (document_id)""")
def page_trace(spark, sf):
    docs = star.documents(spark, sf).select("document_id", "verdict", F.when(F.col("document_id") % 3 == 0, "snippet_only").otherwise("fetched").alias("fetch_status"), F.lit(9000).alias("body_chars"))
    ev = star.evidence(spark, sf).select("document_id", F.when(F.col("document_id") % 2 == 0, "heuristic").otherwise("model").alias("extractor"))
    return R.page_trace(_page(spark, sf), docs, ev)


@query("m42_probe_budget", "SELECT n, CAST(floor(n * 0.4) AS BIGINT) AS budget, CAST(greatest(20, floor(floor(n * 0.4) * 0.75 / 3)) AS BIGINT) AS per_explicit, CAST(greatest(10, floor(floor(n * 0.4) * 0.25 / 4)) AS BIGINT) AS per_automatic FROM (SELECT CAST(n_nationkey * 150 AS INTEGER) AS n FROM nation)")
def probe_budget(spark, sf):
    n = t(spark, sf, "nation").select((F.col("n_nationkey") * 150).alias("n"))
    return n.select("n", *(c.alias(k) for k, c in R.probe_budget(F.col("n").cast("double"), F.lit(3), F.lit(4)).items()))


@query("m50_entity_summary", f"""{BOARD_SQL}, {PAGE}, {GRS}, g AS (SELECT b.entity_id, b.association_id, {r('coalesce(grs.grs, 0.0) - current_corpus_share * 100', 1)} AS gap FROM board b LEFT JOIN grs ON grs.entity_id = b.entity_id AND grs.association_id = b.association_id),
o AS (SELECT * FROM {older_board_sql('2000-12-01 00:00:00')})
SELECT entity_id, association_id, 'strongest' AS reading, pias AS value FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY pias DESC, association_id) AS k FROM board) WHERE k <= 5
UNION ALL SELECT b.entity_id, b.association_id, 'moved', {r('b.current_pias - o.current_pias', 1)} FROM board b JOIN o ON o.entity_id = b.entity_id AND o.association_id = b.association_id WHERE abs(b.current_pias - o.current_pias) >= 15 AND b.current_documents >= 3
UNION ALL SELECT entity_id, association_id, 'gap', gap FROM g WHERE abs(gap) >= 15""")
def entity_summary(spark, sf):
    docs, ev, then = star.documents(spark, sf), star.evidence(spark, sf), X.days_before(star.now(), 365)
    older = settle(S.leaderboard(docs.where(F.col("seen_at") < then), ev, then), "board")
    scores, board = _scored(spark, sf)
    return R.entity_summary(board, older, I.retrieval_gap(board, retrieval_scores(spark, sf, scores)))


@query("f8_by_movement", f"""SELECT entity_id, association_id, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY abs(delta) + abs(current_delta) DESC, association_id) AS INTEGER) AS place FROM ({_WHAT_IF_SQL})""")
def by_movement(spark, sf):
    return I.by_movement(what_if(spark, sf)).select("entity_id", "association_id", "place")


@query("m51_diagnose", f"{BASE_SQL} SELECT r_regionkey::BIGINT AS entity_id, CASE r_regionkey WHEN 3 THEN 'failed' WHEN 4 THEN 'never_built' ELSE 'ok' END AS verdict FROM region")
def diagnose(spark, sf):
    entities = t(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("entity_id"))
    jobs = entities.where("entity_id < 4").select("entity_id", F.lit(1).alias("job_id"), F.when(F.col("entity_id") == 3, "failed").otherwise("done").alias("status"))
    docs = star.documents(spark, sf)
    ev = star.evidence(spark, sf).join(docs.select("document_id", "entity_id"), "document_id")
    active = ev.select("entity_id", "association_id").distinct().withColumn("status", F.lit("active"))
    return R.diagnose(entities, jobs, docs, ev, active).select("entity_id", "verdict")


@query("m55_exclusion_breaches")
def exclusion_breaches(spark, sf):
    return audit.exclusion_breaches(_docs(spark, sf), ["password", "of the"])


@query("m58_independent_sources", f"{BASE_SQL} SELECT association_id, count(*) AS attributions, count(DISTINCT coalesce('cluster:' || cluster_id::VARCHAR, 'domain:' || root_domain::VARCHAR)) AS independent FROM (SELECT DISTINCT association_id, document_id FROM ev) JOIN docs USING (document_id) GROUP BY 1")
def independent_sources(spark, sf):
    rows = star.evidence(spark, sf).select("association_id", "document_id").distinct().join(star.documents(spark, sf).select("document_id", "cluster_id", "root_domain"), "document_id")
    return audit.independent_sources(rows, ["association_id"])


@query("m68_sign_off", "SELECT l_orderkey AS text_id, count(*) FILTER (WHERE l_returnflag = 'N') AS passed, count(*) FILTER (WHERE l_returnflag = 'A') AS warned, count(*) FILTER (WHERE l_returnflag = 'R') AS failed, count(*) FILTER (WHERE l_returnflag = 'R' AND l_linenumber < 4 AND l_linestatus <> 'O') AS open_blocking, CAST(0 AS BIGINT) AS insufficient, CASE WHEN count(*) FILTER (WHERE l_returnflag = 'R' AND l_linenumber < 4 AND l_linestatus <> 'O') > 0 THEN 'blocked' WHEN count(*) FILTER (WHERE l_returnflag <> 'N') > 0 THEN 'review' ELSE 'clear' END AS state FROM lineitem GROUP BY 1")
def sign_off(spark, sf):
    kind = F.when(F.col("l_returnflag") == "N", "pass").when(F.col("l_returnflag") == "A", "warn").otherwise("fail")
    return audit.sign_off(t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("text_id"), kind.alias("result"), (F.col("l_linenumber") < 4).alias("blocking"), (F.col("l_linestatus") == "O").alias("signed")))


@query("m70_growth_candidates", f"""{LABELLED} SELECT entity_id, association_id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY current_pias DESC, independent_sources DESC, documents DESC, association_id) AS place FROM lab
  WHERE sentiment <> 'negative' AND documents >= 2 AND domains >= 2 AND current_pias < 75 AND current_documents > 0) WHERE place <= 15""")
def growth_candidates(spark, sf):
    return content.growth_candidates(_labelled(spark, sf)).select("entity_id", "association_id", "place")


@query("m76_draft_states", """WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, CASE event_type WHEN 'purchase' THEN 'publish' WHEN 'click' THEN 'approve' ELSE 'edit' END AS ev FROM events),
w AS (SELECT user_id, 0::BIGINT AS k, 'draft' AS state FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT w.user_id, e.k, CASE WHEN ev = 'edit' THEN 'draft' WHEN ev = 'approve' AND state IN ('draft', 'approved') THEN 'approved' WHEN ev = 'publish' AND state = 'approved' THEN 'published' ELSE state END FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1)
SELECT user_id AS draft_id, max_by(state, k) AS state FROM w GROUP BY 1""")
def draft_states(spark, sf):
    kind = F.when(F.col("event_type") == "purchase", "publish").when(F.col("event_type") == "click", "approve").otherwise("edit")
    return R.draft_states(t(spark, sf, "events").select(F.col("user_id").alias("draft_id"), F.col("event_id").alias("at"), kind.alias("event")))


@query("p5_added_columns", "SELECT c_custkey AS k, c_name AS name, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def added_columns(spark, sf):
    old = t(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    new = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return old.unionByName(new, allowMissingColumns=True)


@query("l3_snapshot_round_trip", f"{BOARD_SQL} SELECT entity_id, association_id, pias, current_pias, documents FROM board")
def snapshot_round_trip(spark, sf):
    kept = I.snapshot(_board(spark, sf), star.now())
    return I.prior_snapshot(kept, star.now()).select("entity_id", "association_id", "pias", "current_pias", "documents")


