"""Queries over the readings of the leaderboard, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.durable import settle
from attestor.functions import exprs as X
from attestor.operators import insight as I
from attestor.operators import scoring as S
from attestor.plans import star
from attestor.plans.scoring_queries import BOARD_SQL, SENTIMENT, _scores
from attestor.plans.star import BASE_SQL, SCORES_SQL, age, r

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


def _board(spark, sf):
    return S.leaderboard(star.documents(spark, sf), star.evidence(spark, sf), star.now())


def _scored(spark, sf):
    """The evidence scored once for all readings: the scores by document, and the board of them, both written."""
    docs, ev = star.documents(spark, sf), star.evidence(spark, sf)
    scores = settle(S.document_scores(S.evidence_scores(docs, ev, star.now()), "root_domain"), "scores")
    return scores, settle(S.leaderboard(docs, ev, star.now(), scores=scores), "board")


def _labelled(spark, sf):
    return I.with_labels(_board(spark, sf), S.sentiment(_scores(spark, sf), star.documents(spark, sf)))


SETS = """
sets AS (SELECT DISTINCT d.entity_id, e.association_id, e.document_id FROM ev e JOIN docs d USING (document_id)),
sizes AS (SELECT entity_id, association_id, count(*) AS n FROM sets GROUP BY 1, 2),
totals AS (SELECT entity_id, count(*) AS total FROM docs WHERE verdict = 'accept' GROUP BY 1),
shared AS (SELECT a.entity_id, a.association_id, b.association_id AS other_id, count(*) AS shared FROM sets a JOIN sets b ON a.document_id = b.document_id AND a.entity_id = b.entity_id AND a.association_id <> b.association_id GROUP BY 1, 2, 3)"""


@query("m44_related", f"""{BASE_SQL}, {SETS}, x AS (
  SELECT s.entity_id, s.association_id, s.other_id, o.n AS documents, s.shared, {r('s.shared::DOUBLE / m.n', 3)} AS share_of_this, {r('s.shared::DOUBLE / o.n', 3)} AS share_of_other,
    {r('s.shared::DOUBLE / ((m.n * o.n)::DOUBLE / t.total)', 2)} AS lift, s.shared::DOUBLE / m.n >= 0.6 AS carries_this, s.shared::DOUBLE / m.n >= 0.6 AND s.shared::DOUBLE / o.n >= 0.6 AS mutual
  FROM shared s JOIN sizes m ON m.entity_id = s.entity_id AND m.association_id = s.association_id JOIN sizes o ON o.entity_id = s.entity_id AND o.association_id = s.other_id JOIN totals t ON t.entity_id = s.entity_id WHERE shared >= 2),
y AS (SELECT *, CAST(row_number() OVER (PARTITION BY entity_id, association_id ORDER BY shared DESC, lift DESC, other_id) AS INTEGER) AS place FROM x) SELECT * FROM y WHERE place <= 25""")
def related(spark, sf):
    return I.related(star.evidence(spark, sf), star.documents(spark, sf))


@query("m45_disjoint", f"""{BASE_SQL}, {SETS}, x AS (SELECT m.entity_id, m.association_id, o.association_id AS other_id, o.n AS documents FROM sizes m JOIN sizes o ON m.entity_id = o.entity_id AND m.association_id <> o.association_id
  WHERE o.n >= 5 AND NOT EXISTS (SELECT 1 FROM shared s WHERE s.entity_id = m.entity_id AND s.association_id = m.association_id AND s.other_id = o.association_id)),
y AS (SELECT *, CAST(row_number() OVER (PARTITION BY entity_id, association_id ORDER BY documents DESC, other_id) AS INTEGER) AS place FROM x) SELECT * FROM y WHERE place <= 10""")
def disjoint(spark, sf):
    return I.disjoint(star.evidence(spark, sf), star.documents(spark, sf))


def _page(spark, sf):
    """The captured page of each entity: its documents by price, with every fourth item not organic."""
    items = star.documents(spark, sf).select("entity_id", "document_id", F.col("document_id").alias("result_id"), (-F.col("prominence")).alias("rank_absolute"), F.lit(None).cast("double").alias("rank"), F.when(F.col("document_id") % 4 == 3, "video").otherwise("organic").alias("type"))
    return I.organic(items).where("rank <= 12").select("entity_id", "rank", "document_id")


PAGE = """
page AS (SELECT * FROM (SELECT entity_id, document_id, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY -prominence, document_id) AS INTEGER) AS rank FROM docs WHERE document_id % 4 <> 3) WHERE rank <= 12),
best AS (SELECT document_id, association_id FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY undecayed_micros DESC, association_id) AS k FROM adscores) WHERE k <= 3),
classified AS (SELECT p.entity_id, p.rank, p.document_id, b.association_id FROM page p LEFT JOIN best b USING (document_id)),
w AS (SELECT *, greatest(0, 11 - rank) AS w FROM classified WHERE rank <= 10),
whole AS (SELECT entity_id, sum(w) AS total FROM (SELECT DISTINCT entity_id, rank, w FROM w) GROUP BY 1)"""
GRS = f"""grs AS (SELECT w.entity_id, w.association_id, {r('sum(w) / 10::DOUBLE', 4)} AS weight, {r('sum(w)::DOUBLE / max(total) * 100', 1)} AS grs, count(*) AS results FROM w JOIN whole USING (entity_id) WHERE association_id IS NOT NULL GROUP BY 1, 2)"""


@query("a11_organic_page", f"{SCORES_SQL}, {PAGE} SELECT * FROM page")
def organic_page(spark, sf):
    return _page(spark, sf)


@query("m35_classify_results", f"{SCORES_SQL}, {PAGE} SELECT * FROM classified")
def classify_results(spark, sf, scores=None):
    return I.classify_results(_page(spark, sf), _scores(spark, sf) if scores is None else scores)


@query("m36_retrieval_scores", f"{SCORES_SQL}, {PAGE}, {GRS} SELECT * FROM grs")
def retrieval_scores(spark, sf, scores=None):
    return I.retrieval_scores(classify_results(spark, sf, scores))


@query("m38_retrieval_gap", f"""{BOARD_SQL}, {PAGE}, {GRS}, g AS (SELECT b.entity_id, b.association_id, current_pias, historical_pias, {r('current_corpus_share * 100', 1)} AS current_corpus_share_pct, coalesce(grs.grs, 0.0) AS grs,
  {r('coalesce(grs.grs, 0.0) - current_corpus_share * 100', 1)} AS gap FROM board b LEFT JOIN grs ON grs.entity_id = b.entity_id AND grs.association_id = b.association_id)
SELECT *, gap > 15 AS overweighted, gap < -15 AS underweighted, gap > 5 AND historical_pias > current_pias AS historically_anchored FROM g""")
def retrieval_gap(spark, sf):
    scores, board = _scored(spark, sf)
    return I.retrieval_gap(board, retrieval_scores(spark, sf, scores))


@query("m39_association_queries", f"""{SCORES_SQL}, s AS (SELECT entity_id, association_id, CAST(sum(undecayed_micros) AS BIGINT) AS weight FROM adscores GROUP BY 1, 2),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY weight DESC, association_id) AS INTEGER) AS place FROM s) SELECT * FROM t WHERE place <= 8""")
def association_queries(spark, sf):
    return I.association_queries(_scores(spark, sf))


LABELLED = f"{BOARD_SQL}, {SENTIMENT}, lab AS (SELECT b.*, s.label AS sentiment FROM board b JOIN sent s USING (entity_id, association_id))"
_UP = "momentum IN ('up', 'rapid_up')"


@query("m48_priorities", f"""{LABELLED} SELECT entity_id, association_id, CASE WHEN sentiment = 'negative' AND ({_UP} OR current_pias >= 60) THEN 'risk' WHEN current_pias >= 60 AND sentiment <> 'negative' THEN 'defend'
WHEN current_pias < 60 AND sentiment <> 'negative' AND domains >= 2 AND current_documents > 0 THEN 'build' WHEN historical_pias >= 50 AND current_pias < 60 THEN 'historical' ELSE 'monitor' END AS bucket FROM lab""")
def priorities(spark, sf):
    return I.priorities(_labelled(spark, sf))


@query("m48_gap_lists", f"""{LABELLED} SELECT entity_id, association_id, 'historically_strong_currently_weak' AS list FROM lab WHERE historical_pias >= 40 AND current_pias < historical_pias * 0.6
UNION ALL SELECT entity_id, association_id, 'currently_growing' FROM lab WHERE {_UP} UNION ALL SELECT entity_id, association_id, 'valid_but_underrepresented' FROM lab WHERE domains >= 2 AND domains < 15 AND current_pias < 50 AND sentiment <> 'negative'
UNION ALL SELECT entity_id, association_id, 'risk' FROM lab WHERE sentiment = 'negative' AND {_UP}""")
def gap_lists(spark, sf):
    return I.gap_lists(_labelled(spark, sf))


_TOP = lambda c: f"(SELECT * FROM (SELECT entity_id, association_id, {c}, row_number() OVER (PARTITION BY entity_id ORDER BY {c} DESC, association_id) AS k FROM board WHERE {c} > 0) WHERE k <= 12)"


@query("m47_old_vs_current", f"""{BOARD_SQL} SELECT coalesce(h.entity_id, c.entity_id) AS entity_id, coalesce(h.association_id, c.association_id) AS association_id, h.historical_pias AS historical_pias_top, c.current_pias AS current_pias_top,
CASE WHEN c.current_pias IS NULL THEN 'replaced' WHEN h.historical_pias IS NULL THEN 'emerged' ELSE 'kept' END AS state
FROM {_TOP('historical_pias')} h FULL JOIN {_TOP('current_pias')} c ON h.entity_id = c.entity_id AND h.association_id = c.association_id""")
def old_vs_current(spark, sf):
    return I.old_vs_current(_board(spark, sf))


_FIRST = lambda c: f"first(association_id ORDER BY {c} DESC, association_id)"


@query("m46_dominant", f"{BOARD_SQL} SELECT entity_id, {_FIRST('historical_pias')} AS historical_dominant, {_FIRST('current_pias')} AS current_dominant, {_FIRST('independent_sources')} AS most_corroborated FROM board GROUP BY 1")
def dominant(spark, sf):
    return I.dominant(_board(spark, sf))


_METRICS = ("documents", "current_documents", "domains", "independent_sources", "corpus_share", "current_corpus_share", "pias", "current_pias", "historical_pias")


@query("m46_compare", f"{BOARD_SQL} " + " UNION ALL ".join(f"SELECT entity_id, association_id, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM board" for m in _METRICS))
def compare(spark, sf):
    return I.compare(_board(spark, sf), _METRICS)


def older_board_sql(then: str) -> str:
    """A subquery: the board at an earlier instant over the documents seen before it."""
    seen = f"FROM (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '{then}') orders JOIN customer"
    return f"({BOARD_SQL.replace(f'{star.NOW}', then).replace('FROM orders JOIN customer', seen)} SELECT * FROM board)"


@query("m49_alerts", f"""{LABELLED}, {PAGE}, {GRS}, j AS (SELECT l.*, g.grs, p.entity_id IS NOT NULL AS seen, l.domains - coalesce(p.domains, 0) AS gain, (l.current_corpus_share - coalesce(p.current_corpus_share, 0.0)) * 100 AS rise, p.momentum AS was
  FROM lab l LEFT JOIN grs g ON g.entity_id = l.entity_id AND g.association_id = l.association_id LEFT JOIN {older_board_sql('2001-06-02 00:00:00')} p ON p.entity_id = l.entity_id AND p.association_id = l.association_id)
SELECT entity_id, association_id, 'new_negative' AS kind, CASE WHEN domains >= 8 THEN 'critical' ELSE 'warning' END AS severity FROM j WHERE NOT seen AND sentiment = 'negative' AND domains >= 3
UNION ALL SELECT entity_id, association_id, 'rapid_growth', 'info' FROM j WHERE seen AND rise >= 8
UNION ALL SELECT entity_id, association_id, 'resurgence', CASE WHEN sentiment = 'negative' THEN 'critical' ELSE 'warning' END FROM j WHERE seen AND gain >= 5 AND was IN ('down', 'rapid_down')""")
def alerts(spark, sf):
    """Against the board of half a year earlier, read back from its snapshot."""
    docs, ev, then = star.documents(spark, sf), star.evidence(spark, sf), X.days_before(star.now(), 182)
    known = docs.where(F.col("seen_at") < then)
    older = I.snapshot(settle(S.leaderboard(known, ev, then), "board"), then)
    prior = I.prior_snapshot(older, star.now()).withColumn("grs", F.lit(None).cast("double"))
    scores, board = _scored(spark, sf)
    board = I.with_labels(board, S.sentiment(scores, docs)).join(retrieval_scores(spark, sf, scores).select(*S.KEYS, "grs"), S.KEYS, "left")
    return I.alerts(board, prior)


# What an ingest run and its provider report of an entity: the first was read whole, the next two were cut short, the last has no log.
_ALIASES = "list(n_name ORDER BY n_nationkey)"
_COVER = f"""cov AS (SELECT entity_id, count(*) FILTER (WHERE verdict = 'accept') AS total, count(DISTINCT CASE WHEN verdict = 'accept' THEN root_domain END) AS domains, count(DISTINCT document_id % 2) AS providers,
  count(*) FILTER (WHERE verdict = 'accept' AND published_at IS NULL AND group_date IS NOT NULL) AS inferred, count(*) FILTER (WHERE verdict = 'accept' AND effective_date IS NULL) AS undated,
  min(CASE WHEN verdict = 'accept' THEN effective_date END) AS earliest, avg(entity_confidence) FILTER (WHERE verdict = 'accept') AS confidence, count(*) FILTER (WHERE verdict = 'review') AS review FROM docs GROUP BY 1),
covn AS (SELECT n_regionkey AS entity_id, count(DISTINCT lower(n_name)) AS known, count(DISTINCT CASE WHEN n_regionkey = 0 OR n_nationkey % 2 = 0 THEN lower(n_name) END) AS asked FROM nation GROUP BY 1),
covm AS (SELECT cov.*, known, asked, {r('confidence', 3)} AS mean, {age('earliest')} / 365.25 AS years, ['exhausted', 'max_documents', 'budget', 'exhausted', NULL][cov.entity_id + 1] AS stop,
  CAST(floor(total * [1.5, 5, 20, 3, NULL][cov.entity_id + 1]) AS BIGINT) AS cited FROM cov JOIN covn ON covn.entity_id = cov.entity_id, params),
crit AS (SELECT entity_id, unnest([
  struct_pack(criterion := 'corpus_size', met := total >= 500, partial := total >= 100), struct_pack(criterion := 'domain_diversity', met := domains >= 150, partial := domains >= 40),
  struct_pack(criterion := 'corpus_exhausted', met := coalesce(stop = 'exhausted', FALSE), partial := coalesce(stop = 'max_documents', FALSE)),
  struct_pack(criterion := 'alias_coverage', met := stop IS NOT NULL AND asked = known, partial := stop IS NOT NULL AND asked > 0),
  struct_pack(criterion := 'disambiguation', met := mean >= 0.85 AND review < total * 0.25, partial := mean >= 0.75), struct_pack(criterion := 'historical_depth', met := years >= 5, partial := years >= 2),
  struct_pack(criterion := 'dating', met := undated + inferred < total * 0.3, partial := undated < total * 0.3), struct_pack(criterion := 'provider_diversity', met := providers >= 2, partial := providers >= 1),
  struct_pack(criterion := 'corpus_sampling', met := coalesce(total >= cited * 0.5, FALSE), partial := coalesce(total >= cited * 0.1, FALSE))], recursive := true) FROM covm)"""


@query("m43_coverage", f"{BASE_SQL}, {_COVER} SELECT * FROM crit")
def coverage(spark, sf):
    docs = star.documents(spark, sf).withColumn("provider", F.when(F.col("document_id") % 2 == 0, "citations").otherwise("url_index"))
    nations = star.table(spark, sf, "nation").withColumn("entity_id", F.col("n_regionkey").cast("long"))
    asked = F.collect_list(F.when((F.col("n_regionkey") == 0) | (F.col("n_nationkey") % 2 == 0), F.upper("n_name")))
    counts = docs.where("verdict = 'accept'").groupBy("entity_id").agg(F.count("*").alias("total"))
    at = lambda *values: F.get(F.array(*(F.lit(v) for v in values)), F.col("entity_id").cast("int"))
    log = nations.groupBy("entity_id").agg(F.collect_list("n_name").alias("known_aliases"), asked.alias("queried_aliases")).join(counts, "entity_id").where("entity_id < 4").select(
        "*", at("exhausted", "max_documents", "budget", "exhausted").alias("stop_reason"), F.floor(F.col("total") * at(1.5, 5.0, 20.0, 3.0)).cast("long").alias("total_citations")
    )
    return I.coverage(docs, star.now(), log)


@query("m43_coverage_level", f"""{BASE_SQL}, {_COVER}, s AS (SELECT entity_id, count(*) FILTER (WHERE met) + count(*) FILTER (WHERE NOT met AND partial) * 0.5::DOUBLE AS score FROM crit GROUP BY 1)
SELECT *, CASE WHEN score >= 7 THEN 'HIGH' WHEN score >= 4.5 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM s""")
def coverage_level(spark, sf):
    return I.coverage_level(coverage(spark, sf)).withColumn("score", F.col("score").cast("double"))


_CHARACTER = f"""
rows AS (SELECT s.entity_id, s.association_id, s.relationship_confidence, s.entity_confidence, s.proximity, d.root_domain, d.classification FROM evidence_scores s JOIN reliable d USING (document_id)),
per AS (SELECT entity_id, association_id, count(*) AS n, count(*) FILTER (WHERE relationship_confidence >= 0.8) AS direct, sum(CAST(floor(entity_confidence * 1000000000 + 0.5) AS BIGINT)) / 1000000000.0::DOUBLE AS confidence,
  sum(CAST(floor(proximity * 1000000000 + 0.5) AS BIGINT)) / 1000000000.0::DOUBLE AS near, count(*) FILTER (WHERE classification IN ('major', 'specialist')) AS top,
  count(DISTINCT CASE WHEN classification IN ('major', 'specialist') THEN root_domain END) AS top_tier_domains, count(DISTINCT CASE WHEN classification = 'major' THEN root_domain END) AS major_domains,
  count(DISTINCT root_domain) AS domains FROM rows GROUP BY 1, 2),
largest AS (SELECT entity_id, association_id, max(n) AS largest FROM (SELECT entity_id, association_id, root_domain, count(*) AS n FROM rows GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


@query("m52_characterise", f"""{SCORES_SQL}, {_CHARACTER} SELECT entity_id, association_id, CASE WHEN confidence / n < 0.75 THEN 'possibly_misattributed'
  WHEN domains >= 8 AND direct::DOUBLE / n >= 0.5 AND (top::DOUBLE / n >= 0.25 OR top_tier_domains >= 5 OR major_domains >= 3) THEN 'central_and_corroborated' WHEN domains >= 5 AND direct::DOUBLE / n >= 0.4 THEN 'substantive'
  WHEN largest::DOUBLE / n >= 0.6 OR domains <= 2 THEN 'concentrated' ELSE 'peripheral' END AS verdict, {r('direct::DOUBLE / n', 3)} AS direct_relationship_share, {r('confidence / n', 3)} AS mean_entity_confidence,
  {r('near / n', 3)} AS mean_proximity, {r('top::DOUBLE / n', 3)} AS top_tier_share, top_tier_domains, major_domains, {r('largest::DOUBLE / n', 3)} AS top_domain_share FROM per JOIN largest USING (entity_id, association_id)""")
def characterise(spark, sf):
    docs, ev = star.documents(spark, sf), star.evidence(spark, sf)
    return I.characterise(S.evidence_scores(docs, ev, star.now()), S.document_reliability(docs), _board(spark, sf))


_POWER = lambda h: f"CAST(floor(power(0.5::DOUBLE, (age + {h}) / 365.0::DOUBLE) * 1000000000.0::DOUBLE + 0.5::DOUBLE) AS BIGINT)"


@query("k6_project_decay", f"""{SCORES_SQL}, aged AS (SELECT entity_id, association_id, {age('effective_date')} AS age FROM evidence_scores, params WHERE effective_date IS NOT NULL)
SELECT entity_id, association_id, CAST(h AS INTEGER) AS in_days, count(*) FILTER (WHERE age + h <= 365) AS still_in_window, {r(f"sum({_POWER('h')})::DOUBLE / sum({_POWER('0')})", 3)} AS weight_remaining
FROM aged, (VALUES (90), (180), (365), (730)) t(h) GROUP BY 1, 2, 3""")
def project_decay(spark, sf):
    return I.project_decay(S.evidence_scores(star.documents(spark, sf), star.evidence(spark, sf), star.now()), star.now())


@query("k7_plan_displacement", f"""{BOARD_SQL}, x AS (SELECT b.entity_id, b.association_id, b.current_documents AS carrying, n.entity_documents AS whole, b.current_documents::DOUBLE / n.entity_documents AS share FROM board b JOIN cur_n n ON n.entity_id = b.entity_id),
y AS (SELECT *, CASE WHEN carrying = 0 THEN 'none_to_displace' WHEN share / 3 >= share THEN 'at_target' WHEN share < 0.02 THEN 'too_few' ELSE 'applicable' END AS state FROM x)
SELECT entity_id, association_id, state, {r('share', 4)} AS current_share, CASE WHEN state = 'applicable' THEN CAST(greatest(0, ceil(carrying / (share / 3)) - whole) AS BIGINT) END AS additional_documents FROM y""")
def plan_displacement(spark, sf):
    docs = star.documents(spark, sf)
    return I.plan_displacement(_board(spark, sf), S.entity_documents(docs, X.days_before(star.now(), 365)))


_WHAT_IF = f"""{BASE_SQL.replace('docs AS (', 'docs0 AS (', 1).replace('ev AS (', 'ev0 AS (', 1)},
fresh AS (SELECT entity_id, (1000000000000 + entity_id)::BIGINT AS document_id FROM (SELECT DISTINCT entity_id FROM docs0)),
docs AS (SELECT * FROM docs0 UNION ALL BY NAME SELECT entity_id, document_id, -1::BIGINT AS root_domain, 90.0::DOUBLE AS domain_rank, 0.0::DOUBLE AS prominence, 0.95::DOUBLE AS entity_confidence, 'accept' AS verdict, now_ts AS published_at, now_ts AS effective_date, FALSE AS is_primary FROM fresh, params),
ev AS (SELECT * FROM ev0 UNION ALL BY NAME SELECT 'Brand#1' AS association_id, document_id, 1::INTEGER AS occurrence, 3.0::DOUBLE AS token_distance, 'same_clause' AS boundary, 0.85::DOUBLE AS relationship_confidence, 0.0::DOUBLE AS positive, 0.0::DOUBLE AS negative FROM fresh)"""
_DELTA = lambda c: r(f"coalesce(n.{c}, 0) - coalesce(o.{c}, 0)", 1)


@query("m62_what_if", f"""SELECT * FROM (SELECT coalesce(o.entity_id, n.entity_id) AS entity_id, coalesce(o.association_id, n.association_id) AS association_id, {_DELTA('pias')} AS delta, {_DELTA('current_pias')} AS current_delta,
FROM ({BOARD_SQL} SELECT * FROM board) o FULL JOIN ({BOARD_SQL.replace(BASE_SQL, _WHAT_IF)} SELECT * FROM board) n ON o.entity_id = n.entity_id AND o.association_id = n.association_id) WHERE abs(delta) >= 0.5 OR abs(current_delta) >= 0.5""")
def what_if(spark, sf):
    """A new favourable document per entity for its association Brand#1."""
    docs, ev = star.documents(spark, sf), star.evidence(spark, sf)
    new = docs.groupBy("entity_id").agg(F.max("document_id").alias("top")).select(
        "entity_id", (F.lit(10**12) + F.col("entity_id")).cast("long").alias("document_id"), F.lit(-1).cast("long").alias("root_domain"), F.lit(90.0).alias("domain_rank"), F.lit(0.0).alias("prominence"),
        F.lit(0.95).alias("entity_confidence"), F.lit("accept").alias("verdict"), star.now().alias("published_at"), star.now().alias("effective_date"), F.lit(False).alias("is_primary"),
    )
    said = new.select(F.lit("Brand#1").alias("association_id"), "document_id", F.lit(1).alias("occurrence"), F.lit(3.0).alias("token_distance"), F.lit("same_clause").alias("boundary"), F.lit(0.85).alias("relationship_confidence"), F.lit(0.0).alias("positive"), F.lit(0.0).alias("negative"))
    return I.what_if(docs, ev, new, said, lambda d, e: settle(S.leaderboard(d, e, star.now()), "board"))
