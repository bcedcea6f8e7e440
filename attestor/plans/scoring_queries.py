"""Queries over the scoring operators, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.functions import exprs as X
from attestor.operators import scoring as S
from attestor.plans import star
from attestor.plans.star import BASE_SQL, SCORES_SQL, age, r, recency

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


def _both(spark, sf):
    return star.documents(spark, sf), star.evidence(spark, sf)


def _scores(spark, sf):
    return S.rescore(*_both(spark, sf), star.now())


CUTOFF, PERIOD, BEFORE = "(now_ts - INTERVAL 365 DAY)", "(now_ts - INTERVAL 90 DAY)", "(now_ts - INTERVAL 180 DAY)"


def _components_sql(name: str, where: str, counted: str) -> str:
    """CTE ``name`` with the components of the scores that meet where, shares of the documents that meet counted."""
    nano = lambda e: f"(sum(CAST(floor(({e})::DOUBLE * 1000000000.0::DOUBLE + 0.5::DOUBLE) AS BIGINT)) / 1000000000.0::DOUBLE)"
    return f"""
{name}_n AS (SELECT entity_id, count(*) AS entity_documents FROM docs, params WHERE verdict = 'accept' AND {counted} GROUP BY 1),
{name}_s AS (
  SELECT a.entity_id, a.association_id, count(*) AS documents, count(DISTINCT d.root_domain) AS domains, sum(raw_mentions) AS raw_mentions, {nano('independence')} AS sources,
    {nano('max_relationship * reliability * independence * capped_weight')} AS authority, {nano(f"undecayed_micros / 1000000::DOUBLE * {recency('a.effective_date')}")} AS cur,
    sum(undecayed_micros) / 1000000::DOUBLE AS hist, {nano('max_relationship * best_proximity * independence')} AS mass
  FROM adscores a JOIN docs d USING (document_id), params WHERE {where} GROUP BY 1, 2),
{name} AS (
  SELECT s.entity_id, association_id, documents, domains, CAST(raw_mentions AS BIGINT) AS raw_mentions, {r('sources', 3)} AS independent_sources, {r('ln(1 + sources)', 4)} AS corroboration_raw,
    {r('authority', 4)} AS authority_evidence, {r('cur', 4)} AS current_evidence, {r('hist', 4)} AS historical_evidence, {r('CASE WHEN hist = 0 THEN 0 ELSE cur / hist END', 4)} AS recency_ratio,
    {r('CASE WHEN sources = 0 THEN 0 ELSE mass / sources END', 4)} AS relationship_quality, {r('coalesce(documents::DOUBLE / entity_documents, 0)', 4)} AS corpus_share
  FROM {name}_s s LEFT JOIN {name}_n n ON s.entity_id = n.entity_id),
{name}_p AS (
  SELECT *, {_within('corroboration_raw')} AS x1, {_within('authority_evidence')} AS x2, least(1.0::DOUBLE, greatest(0.0::DOUBLE, recency_ratio)) * 100 AS x3, {_within('relationship_quality')} AS x4, {_within('corpus_share')} AS x5 FROM {name}),
{name}_pias AS (
  SELECT *, {r('least(100.0::DOUBLE, greatest(0.0::DOUBLE, x1 * 0.3::DOUBLE + x2 * 0.25::DOUBLE + x3 * 0.2::DOUBLE + x4 * 0.15::DOUBLE + x5 * 0.1::DOUBLE))', 1)} AS pias FROM {name}_p)"""


def _within(column: str) -> str:
    top = f"max({column}) OVER (PARTITION BY entity_id)"
    return f"CASE WHEN {top} > 0 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, {column} / {top})) * 100 ELSE 0.0::DOUBLE END"


def _band(column: str) -> str:
    return f"CASE WHEN {column} >= 75 THEN 'dominant' WHEN {column} >= 50 THEN 'strong' WHEN {column} >= 25 THEN 'present' ELSE 'marginal' END"


LIFE = _components_sql("life", "TRUE", "TRUE")
_SHOWN = "entity_id, association_id, documents, domains, raw_mentions, independent_sources, corroboration_raw, authority_evidence, current_evidence, historical_evidence, recency_ratio, relationship_quality, corpus_share"


@query("m22_document_reliability", f"{SCORES_SQL} SELECT document_id, {r('percentile', 6)} AS percentile, classification, reliability FROM reliable")
def document_reliability(spark, sf):
    return S.document_reliability(star.documents(spark, sf)).select("document_id", X.half_up(F.col("percentile"), 6).alias("percentile"), "classification", "reliability")


@query("m16_independence", f"{SCORES_SQL} SELECT entity_id, association_id, document_id, CAST(ordinal AS BIGINT) AS ordinal, independence FROM independent")
def independence(spark, sf):
    docs, ev = _both(spark, sf)
    pairs = ev.select("association_id", "document_id").distinct().join(S.document_reliability(docs).select("entity_id", "document_id", "root_domain", "cluster_id", "cluster_kind", "is_primary", "reliability"), "document_id")
    return S.assign_independence(pairs).select("entity_id", "association_id", "document_id", F.col("ordinal").cast("long").alias("ordinal"), "independence")


@query("m24_evidence_scores", f"{SCORES_SQL} SELECT association_id, document_id, occurrence, proximity, recency, mention_weight, evidence_score, undecayed FROM evidence_scores")
def evidence_scores(spark, sf):
    return S.evidence_scores(*_both(spark, sf), star.now()).select("association_id", "document_id", "occurrence", "proximity", "recency", "mention_weight", "evidence_score", "undecayed")


@query("m25_rescore", f"{SCORES_SQL} SELECT * FROM adscores")
def rescore(spark, sf):
    return _scores(spark, sf).withColumn("effective_date", F.col("effective_date").cast("timestamp_ntz"))


@query("m26_components", f"{SCORES_SQL}, {LIFE} SELECT {_SHOWN} FROM life")
def components(spark, sf):
    docs = star.documents(spark, sf)
    return S.components(_scores(spark, sf), docs, S.entity_documents(docs), star.now())


@query("m27_pias", f"{SCORES_SQL}, {LIFE} SELECT entity_id, association_id, {r('x1', 1)} AS p_corroboration, {r('x2', 1)} AS p_authority, {r('x3', 1)} AS p_recency, {r('x4', 1)} AS p_relationship, {r('x5', 1)} AS p_share, pias, {_band('pias')} AS band FROM life_pias")
def pias(spark, sf):
    return S.pias(components(spark, sf)).select("entity_id", "association_id", "p_corroboration", "p_authority", "p_recency", "p_relationship", "p_share", "pias", "band")


@query("m28_conditional_scores", f"""{SCORES_SQL}, {LIFE}, totals AS (SELECT association_id, count(DISTINCT document_id) AS all_docs FROM ev GROUP BY 1)
SELECT l.entity_id, l.association_id, {r('l.documents::DOUBLE / n.entity_documents', 6)} AS corpus_conditional_score, {r('l.documents::DOUBLE / (n.entity_documents + t.all_docs - l.documents)', 6)} AS corpus_jaccard_score
FROM life l JOIN life_n n ON l.entity_id = n.entity_id JOIN totals t ON t.association_id = l.association_id""")
def conditional_scores(spark, sf):
    docs, ev = _both(spark, sf)
    totals = ev.groupBy("association_id").agg(F.countDistinct("document_id").alias("all_docs"))
    joined = components(spark, sf).join(S.entity_documents(docs), "entity_id").join(totals, "association_id")
    n, e, a = (F.col(c) for c in ("documents", "entity_documents", "all_docs"))
    return joined.select("entity_id", "association_id", X.conditional_score(n, e).alias("corpus_conditional_score"), X.jaccard_score(n, e, a).alias("corpus_jaccard_score"))


MOMENTUM = f"""
mom_s AS (
  SELECT entity_id, association_id, sum(CASE WHEN effective_date >= {PERIOD} AND effective_date < now_ts THEN undecayed_micros ELSE 0 END)::DOUBLE AS cur,
    sum(CASE WHEN effective_date >= {BEFORE} AND effective_date < {PERIOD} THEN undecayed_micros ELSE 0 END)::DOUBLE AS prev,
    count(*) FILTER (WHERE effective_date >= {PERIOD} AND effective_date < now_ts) AS current_documents, count(*) FILTER (WHERE effective_date >= {BEFORE} AND effective_date < {PERIOD}) AS previous_documents
  FROM adscores, params GROUP BY 1, 2),
mom_t AS (SELECT *, sum(cur) OVER (PARTITION BY entity_id) AS tn, sum(prev) OVER (PARTITION BY entity_id) AS tp FROM mom_s),
mom_r AS (SELECT *, CASE WHEN prev > 0 THEN (cur - prev) / prev WHEN cur > 0 THEN NULL ELSE 0.0 END AS raw, tn > 0 AND tp > 0 AS related,
  CASE WHEN prev / nullif(tp, 0) > 0 THEN (cur / nullif(tn, 0)) / (prev / nullif(tp, 0)) - 1 WHEN cur / nullif(tn, 0) > 0 THEN NULL ELSE 0.0 END AS rel FROM mom_t),
mom_b AS (SELECT *, CASE WHEN related THEN rel ELSE raw END AS basis_raw, current_documents + previous_documents < 5 AS below_floor FROM mom_r),
mom AS (SELECT *, CASE WHEN below_floor THEN 'insufficient' WHEN basis_raw IS NULL THEN CASE WHEN cur > 0 THEN 'rapid_up' ELSE 'stable' END WHEN basis_raw >= 1.0 THEN 'rapid_up' WHEN basis_raw >= 0.2 THEN 'up'
  WHEN basis_raw <= -0.5 THEN 'rapid_down' WHEN basis_raw <= -0.2 THEN 'down' ELSE 'stable' END AS bucket FROM mom_b)"""


@query("m30_momentum", f"""{SCORES_SQL}, {MOMENTUM} SELECT entity_id, association_id, current_documents, previous_documents, CASE WHEN NOT below_floor THEN {r('raw', 4)} END AS raw_change,
CASE WHEN NOT below_floor AND related THEN {r('rel', 4)} END AS relative_change, CASE WHEN NOT below_floor THEN {r('basis_raw', 4)} END AS basis, bucket, below_floor FROM mom""")
def momentum(spark, sf):
    return S.momentum(_scores(spark, sf), star.now())


_SHARE = lambda cond: r(f"sum(CASE WHEN {cond} THEN undecayed_micros ELSE 0 END)::DOUBLE / nullif(sum(undecayed_micros), 0)", 4)


@query("m31_freshness", f"""{SCORES_SQL}, aged AS (SELECT *, CASE WHEN effective_date IS NOT NULL THEN {age('effective_date')} END AS age FROM adscores, params)
SELECT entity_id, association_id, {r('min(age)', 1)} AS latest_mention_age_days, {r('median(age)', 1)} AS median_age_days, count(*) FILTER (WHERE age IS NULL) AS undated_documents,
{_SHARE('age < 90')} AS evidence_share_under_90d, {_SHARE('age < 365')} AS evidence_share_under_365d, {_SHARE('age >= 1095')} AS evidence_share_over_3y FROM aged GROUP BY 1, 2""")
def freshness(spark, sf):
    return S.freshness(_scores(spark, sf), star.now()).drop("latest_mention_age", "median_age")


_NANO = lambda e: f"sum(CAST(floor(({e})::DOUBLE * 1000000000.0::DOUBLE + 0.5::DOUBLE) AS BIGINT))"
_MEAN = lambda k: r(f"({_NANO(f'd.sentiment_{k} * a.independence')} / 1000000000.0::DOUBLE) / nullif({_NANO('a.independence')} / 1000000000.0::DOUBLE, 0)", 4)


SENTIMENT = f"""
sent_s AS (SELECT a.entity_id, a.association_id, {_MEAN('positive')} AS positive, {_MEAN('negative')} AS negative, {_MEAN('neutral')} AS neutral FROM adscores a JOIN docs d USING (document_id) GROUP BY 1, 2),
sent AS (SELECT *, CASE WHEN positive IS NULL THEN 'unknown' WHEN negative > 0.5 THEN 'negative' WHEN positive > 0.5 THEN 'positive' ELSE 'mixed/neutral' END AS label FROM sent_s)"""


@query("m31_sentiment", f"{SCORES_SQL}, {SENTIMENT} SELECT * FROM sent")
def sentiment(spark, sf):
    return S.sentiment(_scores(spark, sf), star.documents(spark, sf))


_TIMELINE = """month_s AS (SELECT entity_id, strftime(effective_date, '%Y-%m') AS month, association_id, count(DISTINCT document_id) AS documents, sum(undecayed_micros) AS micros
  FROM adscores, params WHERE effective_date >= now_ts - INTERVAL {seconds} SECOND GROUP BY 1, 2, 3),
months AS (SELECT entity_id, month, association_id, documents, {evidence} AS evidence, {share} AS share FROM month_s)"""


def _timeline_sql(months: int) -> str:
    return _TIMELINE.format(seconds=round(months * 30.44 * 86400), evidence=r("micros / 1000000::DOUBLE", 4), share=r("coalesce(micros::DOUBLE / nullif(sum(micros) OVER (PARTITION BY entity_id, month), 0)::DOUBLE, 0)", 4))


@query("m33_timeline", f"{SCORES_SQL}, {_timeline_sql(36)} SELECT * FROM months")
def timeline(spark, sf):
    return S.timeline(_scores(spark, sf), star.now())


@query("m33_monthly_metrics", f"""{SCORES_SQL}, {_timeline_sql(120)}, dom AS (SELECT a.entity_id, a.association_id, strftime(a.effective_date, '%Y-%m') AS month, count(DISTINCT d.root_domain) AS domains FROM adscores a JOIN docs d USING (document_id) GROUP BY 1, 2, 3)
SELECT m.*, dom.domains FROM months m JOIN dom USING (entity_id, association_id, month)""")
def monthly_metrics(spark, sf):
    return S.monthly_metrics(_scores(spark, sf), star.documents(spark, sf), star.now())


def _leaderboard_sql(window: str | None = None) -> str:
    """CTEs to board, and all of it."""
    inside = f"a.effective_date >= now_ts - INTERVAL {window}" if window else "TRUE"
    counted = f"effective_date >= now_ts - INTERVAL {window}" if window else "TRUE"
    parts = [
        _components_sql("life", inside, counted), _components_sql("cur", f"{inside} AND a.effective_date >= {CUTOFF}", f"effective_date >= {CUTOFF}"),
        _components_sql("past", f"{inside} AND (a.effective_date IS NULL OR a.effective_date < {CUTOFF})", f"{counted} AND effective_date < {CUTOFF}"), MOMENTUM,
    ]
    return f"""{_board_ctes(parts)} SELECT * FROM board"""


def _board_ctes(parts: list[str]) -> str:
    return f"""{SCORES_SQL}, {', '.join(parts)},
mass AS (SELECT *, sum(historical_evidence) OVER (PARTITION BY entity_id) AS total_mass FROM cur_pias),
board AS (SELECT l.entity_id, l.association_id, l.pias, {_band('l.pias')} AS band, coalesce(c.pias, 0.0) AS current_pias, {_band('coalesce(c.pias, 0.0)')} AS current_band, coalesce(p.pias, 0.0) AS historical_pias,
  {_band('coalesce(p.pias, 0.0)')} AS historical_band, l.documents, l.domains, l.raw_mentions, l.independent_sources, l.authority_evidence, coalesce(c.documents, 0) AS current_documents, coalesce(c.domains, 0) AS current_domains,
  l.corpus_share, coalesce(c.corpus_share, 0.0) AS current_corpus_share, coalesce(p.corpus_share, 0.0) AS historical_corpus_share,
  coalesce({r('c.historical_evidence / nullif(c.total_mass, 0)', 4)}, 0.0) AS current_association_share, l.recency_ratio, {r('l.documents::DOUBLE / n.entity_documents', 6)} AS corpus_conditional_score, m.bucket AS momentum
FROM life_pias l LEFT JOIN mass c ON c.entity_id = l.entity_id AND c.association_id = l.association_id LEFT JOIN past_pias p ON p.entity_id = l.entity_id AND p.association_id = l.association_id
JOIN life_n n ON n.entity_id = l.entity_id JOIN mom m ON m.entity_id = l.entity_id AND m.association_id = l.association_id)"""


BOARD_SQL = _leaderboard_sql().removesuffix(" SELECT * FROM board")


@query("m32_leaderboard", _leaderboard_sql())
def leaderboard(spark, sf):
    return S.leaderboard(*_both(spark, sf), star.now())


@query("m32_leaderboard_two_years", _leaderboard_sql("730 DAY"))
def leaderboard_window(spark, sf):
    return S.leaderboard(*_both(spark, sf), star.now(), window_days=730)


@query("d1_entity_coverage_counts", f"""{BASE_SQL} SELECT entity_id, count(*) AS documents, count(DISTINCT root_domain) AS domains, CAST(sum(CASE WHEN effective_date IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS undated,
min(effective_date) AS earliest, max(effective_date) AS latest FROM docs WHERE verdict = 'accept' GROUP BY 1""")
def coverage_counts(spark, sf):
    return S.accepted(star.documents(spark, sf)).groupBy("entity_id").agg(
        F.count("*").alias("documents"), F.countDistinct("root_domain").alias("domains"), F.count_if(F.col("effective_date").isNull()).alias("undated"),
        F.min("effective_date").cast("timestamp_ntz").alias("earliest"), F.max("effective_date").cast("timestamp_ntz").alias("latest"),
    )
