"""The engine's logical tables over the star tables, and the same as DuckDB CTEs.

An order is a document: its customer is the domain, the customer's region the entity.  A line item is a piece of evidence:
its part's brand is the association.  Now is pinned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

NOW = "2001-12-01 00:00:00"
EVENTS_NOW = "2024-01-31 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """One row per document with the columns that scoring reads."""
    customers = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_acctbal", "n_regionkey")
    key, date = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    rows = table(spark, sf, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("n_regionkey").cast("long").alias("entity_id"), key.alias("document_id"), F.col("o_custkey").alias("root_domain"),
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("c_acctbal") / 100)).alias("domain_rank"), F.lit(None).cast("double").alias("url_rank"),
        F.col("o_totalprice").alias("prominence"), F.lit(None).cast("double").alias("spam_score"),
        F.when(F.col("o_orderstatus") == "F", 0.95).when(F.col("o_orderstatus") == "O", 0.80).otherwise(0.55).alias("entity_confidence"),
        F.when(F.col("o_orderstatus").isin("F", "O"), "accept").otherwise("review").alias("verdict"),
        F.when(key % 11 != 0, date).alias("published_at"), F.when(key % 22 == 0, date).alias("group_date"),
        F.when((key % 11 != 0) | (key % 22 == 0), date).alias("effective_date"), date.alias("seen_at"),
        F.when(key % 7 == 0, F.col("o_custkey")).alias("cluster_id"), F.when(key % 7 == 0, F.when(F.col("o_custkey") % 2 == 0, "exact").otherwise("near")).alias("cluster_kind"),
        F.when(F.col("o_orderpriority") == "2-HIGH", 0.7).otherwise(0.1).alias("sentiment_positive"), F.when(F.col("o_orderpriority") == "1-URGENT", 0.8).otherwise(0.1).alias("sentiment_negative"),
        F.when(F.col("o_orderpriority") == "2-HIGH", 0.2).when(F.col("o_orderpriority") == "1-URGENT", 0.1).otherwise(0.8).alias("sentiment_neutral"),
    )
    # a document without a cluster is a partition of its own, so that they do not all meet in one
    own = F.coalesce(F.col("cluster_id"), -1 - F.col("document_id"))
    clustered = Window.partitionBy(own).orderBy("seen_at", "document_id")
    return rows.withColumn("is_primary", F.col("cluster_id").isNotNull() & (F.row_number().over(clustered) == 1))


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    """One row per occurrence of an association in a document; documents() says whose it is."""
    parts = table(spark, sf, "part").select("p_partkey", "p_brand")
    n = F.col("l_linenumber")
    return table(spark, sf, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("association_id"), F.col("l_orderkey").alias("document_id"), n.alias("occurrence"), F.col("l_quantity").alias("token_distance"),
        F.when(n == 1, "same_clause").when(n == 2, "same_sentence").when(n == 3, "adjacent_sentence").when(n == 4, "same_paragraph").otherwise("different_paragraph").alias("boundary"),
        (1 - F.col("l_discount")).alias("relationship_confidence"),
        F.when(F.col("l_returnflag") == "A", 1.0).otherwise(0.0).alias("positive"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("negative"),
    )


#: CTEs docs and ev, column for column as above.
BASE_SQL = f"""
WITH params AS (SELECT TIMESTAMP '{NOW}' AS now_ts),
docs AS (
  SELECT *, cluster_id IS NOT NULL AND row_number() OVER (PARTITION BY cluster_id ORDER BY seen_at, document_id) = 1 AS is_primary FROM (
  SELECT CAST(n_regionkey AS BIGINT) AS entity_id, o_orderkey AS document_id, o_custkey AS root_domain,
    greatest(0.0::DOUBLE, least(100.0::DOUBLE, c_acctbal / 100)) AS domain_rank, NULL::DOUBLE AS url_rank, o_totalprice AS prominence,
    CASE o_orderstatus WHEN 'F' THEN 0.95 WHEN 'O' THEN 0.80 ELSE 0.55 END::DOUBLE AS entity_confidence,
    CASE WHEN o_orderstatus IN ('F','O') THEN 'accept' ELSE 'review' END AS verdict,
    CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS published_at, CASE WHEN o_orderkey % 22 = 0 THEN o_orderdate END AS group_date,
    CASE WHEN o_orderkey % 11 <> 0 OR o_orderkey % 22 = 0 THEN o_orderdate END AS effective_date, o_orderdate AS seen_at,
    CASE WHEN o_orderkey % 7 = 0 THEN o_custkey END AS cluster_id, CASE WHEN o_orderkey % 7 = 0 THEN CASE WHEN o_custkey % 2 = 0 THEN 'exact' ELSE 'near' END END AS cluster_kind,
    CASE WHEN o_orderpriority = '2-HIGH' THEN 0.7 ELSE 0.1 END::DOUBLE AS sentiment_positive, CASE WHEN o_orderpriority = '1-URGENT' THEN 0.8 ELSE 0.1 END::DOUBLE AS sentiment_negative,
    CASE o_orderpriority WHEN '2-HIGH' THEN 0.2 WHEN '1-URGENT' THEN 0.1 ELSE 0.8 END::DOUBLE AS sentiment_neutral
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)),
ev AS (
  SELECT p_brand AS association_id, l_orderkey AS document_id, l_linenumber AS occurrence, l_quantity AS token_distance,
    CASE l_linenumber WHEN 1 THEN 'same_clause' WHEN 2 THEN 'same_sentence' WHEN 3 THEN 'adjacent_sentence' WHEN 4 THEN 'same_paragraph' ELSE 'different_paragraph' END AS boundary,
    1 - l_discount AS relationship_confidence, CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END::DOUBLE AS positive, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END::DOUBLE AS negative
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def r(expr: str, places: int) -> str:
    """Half-up rounding in SQL."""
    scale = f"{10 ** places}.0::DOUBLE"
    return f"(floor(({expr})::DOUBLE * {scale} + 0.5::DOUBLE) / {scale})"


def age(column: str, now: str = "now_ts") -> str:
    return f"greatest(0.0::DOUBLE, (epoch_us({now}) - epoch_us({column})) / 86400000000.0::DOUBLE)"


_DECAY = "CASE WHEN token_distance IS NULL THEN 0.5::DOUBLE ELSE exp(-token_distance / 50.0::DOUBLE) END"
_BOUNDARY = "CASE boundary WHEN 'same_clause' THEN 1.0 WHEN 'same_sentence' THEN 0.9 WHEN 'adjacent_sentence' THEN 0.7 WHEN 'same_paragraph' THEN 0.5 ELSE 0.2 END::DOUBLE"
PROXIMITY = r(f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.5::DOUBLE * {_DECAY} + 0.5::DOUBLE * {_BOUNDARY}))", 4)


def recency(column: str, half_life: float = 365.0) -> str:
    return f"CASE WHEN {column} IS NULL THEN 0.35::DOUBLE ELSE {r(f'power(0.5::DOUBLE, {age(column)} / {half_life}::DOUBLE)', 4)} END"


CLASS = "CASE WHEN domain_rank IS NULL THEN 'unknown' WHEN domain_rank >= 80 THEN 'major' WHEN domain_rank >= 60 THEN 'specialist' WHEN domain_rank >= 35 THEN 'ordinary' WHEN domain_rank >= 10 THEN 'blog' ELSE 'unknown' END"
_CLASS_SCORE = f"CASE {CLASS} WHEN 'major' THEN 1.0 WHEN 'specialist' THEN 0.8 WHEN 'ordinary' THEN 0.6 WHEN 'blog' THEN 0.35 ELSE 0.2 END::DOUBLE"

#: From documents to reliability, from evidence to independence and scores per (association, document).
SCORES_SQL = f"""{BASE_SQL},
ranked AS (
  SELECT *, CASE WHEN count(prominence) OVER (PARTITION BY entity_id) = 1 THEN 1.0::DOUBLE
    ELSE (rank() OVER (PARTITION BY entity_id ORDER BY prominence) - 1)::DOUBLE / (count(prominence) OVER (PARTITION BY entity_id) - 1) END AS percentile
  FROM docs WHERE verdict = 'accept'),
reliable AS (
  SELECT *, {CLASS} AS classification,
    {r(f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, (domain_rank / 100 * 0.4::DOUBLE + percentile * 0.2::DOUBLE + {_CLASS_SCORE} * 0.2::DOUBLE) / (0.4::DOUBLE + 0.2::DOUBLE + 0.2::DOUBLE)))", 4)} AS reliability
  FROM ranked),
pairs AS (
  SELECT DISTINCT d.entity_id, e.association_id, d.document_id, d.root_domain, d.cluster_id, d.cluster_kind, d.is_primary, d.reliability
  FROM ev e JOIN reliable d USING (document_id)),
ordered AS (
  SELECT *,
    row_number() OVER (PARTITION BY entity_id, association_id, root_domain ORDER BY is_primary DESC, reliability DESC, document_id) - 1 AS ordinal,
    row_number() OVER (PARTITION BY entity_id, association_id, cluster_id ORDER BY is_primary DESC, reliability DESC, document_id) AS cluster_place,
    first_value(root_domain) OVER (PARTITION BY entity_id, association_id, cluster_id ORDER BY is_primary DESC, reliability DESC, document_id) AS cluster_domain
  FROM pairs),
independent AS (
  SELECT *, CASE WHEN cluster_id IS NOT NULL AND cluster_place > 1 THEN
      CASE WHEN cluster_kind = 'exact' THEN 0.0 WHEN cluster_domain = root_domain THEN 0.05 ELSE 0.2 END
    WHEN ordinal = 0 THEN 1.0 ELSE 0.35 END::DOUBLE AS independence FROM ordered),
scored AS (
  SELECT i.entity_id, i.association_id, i.document_id, e.occurrence, e.token_distance, i.independence, i.reliability, {PROXIMITY} AS proximity, {recency('d.effective_date')} AS recency,
    CASE row_number() OVER (PARTITION BY i.association_id, i.document_id ORDER BY e.occurrence, e.token_distance, e.relationship_confidence) WHEN 1 THEN 1.0 WHEN 2 THEN 0.2 WHEN 3 THEN 0.1 ELSE 0.0 END::DOUBLE AS mention_weight,
    d.entity_confidence, e.relationship_confidence, e.positive, e.negative, d.effective_date
  FROM ev e JOIN independent i USING (association_id, document_id) JOIN docs d USING (document_id), params),
evidence_scores AS (
  SELECT *, {r('entity_confidence * relationship_confidence * proximity * reliability * independence * recency * mention_weight', 6)} AS evidence_score,
    {r('entity_confidence * relationship_confidence * proximity * reliability * independence * 1.0::DOUBLE * mention_weight', 6)} AS undecayed FROM scored),
adscores AS (
  SELECT entity_id, association_id, document_id, CAST(count(*) AS BIGINT) AS raw_mentions, {r('sum(mention_weight)', 4)} AS capped_weight, max(proximity) AS best_proximity,
    {r('max(relationship_confidence)', 4)} AS max_relationship, max(independence) AS independence, max(recency) AS recency, max(reliability) AS reliability,
    CAST(sum(CAST(floor(evidence_score * 1000000 + 0.5) AS BIGINT)) AS BIGINT) AS evidence_micros, CAST(sum(CAST(floor(undecayed * 1000000 + 0.5) AS BIGINT)) AS BIGINT) AS undecayed_micros,
    {r('sum(positive - negative) / count(*)', 4)} AS sentiment, max(effective_date) AS effective_date
  FROM evidence_scores GROUP BY 1, 2, 3)"""
