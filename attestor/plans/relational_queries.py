"""Queries over the relational operators, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from attestor.functions import exprs as X
from attestor.operators import corrections as K
from attestor.operators import identity
from attestor.operators import scoring as S
from attestor.plans import star
from attestor.plans.insight_queries import PAGE, _page
from attestor.plans.scoring_queries import BOARD_SQL, _scores
from attestor.plans.star import BASE_SQL, SCORES_SQL, age, r
from attestor.sources import candidates

QUERIES, ORACLE_SQL = {}, {}
EPOCH = "timestamp_ntz"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


t = star.table


# ---- A, B: scans, projections, predicates ----


@query("a1_scan_prune", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' AND o_totalprice > 1000")
def scan_prune(spark, sf):
    return t(spark, sf, "orders").where("o_orderdate >= TIMESTAMP_NTZ '2000-01-01' AND o_totalprice > 1000").select("o_orderkey", "o_totalprice")


@query("a4_search_across", """WITH a AS (SELECT c_custkey AS k, c_name AS name, NULL::VARCHAR AS segment, 0 AS src FROM customer WHERE c_custkey % 2 = 0), b AS (SELECT c_custkey, upper(c_name), c_mktsegment, 1 FROM customer WHERE c_custkey % 3 = 0),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT k, first(name ORDER BY src) AS name, first(segment ORDER BY src) FILTER (WHERE segment IS NOT NULL) AS segment, min(src) AS owner FROM u GROUP BY k""")
def search_across(spark, sf):
    c = t(spark, sf, "customer")
    a = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("segment"))
    b = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.upper("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return K.merge_sources([a, b], "k")


@query("a10_phrase_trends", f"""{BASE_SQL} SELECT date_trunc('month', effective_date) AS period, count(*) AS documents, count(DISTINCT root_domain) AS domains, date_trunc('month', effective_date) >= date_trunc('month', any_value(now_ts)) AS partial
FROM docs, params WHERE effective_date IS NOT NULL GROUP BY 1""")
def phrase_trends(spark, sf):
    return candidates.phrase_trends(star.documents(spark, sf), "month", star.now()).withColumn("period", F.col("period").cast(EPOCH))


@query("a9_content_summary", f"{BASE_SQL}, g AS (SELECT root_domain, count(*) AS documents FROM docs GROUP BY 1) SELECT root_domain, documents, {r('documents::DOUBLE / sum(documents) OVER ()', 4)} AS share FROM g ORDER BY documents DESC, root_domain LIMIT 10")
def content_summary(spark, sf):
    return candidates.content_summary(star.documents(spark, sf), "root_domain")


@query("a20_json_rows", "SELECT count(*) AS n, min(strlen(r_name)) AS shortest FROM region")
def json_rows(spark, sf):
    back = candidates.to_json_rows(t(spark, sf, "region")).select(F.from_json("json", "r_regionkey int, r_name string").alias("r"))
    return back.agg(F.count("*").alias("n"), F.min(F.octet_length("r.r_name")).cast("long").alias("shortest"))


@query("b1_window_predicate", f"{BASE_SQL} SELECT document_id FROM docs WHERE verdict = 'accept' AND effective_date >= TIMESTAMP '1999-01-01' AND effective_date < TIMESTAMP '2000-01-01'")
def window_predicate(spark, sf):
    since, until = F.lit("1999-01-01").cast("timestamp"), F.lit("2000-01-01").cast("timestamp")
    return S.accepted(star.documents(spark, sf)).where((F.col("effective_date") >= since) & (F.col("effective_date") < until)).select("document_id")


@query("b5_case_projection", f"{BASE_SQL} SELECT entity_id, count(*) FILTER (WHERE published_at IS NOT NULL) AS publisher_dated, count(*) FILTER (WHERE published_at IS NULL AND group_date IS NOT NULL) AS inferred, count(*) FILTER (WHERE effective_date IS NULL) AS undated FROM docs GROUP BY 1")
def case_projection(spark, sf):
    return star.documents(spark, sf).groupBy("entity_id").agg(
        F.count_if(F.col("published_at").isNotNull()).alias("publisher_dated"), F.count_if(F.col("published_at").isNull() & F.col("group_date").isNotNull()).alias("inferred"), F.count_if(F.col("effective_date").isNull()).alias("undated")
    )


@query("b6_current_historical_split", f"{SCORES_SQL} SELECT association_id, count(*) FILTER (WHERE effective_date >= now_ts - INTERVAL 365 DAY) AS current, count(*) FILTER (WHERE effective_date IS NULL OR effective_date < now_ts - INTERVAL 365 DAY) AS historical FROM adscores, params GROUP BY 1")
def split(spark, sf):
    now, past = S.split_windows(_scores(spark, sf), X.days_before(star.now(), 365))
    a, b = now.groupBy("association_id").agg(F.count("*").alias("current")), past.groupBy("association_id").agg(F.count("*").alias("historical"))
    return a.join(b, "association_id", "full").fillna(0)


@query("b11_review_queue", f"{BASE_SQL} SELECT document_id, entity_confidence FROM docs WHERE verdict = 'review' ORDER BY entity_confidence DESC, document_id LIMIT 100")
def review_queue(spark, sf):
    return identity.review_queue(star.documents(spark, sf)).select("document_id", "entity_confidence")


# ---- C: joins ----


@query("c1_inner", "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def inner(spark, sf):
    return t(spark, sf, "orders").join(t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("c2_left", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def left(spark, sf):
    return t(spark, sf, "customer").join(t(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"))


@query("c5_semi", "SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49)")
def semi(spark, sf):
    return t(spark, sf, "part").join(t(spark, sf, "lineitem").where("l_quantity >= 49"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("p_partkey")


@query("c6_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti(spark, sf):
    return t(spark, sf, "customer").join(t(spark, sf, "orders").where("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("c9_or_join", "SELECT DISTINCT s_suppkey, c_custkey FROM supplier JOIN customer ON s_suppkey = c_custkey OR (s_nationkey = c_nationkey AND s_suppkey = c_custkey % 100)")
def or_join(spark, sf):
    """Two equi joins and a distinct instead of a nested loop over an OR."""
    s, c = t(spark, sf, "supplier"), t(spark, sf, "customer")
    one = s.join(c, F.col("s_suppkey") == F.col("c_custkey"))
    two = s.join(c, (F.col("s_nationkey") == F.col("c_nationkey")) & (F.col("s_suppkey") == F.col("c_custkey") % 100))
    return one.select("s_suppkey", "c_custkey").union(two.select("s_suppkey", "c_custkey")).distinct()


@query("c10_self_join", "WITH s AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS shared FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2 HAVING count(*) >= 3")
def self_join(spark, sf):
    s = t(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    a, b = s.alias("a"), s.alias("b")
    pairs = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_suppkey") < F.col("b.l_suppkey")))
    return pairs.groupBy(F.col("a.l_suppkey").alias("a"), F.col("b.l_suppkey").alias("b")).agg(F.count("*").alias("shared")).where("shared >= 3")


@query("c17_latest_row", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders o WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders x WHERE x.o_custkey = o.o_custkey) GROUP BY 1")
def latest_row(spark, sf):
    return K.latest(t(spark, sf, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey")


@query("c18_scalar_subqueries", "SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation")
def scalar_subqueries(spark, sf):
    n = t(spark, sf, "nation").select("n_nationkey")
    c = t(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    s = t(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    return n.join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").fillna(0)


@query("c20_asof_prior", "SELECT e.event_id, p.event_id AS prior_id FROM events e ASOF JOIN events p ON e.user_id = p.user_id AND p.ts < e.ts WHERE e.event_type = 'purchase'")
def asof_prior(spark, sf):
    """The same user's event before each purchase, by one window over the user's events."""
    e = t(spark, sf, "events")
    at = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(Window.unboundedPreceding, -1)
    return e.withColumn("prior_id", F.max_by("event_id", "ts").over(at)).where("event_type = 'purchase' AND prior_id IS NOT NULL").select("event_id", "prior_id")


@query("c20_full_join", "SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey % 20 AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey + 10 AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k")
def full_join(spark, sf):
    a = t(spark, sf, "customer").groupBy((F.col("c_nationkey") % 20).alias("k")).agg(F.count("*").alias("customers"))
    b = t(spark, sf, "supplier").groupBy((F.col("s_nationkey") + 10).alias("k")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "k", "full")


# ---- D: aggregations ----

_MONEY = "CAST(sum(CAST(floor({0} * 100 + 0.5) AS BIGINT)) AS BIGINT)"
_cents = lambda c: F.sum(F.floor(c * 100 + 0.5).cast("long"))


@query("d3_monthly_sums", f"SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus, count(DISTINCT o_custkey) AS customers, {_MONEY.format('o_totalprice')} AS cents FROM orders GROUP BY 1, 2")
def monthly_sums(spark, sf):
    return t(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderstatus").agg(F.countDistinct("o_custkey").alias("customers"), _cents(F.col("o_totalprice")).alias("cents"))


@query("d4_share_of_month", f"WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus, {_MONEY.format('o_totalprice')} AS cents FROM orders GROUP BY 1, 2) SELECT month, o_orderstatus, {r('cents::DOUBLE / (sum(cents) OVER (PARTITION BY month))::DOUBLE', 4)} AS share FROM m")
def share_of_month(spark, sf):
    total = F.sum("cents").over(Window.partitionBy("month"))
    return monthly_sums(spark, sf).select("month", "o_orderstatus", X.half_up(F.col("cents").cast("double") / total.cast("double"), 4).alias("share"))


@query("d6_adjacent_windows", "SELECT user_id, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-21') AS current, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-11' AND ts < TIMESTAMP '2024-01-21') AS previous FROM events GROUP BY 1")
def adjacent_windows(spark, sf):
    a, b = F.lit("2024-01-21").cast(EPOCH), F.lit("2024-01-11").cast(EPOCH)
    return t(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("ts") >= a).alias("current"), F.count_if((F.col("ts") >= b) & (F.col("ts") < a)).alias("previous"))


@query("d12_median_quantile", f"SELECT event_type, {r('median(value)', 4)} AS middle, {r('quantile_cont(value, 0.9)', 4)} AS p90 FROM events GROUP BY 1")
def median_quantile(spark, sf):
    return t(spark, sf, "events").groupBy("event_type").agg(X.half_up(F.median("value"), 4).alias("middle"), X.half_up(F.percentile("value", F.lit(0.9)), 4).alias("p90"))


@query("d14_having", "SELECT l_suppkey, count(DISTINCT l_orderkey) AS orders FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 5 AND avg(l_discount) >= 0.045")
def having(spark, sf):
    g = t(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.countDistinct("l_orderkey").alias("orders"), X.mean_at_least(F.col("l_discount"), "0.045").alias("high"))
    return g.where("orders >= 5 AND high").select("l_suppkey", "orders")


@query("d15_group_concat", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM nation GROUP BY 1")
def group_concat(spark, sf):
    return t(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("nations"))


@query("d17_top_group_share", f"WITH g AS (SELECT l_suppkey, p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) SELECT l_suppkey, {r('max(n)::DOUBLE / sum(n)::DOUBLE', 4)} AS share FROM g GROUP BY 1")
def top_group_share(spark, sf):
    g = t(spark, sf, "lineitem").join(t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey", "p_brand").count()
    return g.groupBy("l_suppkey").agg(X.half_up(F.max("count").cast("double") / F.sum("count").cast("double"), 4).alias("share"))


@query("d18_independent_sources", f"{BASE_SQL} SELECT entity_id, count(*) AS attributions, count(DISTINCT coalesce('cluster:' || cluster_id::VARCHAR, 'domain:' || root_domain::VARCHAR)) AS independent FROM docs GROUP BY 1")
def independent_sources(spark, sf):
    from attestor.operators.audit import independent_sources as count

    return count(star.documents(spark, sf), ["entity_id"])


@query("d22_facet_map", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def facet_map(spark, sf):
    counted = t(spark, sf, "orders").groupBy("o_orderstatus").count()
    whole = counted.agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "count"))).alias("m"))
    return whole.select(F.explode("m").alias("o_orderstatus", "n"))


@query("d24_pearson", f"SELECT l_returnflag, {r('corr(l_quantity, l_extendedprice)', 3)} AS corr FROM lineitem GROUP BY 1 HAVING count(*) >= 3")
def pearson(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), X.half_up(F.corr("l_quantity", "l_extendedprice"), 3).alias("corr")).where("n >= 3").drop("n")


@query("d25_conditional_distinct", f"{SCORES_SQL} SELECT association_id, count(DISTINCT CASE WHEN undecayed_micros >= 100000 THEN document_id END) AS strong FROM adscores GROUP BY 1")
def conditional_distinct(spark, sf):
    return _scores(spark, sf).groupBy("association_id").agg(F.countDistinct(F.when(F.col("undecayed_micros") >= 100000, F.col("document_id"))).alias("strong"))


@query("d_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark, sf):
    return t(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("d_rollup", "SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup(spark, sf):
    j = t(spark, sf, "customer").join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.rollup("r_name", "n_name").agg(F.count("*").alias("n"))


@query("d_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_sets(spark, sf):
    return t(spark, sf, "orders").groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


# ---- E: windows ----


@query("e2_occurrence_index", f"{SCORES_SQL} SELECT association_id, document_id, occurrence, mention_weight FROM evidence_scores")
def occurrence_index(spark, sf):
    return S.evidence_scores(star.documents(spark, sf), star.evidence(spark, sf), star.now()).select("association_id", "document_id", "occurrence", "mention_weight")


@query("e5_percent_rank", f"SELECT o_orderkey, {r('percent_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice)', 6)} AS p FROM orders")
def percent_rank(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", X.half_up(X.percentile_rank(F.col("o_totalprice"), Window.partitionBy("o_orderstatus")), 6).alias("p"))


@query("e6_rank_weight", "SELECT n, CASE WHEN n <= 10 THEN (11 - n) / 10::DOUBLE ELSE 0.0 END AS w FROM (SELECT CAST(n_nationkey + 1 AS INTEGER) AS n FROM nation)")
def rank_weight(spark, sf):
    return t(spark, sf, "nation").select((F.col("n_nationkey") + 1).alias("n")).select("n", X.rank_weight(F.col("n")).alias("w"))


@query("e10_change_detection", "SELECT event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type")
def change_detection(spark, sf):
    e = t(spark, sf, "events").withColumn("order_key", F.struct("ts", "event_id"))
    return K.changed_versions(e, "user_id", "order_key", "event_type").select("event_id")


@query("e12_revision_streak", """WITH v AS (SELECT conv_id, turn, role FROM conversations), f AS (SELECT conv_id, role, min(turn) AS turn FROM v GROUP BY 1, 2), n AS (SELECT conv_id, turn, count(*) AS added FROM f GROUP BY 1, 2),
a AS (SELECT DISTINCT v.conv_id, v.turn, coalesce(n.added, 0) AS added FROM v LEFT JOIN n ON v.conv_id = n.conv_id AND v.turn = n.turn), b AS (SELECT *, max(CASE WHEN added > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS broken FROM a)
SELECT conv_id AS text_id, count(*) FILTER (WHERE broken = 0) AS streak FROM b GROUP BY 1""")
def revision_streak(spark, sf):
    from attestor.operators.audit import revision_streak as streak

    return streak(t(spark, sf, "conversations").select(F.col("conv_id").alias("text_id"), F.col("turn").alias("version"), F.col("role").alias("fact_key")))


@query("e14_merge_intervals", """WITH i AS (SELECT user_id, epoch_us(ts) AS a, epoch_us(ts) + 3600000000 AS b FROM events), s AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS grp FROM s) SELECT user_id, min(a) AS a, max(b) AS b, count(*) AS n FROM g GROUP BY user_id, grp""")
def merge_intervals(spark, sf):
    i = t(spark, sf, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("a")).withColumn("b", F.col("a") + 3_600_000_000)
    order = Window.partitionBy("user_id").orderBy("a", "b")
    marked = i.withColumn("reach", F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("new", (F.col("reach").isNull() | (F.col("a") > F.col("reach"))).cast("int"))
    grouped = marked.withColumn("grp", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("user_id", "grp").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.count("*").alias("n")).drop("grp")


@query("e15_top3_per_document", f"{SCORES_SQL} SELECT document_id, association_id FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY undecayed_micros DESC, association_id) AS k FROM adscores) WHERE k <= 3")
def top3(spark, sf):
    place = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("undecayed_micros"), "association_id"))
    return _scores(spark, sf).withColumn("k", place).where("k <= 3").select("document_id", "association_id")


@query("e17_pick_facts", f"""{SCORES_SQL.replace('WITH ', 'WITH RECURSIVE ', 1)}, {PAGE},
pool AS (SELECT * FROM (SELECT s.entity_id, s.association_id, s.document_id, s.occurrence::BIGINT AS evidence_id, coalesce('c' || d.cluster_id::VARCHAR, 'd' || s.document_id::VARCHAR) AS used,
  length(trim(repeat(s.association_id || ' ', s.token_distance::INTEGER))) AS chars, row_number() OVER (PARTITION BY s.entity_id ORDER BY s.evidence_score DESC, s.association_id, s.document_id, s.occurrence, s.token_distance) AS pos
  FROM evidence_scores s JOIN docs d USING (document_id)) WHERE pos <= 600),
ordered_pool AS (SELECT p.*, row_number() OVER (PARTITION BY p.entity_id ORDER BY g.rank NULLS LAST, p.pos) AS step FROM pool p LEFT JOIN page g ON g.document_id = p.document_id),
walk AS (
  SELECT DISTINCT entity_id, 0::BIGINT AS step, 0 AS place, ''::VARCHAR AS association_id, 0::BIGINT AS document_id, 0::BIGINT AS evidence_id, []::VARCHAR[] AS taken, []::VARCHAR[] AS used FROM ordered_pool
  UNION ALL
  SELECT w.entity_id, min(o.step), w.place + 1, arg_min(o.association_id, o.step), arg_min(o.document_id, o.step), arg_min(o.evidence_id, o.step), list_append(w.taken, arg_min(o.association_id, o.step)), list_append(w.used, arg_min(o.used, o.step))
  FROM walk w JOIN ordered_pool o ON o.entity_id = w.entity_id AND o.step > w.step AND o.chars >= 40 AND NOT list_contains(w.used, o.used) AND len(list_filter(w.taken, lambda a: a = o.association_id)) < 5
  WHERE w.place < 25 GROUP BY w.entity_id, w.step, w.place, w.taken, w.used)
SELECT entity_id, association_id, document_id, evidence_id, CAST(place AS INTEGER) AS place FROM walk WHERE place > 0""")
def pick_facts(spark, sf):
    """The greedy walk; the passage of a piece of evidence is its association's name, as often as its distance says."""
    from attestor.operators.content import pick_facts as pick

    docs = star.documents(spark, sf)
    scored = S.evidence_scores(docs, star.evidence(spark, sf), star.now())
    facts = scored.join(docs.select("document_id", "cluster_id"), "document_id").join(_page(spark, sf).select("document_id", F.col("rank").alias("page_rank")), "document_id", "left").select(
        "entity_id", "association_id", "document_id", "cluster_id", F.col("occurrence").cast("long").alias("evidence_id"), F.col("evidence_score").alias("weight"), "page_rank",
        F.repeat(F.concat("association_id", F.lit(" ")), F.col("token_distance").cast("int")).alias("passage"),
    )
    return pick(facts)


@query("e_frames", f"SELECT o_orderkey, CAST(ntile(4) OVER w AS INTEGER) AS quartile, {r('cume_dist() OVER w', 6)} AS below, nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def frames(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return t(spark, sf, "orders").select("o_orderkey", F.ntile(4).over(w).alias("quartile"), X.half_up(F.cume_dist().over(w), 6).alias("below"), F.nth_value("o_orderkey", 2).over(whole).alias("second"))


# ---- F, G: order, limits, sets ----


@query("f2_nulls_last", f"{BASE_SQL} SELECT entity_id, document_id, row_number() OVER (PARTITION BY entity_id ORDER BY group_date DESC NULLS LAST, document_id) AS place FROM docs")
def nulls_last(spark, sf):
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc_nulls_last("group_date"), "document_id")).cast("long")
    return star.documents(spark, sf).select("entity_id", "document_id", place.alias("place"))


@query("f3_tiered_sort", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 ELSE 1 END, o_orderpriority, o_orderkey) AS place FROM orders")
def tiered_sort(spark, sf):
    order = Window.partitionBy("o_custkey").orderBy(F.when(F.col("o_orderstatus") == "P", 0).otherwise(1), "o_orderpriority", "o_orderkey")
    return t(spark, sf, "orders").select("o_orderkey", F.row_number().over(order).cast("long").alias("place"))


@query("f10_cluster_primary", f"{BASE_SQL} SELECT cluster_id, document_id FROM docs WHERE is_primary")
def cluster_primary(spark, sf):
    return star.documents(spark, sf).where("is_primary").select("cluster_id", "document_id")


@query("g1_union_dedupe", "SELECT DISTINCT k FROM (SELECT c_custkey AS k FROM customer UNION ALL SELECT o_custkey FROM orders UNION ALL SELECT s_suppkey FROM supplier)")
def union_dedupe(spark, sf):
    c, o, s = t(spark, sf, "customer").select(F.col("c_custkey").alias("k")), t(spark, sf, "orders").select("o_custkey"), t(spark, sf, "supplier").select("s_suppkey")
    return c.union(o).union(s).distinct()


@query("g2_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_(spark, sf):
    return t(spark, sf, "customer").select(F.col("c_custkey").alias("k")).subtract(t(spark, sf, "orders").select("o_custkey"))


@query("g4_intersect", "SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def intersect(spark, sf):
    li = t(spark, sf, "lineitem")
    return li.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")).intersect(li.where("l_returnflag = 'A'").select("l_partkey"))


@query("g7_keep_last", "SELECT user_id, max_by(event_id, event_id) AS event_id FROM events GROUP BY 1")
def keep_last(spark, sf):
    return K.latest(t(spark, sf, "events"), ["user_id"], F.desc("event_id")).select("user_id", "event_id")


# ---- M, P ----


@query("m6_disambiguation_summary", f"{BASE_SQL} SELECT entity_id, count(*) AS total, count(*) FILTER (WHERE verdict = 'accept') AS accepted, count(*) FILTER (WHERE verdict = 'review') AS review, count(*) FILTER (WHERE verdict = 'reject') AS rejected, {r("count(*) FILTER (WHERE verdict = 'accept')::DOUBLE / count(*)", 4)} AS accept_rate, {r("(sum(CAST(floor(entity_confidence * 1000000000 + 0.5) AS BIGINT)) FILTER (WHERE verdict = 'accept') / 1000000000.0::DOUBLE) / count(*) FILTER (WHERE verdict = 'accept')", 3)} AS mean_accepted_confidence FROM docs GROUP BY 1")
def disambiguation_summary(spark, sf):
    return identity.summary(star.documents(spark, sf))


@query("m20_classify_domain", f"{BASE_SQL} SELECT DISTINCT root_domain, {star.CLASS} AS classification FROM docs")
def classify_domain(spark, sf):
    return star.documents(spark, sf).select("root_domain", X.classify_domain(F.col("domain_rank")).alias("classification")).distinct()


@query("m61_adverse_overlap", f"""{BASE_SQL}, bad AS (SELECT DISTINCT e.document_id, d.entity_id FROM ev e JOIN docs d USING (document_id) WHERE association_id IN ('Brand#3', 'Brand#7')), tot AS (SELECT entity_id, count(*) AS n FROM bad GROUP BY 1),
c AS (SELECT b.entity_id, e.association_id, count(DISTINCT e.document_id) AS shared FROM ev e JOIN bad b USING (document_id) WHERE association_id NOT IN ('Brand#3', 'Brand#7') GROUP BY 1, 2)
SELECT c.entity_id, c.association_id, shared, {r('shared::DOUBLE / n', 4)} AS share, shared::DOUBLE / n > 0.5 AS warn FROM c JOIN tot ON c.entity_id = tot.entity_id WHERE n >= 5""")
def adverse_overlap(spark, sf):
    from attestor.operators.audit import adverse_overlap as overlap

    return overlap(star.documents(spark, sf), star.evidence(spark, sf), ["Brand#3", "Brand#7"])


@query("p1_upsert", "SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT 1000000 + s_suppkey, s_name FROM supplier")
def upsert(spark, sf):
    base = t(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("name"))
    filled = t(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    added = t(spark, sf, "supplier").select((F.col("s_suppkey") + 1000000).alias("k"), F.col("s_name").alias("name"))
    return K.upsert(base, filled.unionByName(added), "k")


_REVIEWED = f"""{BASE_SQL.replace('docs AS (', 'docs0 AS (', 1).replace('ev AS (', 'ev0 AS (', 1)},
docs AS (SELECT * REPLACE (CASE WHEN document_id = 1 THEN 'reject' WHEN document_id = 2 THEN 'accept' ELSE verdict END AS verdict) FROM docs0 WHERE root_domain <> 7),
ev AS (SELECT * REPLACE (CASE WHEN association_id = 'Brand#2' THEN 'Brand#1' WHEN association_id = 'Brand#4' AND boundary = 'same_clause' THEN 'Brand#4 first' ELSE association_id END AS association_id) FROM ev0
  WHERE association_id <> 'Brand#5' AND NOT (association_id = 'Brand#6' AND boundary = 'same_clause'))"""


@query("p6_reviews_rescore", f"{BOARD_SQL.replace(BASE_SQL, _REVIEWED)} SELECT * FROM board")
def reviews_rescore(spark, sf):
    """The leaderboard after every kind of review."""
    rows = [
        ("right_entity", "1", None, 0, None), ("wrong_entity", "1", None, 1, None), ("wrong_entity", "2", None, 0, None), ("right_entity", "2", None, 4, None), ("exclude_source", "7", None, 2, None), ("merge_association", "Brand#2", "Brand#1", 3, None),
        ("split_association", "Brand#4", "Brand#4 first", 5, "same_clause"), ("exclude_association", "Brand#5", None, 6, None), ("exclude_evidence", "Brand#6 same_clause", None, 7, None), ("exclude_evidence", "Brand#7 same_clause", None, 7, None),
        ("include_evidence", "Brand#7 same_clause", None, 8, None),
    ]
    reviews = spark.createDataFrame(rows, "action string, target string, value string, reviewed_at int, surface string")
    ev = star.evidence(spark, sf).withColumn("surface_form", F.col("boundary")).withColumn("evidence_id", F.concat("association_id", F.lit(" "), "boundary"))
    return S.leaderboard(*K.apply_reviews(star.documents(spark, sf), ev, reviews), star.now())


@query("p6_recategorised", "SELECT DISTINCT p_brand AS association_id, CASE WHEN p_brand = 'Brand#1' THEN 'person' ELSE 'organization' END AS category FROM part")
def recategorised(spark, sf):
    reviews = spark.createDataFrame([("recategorise", "Brand#1", "place", 1), ("recategorise", "Brand#1", "person", 2), ("exclude_association", "Brand#2", "x", 3)], "action string, target string, value string, reviewed_at int")
    brands = t(spark, sf, "part").select(F.col("p_brand").alias("association_id")).distinct().withColumn("category", F.lit("organization"))
    return K.recategorised(brands, reviews)


@query("j3_age_days", f"{BASE_SQL} SELECT document_id, {r(age('effective_date'), 4)} AS age FROM docs, params WHERE effective_date IS NOT NULL")
def age_days(spark, sf):
    return star.documents(spark, sf).where("effective_date IS NOT NULL").select("document_id", X.half_up(X.age_days(F.col("effective_date"), star.now()), 4).alias("age"))


@query("k5_cosine_pairs", f"""WITH n AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b,
{r('list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v)))', 4)} AS similarity FROM n a JOIN n b ON a.label = b.label AND a.vec_id < b.vec_id
WHERE {r('list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v)))', 4)} >= 0.3""")
def cosine_pairs(spark, sf):
    from attestor.operators.extraction import similar_pairs

    return similar_pairs(t(spark, sf, "embeddings"), 0.3)


