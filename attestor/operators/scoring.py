"""Evidence scoring: reliability, independence, scores per (association, document), components, PIAS, leaderboard.

Input tables: documents (entity_id, document_id, root_domain, domain_rank, url_rank, prominence, spam_score,
entity_confidence, verdict, published_at, group_date, effective_date, cluster_id, cluster_kind, is_primary, sentiment_*)
and evidence (association_id, document_id, occurrence, token_distance, boundary, relationship_confidence, positive,
negative).  ``now`` is always given.  Sums run over whole millionths or billionths, so results do not depend on order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from attestor.functions import exprs as X
from attestor.model import DEFAULT, Model

MICRO = 1_000_000
KEYS = ["entity_id", "association_id"]


def accepted(documents: DataFrame) -> DataFrame:
    """Documents that are confidently about their entity; nothing else is scored."""
    return documents.where(F.col("verdict") == "accept")


def document_reliability(documents: DataFrame, model: Model = DEFAULT) -> DataFrame:
    """documents with classification, prominence percentile and reliability, over the accepted ones of each entity."""
    spam = F.col("spam_score") if "spam_score" in documents.columns else F.lit(None).cast("double")
    override = F.col("reliability_override") if "reliability_override" in documents.columns else None
    own = F.col("classification") if "classification" in documents.columns else F.lit(None).cast("string")
    ranked = with_percentile(accepted(documents))
    kinds = ranked.withColumn("classification", F.coalesce(own, X.classify_domain(F.col("domain_rank"), spam)))
    return kinds.withColumn("reliability", X.reliability(F.col("domain_rank"), F.col("url_rank"), F.col("percentile"), F.col("classification"), override, model))


def with_percentile(documents: DataFrame, cuts: int = 32) -> DataFrame:
    """documents with percentile: the share of lower prominences among an entity's other ones; 1 for a single one.

    An entity's documents are dealt out by approximate quantiles of its prominence, so a rank is taken within a part and
    moved on by the documents of the parts before it: no task sorts all documents of an entity.
    """
    shares = ", ".join(f"{i / cuts}D" for i in range(1, cuts))
    edges = documents.where("prominence IS NOT NULL").groupBy("entity_id").agg(F.expr(f"percentile_approx(CAST(prominence AS DOUBLE), array({shares}), {20 * cuts})").alias("_cuts"))
    # written out, so that it is compiled; without a prominence the part is 0
    part = F.expr(" + ".join(f"CAST(coalesce(get(_cuts, {i}) < prominence, false) AS INT)" for i in range(cuts - 1)))
    placed = documents.join(edges, "entity_id", "left").withColumn("_part", part).drop("_cuts")
    sizes = placed.groupBy("entity_id", "_part").agg(F.count("prominence").alias("_n"))  # some numbers an entity
    entity = Window.partitionBy("entity_id")
    before = sizes.select("entity_id", "_part", F.sum("_n").over(entity).alias("_all"), F.coalesce(F.sum("_n").over(entity.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.col("_before") + F.rank().over(Window.partitionBy("entity_id", "_part").orderBy(F.col("prominence").asc_nulls_last())) - 1
    found = F.when(F.col("prominence").isNull(), None).when(F.col("_all") == 1, 1.0).otherwise(rank / (F.col("_all") - 1))
    return placed.join(before, ["entity_id", "_part"]).withColumn("percentile", found).drop("_part", "_before", "_all")


def assign_independence(pairs: DataFrame, model: Model = DEFAULT) -> DataFrame:
    """pairs (entity_id, association_id, document_id, root_domain, cluster_id, cluster_kind, is_primary, reliability) with
    ordinal and independence.

    Per association, primaries first, then the more reliable: the first document of a domain counts in full, further
    ones less; of a cluster the first counts, exact copies do not, near copies little.
    """
    w = model["independence"]
    order = [F.col("is_primary").desc(), F.col("reliability").desc(), F.col("document_id")]
    by_domain = Window.partitionBy(*KEYS, F.coalesce(F.col("root_domain").cast("string"), F.concat(F.lit("doc:"), F.col("document_id").cast("string")))).orderBy(*order)
    # documents without a cluster are partitions of their own
    by_cluster = Window.partitionBy(*KEYS, F.coalesce(F.concat(F.lit("c:"), F.col("cluster_id").cast("string")), F.concat(F.lit("d:"), F.col("document_id").cast("string")))).orderBy(*order)
    placed = pairs.select(
        "*", (F.row_number().over(by_domain) - 1).alias("ordinal"), F.row_number().over(by_cluster).alias("cluster_place"), F.first("root_domain").over(by_cluster).alias("cluster_domain")
    )
    copy = F.col("cluster_id").isNotNull() & (F.col("cluster_place") > 1)
    unique = F.when(F.col("ordinal") == 0, w["first"]).otherwise(w["additional"])
    weight = F.when(copy & (F.col("cluster_kind") == "exact"), w["exact"]).when(copy & F.col("cluster_domain").eqNullSafe(F.col("root_domain")), w["near_same_domain"]).when(copy, w["syndicated"]).otherwise(unique)
    return placed.withColumn("independence", weight.cast("double")).drop("cluster_place", "cluster_domain")


def evidence_scores(documents: DataFrame, evidence: DataFrame, now: Column, half_life: float | None = None, model: Model = DEFAULT) -> DataFrame:
    """One row per piece of evidence on accepted documents, with every factor, its score and its score without decay."""
    reliable = document_reliability(documents, model)
    if "excluded" in evidence.columns:
        evidence = evidence.where(~F.col("excluded"))
    pairs = evidence.select("association_id", "document_id").distinct().join(
        reliable.select("entity_id", "document_id", "root_domain", "cluster_id", "cluster_kind", "is_primary", "reliability", "entity_confidence", "effective_date"), "document_id"
    )
    weights = assign_independence(pairs, model).select("entity_id", "association_id", "document_id", "root_domain", "reliability", "independence", "entity_confidence", "effective_date")
    index = F.row_number().over(Window.partitionBy("association_id", "document_id").orderBy("occurrence", "token_distance", "relationship_confidence")) - 1
    rows = evidence.withColumn("mention_weight", X.mention_weight(index)).join(weights, ["association_id", "document_id"])
    rows = rows.withColumn("proximity", X.proximity(F.col("token_distance"), F.col("boundary"), model)).withColumn("recency", X.recency(F.col("effective_date"), now, half_life, model))
    fixed = [F.col(c) for c in ("entity_confidence", "relationship_confidence", "proximity", "reliability", "independence")]
    return rows.withColumn("evidence_score", X.evidence_score(*fixed, F.col("recency"), F.col("mention_weight"))).withColumn("undecayed", X.evidence_score(*fixed, F.lit(1.0), F.col("mention_weight")))


def document_scores(scores: DataFrame, *more: str) -> DataFrame:
    """evidence_scores() rolled up to one row per (association, document); evidence in whole millionths.  more: further
    columns of the document."""
    micros = lambda c: F.sum(F.floor(F.col(c) * MICRO + 0.5).cast("long"))
    return scores.groupBy("entity_id", "association_id", "document_id").agg(
        F.count("*").alias("raw_mentions"), X.half_up(F.sum("mention_weight"), 4).alias("capped_weight"), F.max("proximity").alias("best_proximity"),
        X.half_up(F.max("relationship_confidence"), 4).alias("max_relationship"), F.max("independence").alias("independence"), F.max("recency").alias("recency"), F.max("reliability").alias("reliability"),
        micros("evidence_score").alias("evidence_micros"), micros("undecayed").alias("undecayed_micros"),
        X.half_up(F.sum(F.col("positive") - F.col("negative")) / F.count("*"), 4).alias("sentiment"), F.max("effective_date").alias("effective_date"), *(F.first(c).alias(c) for c in more),
    )


def rescore(documents: DataFrame, evidence: DataFrame, now: Column, half_life: float | None = None, model: Model = DEFAULT) -> DataFrame:
    return document_scores(evidence_scores(documents, evidence, now, half_life, model))


def _since(column: Column, since: Column | None, until: Column | None) -> Column:
    ok = F.lit(True)
    ok = ok & (column >= since) if since is not None else ok
    return ok & (column < until) if until is not None else ok


def entity_documents(documents: DataFrame, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Accepted documents per entity in [since, until); a bound drops undated ones."""
    return accepted(documents).where(_since(F.col("effective_date"), since, until)).groupBy("entity_id").agg(F.count("*").alias("entity_documents"))


def _measures(now: Column, half_life: float | None, model: Model) -> dict[str, Column]:
    """What is summed over the documents of an association, in whole numbers, so that partial sums add up."""
    weight, relation = F.col("independence"), F.col("max_relationship")
    undecayed, decay = F.col("undecayed_micros") / MICRO, X.recency(F.col("effective_date"), now, half_life, model)
    return {
        "documents": F.lit(1).cast("long"), "raw_mentions": F.col("raw_mentions"), "sources": X.scaled(weight), "authority": X.scaled(relation * F.col("reliability") * weight * F.col("capped_weight")),
        "current": X.scaled(undecayed * decay), "historical": F.col("undecayed_micros"), "mass": X.scaled(relation * F.col("best_proximity") * weight),
    }


def _shown_components(sums: DataFrame, counts: DataFrame | None, split: list[str], model: Model, passing: Sequence[str] = ()) -> DataFrame:
    """Sums of _measures, with domains, as the components; counts: entity_documents per entity (and window); passing:
    columns that stay."""
    joined = sums.join(counts, ["entity_id", *split], "left") if counts is not None else sums.withColumn("entity_documents", F.lit(0))
    of = {c: X.unscaled(F.col(c)) for c in ("sources", "authority", "current", "mass")} | {"historical": F.col("historical") / MICRO}
    corroboration = F.log1p(of["sources"]) if model.log_corroboration else of["sources"]
    return joined.select(
        *KEYS, *split, *passing, "documents", "domains", "raw_mentions", X.half_up(of["sources"], 3).alias("independent_sources"), X.half_up(corroboration, 4).alias("corroboration_raw"),
        X.half_up(of["authority"], 4).alias("authority_evidence"), X.half_up(of["current"], 4).alias("current_evidence"), X.half_up(of["historical"], 4).alias("historical_evidence"),
        X.half_up(X.safe_div(of["current"], of["historical"]), 4).alias("recency_ratio"), X.half_up(X.safe_div(of["mass"], of["sources"]), 4).alias("relationship_quality"),
        X.half_up(X.safe_div(F.col("documents"), F.col("entity_documents")), 4).alias("corpus_share"),
    )


def components(scores: DataFrame, documents: DataFrame, counts: DataFrame, now: Column, half_life: float | None = None, model: Model = DEFAULT) -> DataFrame:
    """One row per (entity, association) of the given document scores; counts: entity_id, entity_documents.

    If the scores have a column ``window``, one row per window too, and counts are per window.
    """
    split = ["window"] if "window" in scores.columns else []
    measures = _measures(now, half_life, model)
    sums = scores.join(documents.select("document_id", "root_domain"), "document_id").groupBy(*KEYS, *split).agg(
        *(F.sum(c).alias(name) for name, c in measures.items()), F.countDistinct("root_domain").alias("domains")
    )
    return _shown_components(sums, counts, split, model)


def pias(parts: DataFrame, model: Model = DEFAULT) -> DataFrame:
    """components() with the five parts, each within the entity's largest, and their weighted sum."""
    w, entity = model["pias"], Window.partitionBy("entity_id", *(["window"] if "window" in parts.columns else []))
    within = lambda c: X.normalise_within(F.col(c), F.max(c).over(entity))
    scored = parts.select(
        "*", within("corroboration_raw").alias("p_corroboration"), within("authority_evidence").alias("p_authority"), (X.clamp(F.col("recency_ratio")) * 100).alias("p_recency"),
        within("relationship_quality").alias("p_relationship"), within("corpus_share").alias("p_share"),
    )
    total = (
        F.col("p_corroboration") * w["corroboration"] + F.col("p_authority") * w["authority"] + F.col("p_recency") * w["recency"]
        + F.col("p_relationship") * w["relationship"] + F.col("p_share") * w["corpus_share"]
    )
    shown = [X.half_up(F.col(c), 1).alias(c) for c in ("p_corroboration", "p_authority", "p_recency", "p_relationship", "p_share")]
    return scored.withColumn("pias", X.half_up(X.clamp(total, 0, 100), 1)).withColumn("band", X.band(F.col("pias"), model)).select(*parts.columns, *shown, "pias", "band")


def split_windows(scores: DataFrame, current_start: Column) -> tuple[DataFrame, DataFrame]:
    """Rows since current_start, and the others; undated rows are historical."""
    is_current = F.coalesce(F.col("effective_date") >= current_start, F.lit(False))
    return scores.where(is_current), scores.where(~is_current)


def freshness(scores: DataFrame, now: Column) -> DataFrame:
    """Per association: latest and median age, undated documents, shares of undecayed evidence by age."""
    age = X.age_days(F.col("effective_date"), now)
    of = lambda cond: X.half_up(F.try_divide(F.sum(F.when(cond, F.col("undecayed_micros")).otherwise(0)).cast("double"), F.sum("undecayed_micros").cast("double")), 4)
    sums = scores.withColumn("age", age).groupBy(*KEYS).agg(
        F.min("age").alias("latest"), F.median("age").alias("middle"), F.count_if(F.col("age").isNull()).alias("undated_documents"),
        of(F.col("age") < 90).alias("evidence_share_under_90d"), of(F.col("age") < 365).alias("evidence_share_under_365d"), of(F.col("age") >= 1095).alias("evidence_share_over_3y"),
    )
    return sums.select(
        *KEYS, X.half_up(F.col("latest"), 1).alias("latest_mention_age_days"), X.human_age(F.col("latest")).alias("latest_mention_age"), X.half_up(F.col("middle"), 1).alias("median_age_days"),
        X.human_age(F.col("middle")).alias("median_age"), "undated_documents", "evidence_share_under_90d", "evidence_share_under_365d", "evidence_share_over_3y",
    )


def sentiment(scores: DataFrame, documents: DataFrame) -> DataFrame:
    """Independence-weighted sentiment per association and its label."""
    rows = scores.select(*KEYS, "document_id", "independence").join(documents.select("document_id", "sentiment_positive", "sentiment_negative", "sentiment_neutral"), "document_id")
    mean = lambda c: X.half_up(F.try_divide(X.unscaled(F.sum(X.scaled(F.coalesce(c, F.lit(0.0)) * F.col("independence")))), X.unscaled(F.sum(X.scaled(F.col("independence"))))), 4)
    found = rows.groupBy(*KEYS).agg(*(mean(F.col(f"sentiment_{k}")).alias(k) for k in ("positive", "negative", "neutral")))
    label = F.when(F.col("positive").isNull(), "unknown").when(F.col("negative") > 0.5, "negative").when(F.col("positive") > 0.5, "positive").otherwise("mixed/neutral")
    return found.withColumn("label", label)


def _momentum_sums(now: Column, model: Model) -> dict[str, Column]:
    days = model["momentum"]["period_days"]
    start, before, date = X.days_before(now, days), X.days_before(now, 2 * days), F.col("effective_date")
    out = {}
    for name, cond in (("current", (date >= start) & (date < now)), ("previous", (date >= before) & (date < start))):
        out[f"{name}_period_micros"] = F.when(cond, F.col("undecayed_micros")).otherwise(0)
        out[f"{name}_period_documents"] = F.coalesce(cond, F.lit(False)).cast("long")
    return out


def _with_totals(per: DataFrame) -> DataFrame:
    """The sums of _momentum_sums with the entity's."""
    entity = Window.partitionBy("entity_id")
    return per.select("*", F.sum("current_period_micros").over(entity).alias("total_now"), F.sum("previous_period_micros").over(entity).alias("total_before"))


def _momentum_fields(model: Model) -> tuple[Column, dict[str, Column]]:
    """Whether there are too few documents, and the fields, over the columns of _with_totals."""
    fields = X.momentum_fields(*(F.col(c) for c in ("current_period_micros", "previous_period_micros", "total_now", "total_before")), model)
    return F.coalesce(F.col("current_period_documents") + F.col("previous_period_documents"), F.lit(0)) < model["momentum"]["min_documents"], fields


def momentum(scores: DataFrame, now: Column, model: Model = DEFAULT) -> DataFrame:
    """Change between the last period and the one before, against the entity's own change; few documents are not measured."""
    totals = _with_totals(scores.groupBy(*KEYS).agg(*(F.sum(c).alias(name) for name, c in _momentum_sums(now, model).items())))
    few, fields = _momentum_fields(model)
    shown = [F.when(~few, fields[k]).alias(k) for k in ("raw_change", "relative_change", "basis")]
    counts = [F.col(f"{name}_period_documents").alias(f"{name}_documents") for name in ("current", "previous")]
    return totals.select(*KEYS, *counts, *shown, F.when(few, "insufficient").otherwise(fields["bucket"]).alias("bucket"), few.alias("below_floor"))


def timeline(scores: DataFrame, now: Column, months: int = 36) -> DataFrame:
    """Per (entity, month, association): documents, evidence and its share of the month's."""
    since = X.days_before(now, months * 30.44)
    month = F.date_format("effective_date", "yyyy-MM")
    per = scores.where(F.col("effective_date") >= since).groupBy("entity_id", month.alias("month"), "association_id").agg(F.countDistinct("document_id").alias("documents"), F.sum("undecayed_micros").alias("micros"))
    total = F.sum("micros").over(Window.partitionBy("entity_id", "month"))
    return per.select("entity_id", "month", "association_id", "documents", X.half_up(F.col("micros") / MICRO, 4).alias("evidence"), X.half_up(X.safe_div(F.col("micros"), total), 4).alias("share"))


def monthly_metrics(scores: DataFrame, documents: DataFrame, now: Column) -> DataFrame:
    """timeline() over ten years with the distinct domains of each (association, month)."""
    domains = scores.join(documents.select("document_id", "root_domain"), "document_id").groupBy("entity_id", "association_id", F.date_format("effective_date", "yyyy-MM").alias("month")).agg(F.countDistinct("root_domain").alias("domains"))
    return timeline(scores, now, 120).join(domains, ["entity_id", "association_id", "month"])


def leaderboard(documents: DataFrame, evidence: DataFrame, now: Column, window_days: int | None = None, half_life: int | None = None, cutoff: Column | None = None, model: Model = DEFAULT, scores: DataFrame | None = None) -> DataFrame:
    """One row per association: PIAS lifetime, current and historical, bands, counts, shares, momentum.

    The evidence is rolled up once; its windows, domains and momentum come from one aggregation by domain and then by
    association, and the documents of all windows from one count.  scores: document_scores() of the same with root_domain, if
    they are at hand.
    """
    half_life = X.checked_half_life(half_life)
    if scores is None:
        scores = document_scores(evidence_scores(documents, evidence, now, half_life, model), "root_domain")
    window_start = X.days_before(now, window_days) if window_days else None
    current_start = cutoff if cutoff is not None else X.days_before(now, model.current_window_days)
    date = F.col("effective_date")
    inside = F.coalesce(_since(date, window_start, None), F.lit(False))
    is_current = F.coalesce(date >= current_start, F.lit(False))
    tests = {"life": inside, "current": inside & is_current, "past": inside & ~is_current}
    measures, moved = _measures(now, half_life, model), _momentum_sums(now, model)
    # each measure is computed once, then summed where its document lies in a window
    measured = scores.select(*KEYS, "root_domain", *(c.alias(f"_{name}") for name, c in (measures | moved).items()), *(test.alias(f"_in_{w}") for w, test in tests.items()))
    parts = {f"{w}_{name}": F.when(F.col(f"_in_{w}"), F.col(f"_{name}")).otherwise(0) for w in tests for name in measures} | {name: F.col(f"_{name}") for name in moved}
    by_domain = measured.groupBy(*KEYS, "root_domain").agg(*(F.sum(c).alias(name) for name, c in parts.items()))
    domains = [F.count_if((F.col(f"{w}_documents") > 0) & F.col("root_domain").isNotNull()).alias(f"{w}_domains") for w in tests]
    sums = _with_totals(by_domain.groupBy(*KEYS).agg(*(F.sum(name).alias(name) for name in parts), *domains))
    passing = (*moved, "total_now", "total_before")
    ranges = {"life": (window_start, None), "current": (current_start, None), "past": (window_start, current_start)}
    counted = accepted(documents).groupBy("entity_id").agg(*(F.count_if(_since(date, *ranges[w])).alias(w) for w in ranges))
    per_window = lambda *cells: F.explode(F.array(*cells)).alias("x")
    counts = counted.select("entity_id", per_window(*(F.struct(F.lit(w).alias("window"), F.col(w).alias("entity_documents")) for w in ranges))).select("entity_id", "x.*")
    cells = [F.struct(F.lit(w).alias("window"), *(F.col(f"{w}_{name}").alias(name) for name in (*measures, "domains"))) for w in tests]
    windows = sums.select(*KEYS, *passing, per_window(*cells)).select(*KEYS, *passing, "x.*").where("documents > 0")
    scored = pias(_shown_components(windows, counts, ["window"], model, passing), model)
    of = lambda window, column, name: F.max(F.when(F.col("window") == window, F.col(column))).alias(name)
    life = ("pias", "band", "documents", "domains", "raw_mentions", "independent_sources", "authority_evidence", "corpus_share", "recency_ratio")
    board = scored.groupBy(*KEYS).agg(
        *(of("life", c, c) for c in life), *(of("current", c, f"current_{c}") for c in ("pias", "band", "documents", "domains", "corpus_share")), of("current", "historical_evidence", "current_mass"),
        *(of("past", c, f"historical_{c}") for c in ("pias", "band", "corpus_share")), *(of("life", c, c) for c in passing),
    )
    mass = F.sum("current_mass").over(Window.partitionBy("entity_id"))
    zero = {"current_pias": 0.0, "historical_pias": 0.0, "current_documents": 0, "current_domains": 0, "current_corpus_share": 0.0, "historical_corpus_share": 0.0, "current_association_share": 0.0, "current_band": "marginal", "historical_band": "marginal"}
    shared = board.withColumn("current_association_share", X.half_up(X.safe_div(F.col("current_mass"), mass), 4)).fillna(zero)
    few, fields = _momentum_fields(model)
    shared = shared.withColumn("momentum", F.when(few, "insufficient").otherwise(fields["bucket"]))
    joined = shared.join(counted.select("entity_id", F.col("life").alias("entity_documents")).where("entity_documents > 0"), "entity_id")
    return joined.select(
        *KEYS, "pias", "band", "current_pias", "current_band", "historical_pias", "historical_band", "documents", "domains", "raw_mentions", "independent_sources", "authority_evidence",
        "current_documents", "current_domains", "corpus_share", "current_corpus_share", "historical_corpus_share", "current_association_share", "recency_ratio",
        X.conditional_score(F.col("documents"), F.col("entity_documents")).alias("corpus_conditional_score"), "momentum",
    )
