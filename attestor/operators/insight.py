"""Readings of the leaderboard and its evidence: co-occurrence, search-page share, gaps, priorities, alerts, coverage, plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from attestor.functions import exprs as X
from attestor.functions import text as T
from attestor.model import CURRENT_WINDOW_DAYS
from attestor.operators.scoring import KEYS, accepted

RISING = ("up", "rapid_up")


# ---- co-occurrence --------------------------------------------------------------------------------------------


def _documents_of(evidence: DataFrame, documents: DataFrame) -> DataFrame:
    return evidence.select("association_id", "document_id").distinct().join(documents.select("entity_id", "document_id"), "document_id")


def related(evidence: DataFrame, documents: DataFrame, floor: int = 2, limit: int = 25) -> DataFrame:
    """For every association those it shares at least ``floor`` documents with: shared, shares of both, lift.

    Pairs are met within documents, so the work is the sum of squares of associations per document, not of documents
    per association.
    """
    sets = _documents_of(evidence, documents)
    size = sets.groupBy(*KEYS).agg(F.count("*").alias("n"))
    total = accepted(documents).groupBy("entity_id").agg(F.count("*").alias("total"))
    a, b = sets.alias("a"), sets.alias("b")
    pairs = a.join(b, (F.col("a.document_id") == F.col("b.document_id")) & (F.col("a.entity_id") == F.col("b.entity_id")) & (F.col("a.association_id") != F.col("b.association_id")))
    shared = pairs.groupBy(F.col("a.entity_id").alias("entity_id"), F.col("a.association_id").alias("association_id"), F.col("b.association_id").alias("other_id")).agg(F.count("*").alias("shared")).where(F.col("shared") >= floor)
    mine, other = size.withColumnRenamed("n", "mine"), size.select("entity_id", F.col("association_id").alias("other_id"), F.col("n").alias("documents"))
    joined = shared.join(mine, KEYS).join(other, ["entity_id", "other_id"]).join(total, "entity_id")
    this, that = F.col("shared") / F.col("mine"), F.col("shared") / F.col("documents")
    lift = X.safe_div(F.col("shared"), X.safe_div(F.col("mine") * F.col("documents"), F.col("total")))
    rows = joined.select(
        *KEYS, "other_id", "documents", "shared", X.half_up(this, 3).alias("share_of_this"), X.half_up(that, 3).alias("share_of_other"), X.half_up(lift, 2).alias("lift"),
        (this >= 0.6).alias("carries_this"), ((this >= 0.6) & (that >= 0.6)).alias("mutual"),
    )
    place = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("shared"), F.desc("lift"), "other_id"))
    return rows.withColumn("place", place).where(F.col("place") <= limit)


def disjoint(evidence: DataFrame, documents: DataFrame, min_documents: int = 5, limit: int = 10) -> DataFrame:
    """For every association the largest others that it shares no document with."""
    sets = _documents_of(evidence, documents)
    size = sets.groupBy(*KEYS).agg(F.count("*").alias("documents"))
    big = size.where(F.col("documents") >= min_documents).withColumnRenamed("association_id", "other_id")
    met = related(evidence, documents, floor=1, limit=2**31 - 1).select(*KEYS, "other_id")
    apart = size.select(*KEYS).join(big, "entity_id").where(F.col("association_id") != F.col("other_id")).join(met, [*KEYS, "other_id"], "left_anti")
    place = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("documents"), "other_id"))
    return apart.withColumn("place", place).where(F.col("place") <= limit)


# ---- search pages ---------------------------------------------------------------------------------------------


def organic(items: DataFrame, keys: Sequence[str] = ("entity_id",)) -> DataFrame:
    """Organic results of a captured page, numbered 1..N by absolute position."""
    order = Window.partitionBy(*keys).orderBy(F.coalesce("rank_absolute", "rank"), "result_id")
    return items.where(F.col("type") == "organic").withColumn("rank", F.row_number().over(order))


def classify_results(results: DataFrame, scores: DataFrame, top: int = 3) -> DataFrame:
    """Associations of the results that are corpus documents: each document's strongest by undecayed evidence."""
    order = Window.partitionBy("document_id").orderBy(F.desc("undecayed_micros"), "association_id")
    best = scores.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select("document_id", "association_id")
    return results.join(best, "document_id", "left").select("entity_id", "rank", "document_id", "association_id")


def retrieval_scores(classified: DataFrame) -> DataFrame:
    """Per association the share of the page's rank weight that carries it; unclassified results stay in the whole."""
    weighed = classified.withColumn("w", (X.rank_weight(F.col("rank")) * 10).cast("long")).where(F.col("w") > 0)
    page = weighed.select("entity_id", "rank", "w").distinct().groupBy("entity_id").agg(F.sum("w").alias("total"))
    carried = weighed.where(F.col("association_id").isNotNull()).select("entity_id", "rank", "w", "association_id").distinct()
    return (
        carried.groupBy(*KEYS).agg(F.sum("w").alias("w"), F.count("*").alias("results")).join(page, "entity_id")
        .select(*KEYS, X.half_up(F.col("w") / 10, 4).alias("weight"), X.half_up(F.col("w") / F.col("total") * 100, 1).alias("grs"), "results")
    )


def retrieval_gap(board: DataFrame, scores: DataFrame) -> DataFrame:
    """Share of the page less share of recent documents, and how to read it."""
    joined = board.join(scores.select(*KEYS, "grs"), KEYS, "left").withColumn("grs", F.coalesce("grs", F.lit(0.0)))
    share = F.col("current_corpus_share") * 100
    rows = joined.select(*KEYS, "current_pias", "historical_pias", X.half_up(share, 1).alias("current_corpus_share_pct"), "grs", X.half_up(F.col("grs") - share, 1).alias("gap"))
    return rows.select(
        "*", (F.col("gap") > 15).alias("overweighted"), (F.col("gap") < -15).alias("underweighted"), ((F.col("gap") > 5) & (F.col("historical_pias") > F.col("current_pias"))).alias("historically_anchored")
    )


def association_queries(scores: DataFrame, limit: int = 8) -> DataFrame:
    """The associations worth a query of their own: the heaviest by undecayed evidence."""
    weight = scores.groupBy(*KEYS).agg(F.sum("undecayed_micros").alias("weight"))
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("weight"), "association_id"))
    return weight.withColumn("place", place).where(F.col("place") <= limit)


# ---- readings -------------------------------------------------------------------------------------------------


def with_labels(board: DataFrame, sentiment: DataFrame) -> DataFrame:
    return board.join(sentiment.select(*KEYS, F.col("label").alias("sentiment")), KEYS)


def full_board(board: DataFrame, retrieval: DataFrame, freshness: DataFrame, sentiment: DataFrame, markers: DataFrame) -> DataFrame:
    """The leaderboard with each association's share of the search page, its gap to recent coverage, freshness, sentiment, and
    whether it is one of the entity's identity markers (entity_id, value)."""
    keys = markers.select("entity_id", T.label_key_column(F.col("value")).alias("_key")).distinct().withColumn("_marked", F.lit(True))
    joined = board.join(retrieval.select(*KEYS, "grs"), KEYS, "left").join(freshness, KEYS, "left").join(sentiment.select(*KEYS, F.col("label").alias("sentiment")), KEYS, "left")
    marked = joined.withColumn("_key", T.label_key_column(F.col("association_id"))).join(keys, ["entity_id", "_key"], "left").withColumn("identity", F.coalesce("_marked", F.lit(False)))
    grs = F.coalesce("grs", F.lit(0.0))
    return marked.withColumn("grs", grs).withColumn("retrieval_gap", X.half_up(F.col("grs") - F.col("current_corpus_share") * 100, 1)).drop("_key", "_marked")


def priorities(board: DataFrame) -> DataFrame:
    """board with sentiment: the first reading that fits."""
    negative, strong_now, strong_then, rising = F.col("sentiment") == "negative", F.col("current_pias") >= 60, F.col("historical_pias") >= 50, F.col("momentum").isin(*RISING)
    bucket = (
        F.when(negative & (rising | strong_now), "risk").when(strong_now & ~negative, "defend").when(~strong_now & ~negative & (F.col("domains") >= 2) & (F.col("current_documents") > 0), "build")
        .when(strong_then & ~strong_now, "historical").otherwise("monitor")
    )
    return board.select(*KEYS, bucket.alias("bucket"))


def gap_lists(board: DataFrame) -> DataFrame:
    """(list, association): strong then and weak now, growing, thinly evidenced, at risk; an association may be on several."""
    lists = {
        "historically_strong_currently_weak": (F.col("historical_pias") >= 40) & (F.col("current_pias") < F.col("historical_pias") * 0.6),
        "currently_growing": F.col("momentum").isin(*RISING),
        "valid_but_underrepresented": F.col("domains").between(2, 14) & (F.col("current_pias") < 50) & (F.col("sentiment") != "negative"),
        "risk": (F.col("sentiment") == "negative") & F.col("momentum").isin(*RISING),
    }
    names = F.array_compact(F.array(*(F.when(cond, F.lit(name)) for name, cond in lists.items())))
    return board.select(*KEYS, F.explode(names).alias("list"))


def old_vs_current(board: DataFrame, limit: int = 12) -> DataFrame:
    """The strongest then and now with their scores; replaced: only then, emerged: only now."""
    def top(score: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc(score), "association_id"))
        return board.where(F.col(score) > 0).withColumn("place", place).where(F.col("place") <= limit).select(*KEYS, F.col(score).alias(f"{score}_top"))

    joined = top("historical_pias").join(top("current_pias"), KEYS, "full")
    state = F.when(F.col("current_pias_top").isNull(), "replaced").when(F.col("historical_pias_top").isNull(), "emerged").otherwise("kept")
    return joined.select(*KEYS, "historical_pias_top", "current_pias_top", state.alias("state"))


def dominant(board: DataFrame) -> DataFrame:
    """Per entity its strongest association then and now, and its most independently sourced."""
    first = lambda score: F.min_by("association_id", F.struct((-F.col(score)).alias("s"), F.col("association_id").alias("i")))
    return board.groupBy("entity_id").agg(first("historical_pias").alias("historical_dominant"), first("current_pias").alias("current_dominant"), first("independent_sources").alias("most_corroborated"))


def compare(board: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row per association and metric."""
    pairs = ", ".join(f"'{m}', CAST({m} AS DOUBLE)" for m in metrics)
    return board.selectExpr(*KEYS, f"stack({len(metrics)}, {pairs}) AS (metric, value)")


def snapshot(board: DataFrame, captured_at: Column) -> DataFrame:
    """An append-only row per entity: its board as an array of structs."""
    fields = ["association_id", "pias", "current_pias", "historical_pias", "corpus_share", "current_corpus_share", "documents", "domains", "momentum"]
    return board.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("associations")).withColumn("captured_at", captured_at)


def prior_snapshot(snapshots: DataFrame, before: Column) -> DataFrame:
    """Per entity the rows of its latest snapshot at or before the given time (an as-of read)."""
    latest = Window.partitionBy("entity_id").orderBy(F.desc("captured_at"))
    kept = snapshots.where(F.col("captured_at") <= before).withColumn("place", F.row_number().over(latest)).where("place = 1")
    return kept.select("entity_id", "captured_at", F.explode("associations").alias("a")).select("entity_id", "captured_at", "a.*")


def alerts(board: DataFrame, prior: DataFrame) -> DataFrame:
    """Changes between two dated boards (both with sentiment, and grs where searched): one row per alert."""
    p = prior.select(*KEYS, *(F.col(c).alias(f"was_{c}") for c in ("current_corpus_share", "domains", "momentum", "grs")))
    j = board.join(p.withColumn("seen", F.lit(True)), KEYS, "left")
    gain, rise = F.col("domains") - F.coalesce("was_domains", F.lit(0)), (F.col("current_corpus_share") - F.coalesce("was_current_corpus_share", F.lit(0.0))) * 100
    negative, seen = F.col("sentiment") == "negative", F.col("seen").isNotNull()
    kinds = [
        ("new_negative", ~seen & negative & (F.col("domains") >= 3), F.when(F.col("domains") >= 8, "critical").otherwise("warning")),
        ("rapid_growth", seen & (rise >= 8), F.lit("info")),
        ("resurgence", seen & (gain >= 5) & F.col("was_momentum").isin("down", "rapid_down"), F.when(negative, "critical").otherwise("warning")),
        ("serp_convergence", seen & (F.abs(F.col("grs") - F.col("was_grs")) >= 10), F.lit("info")),
    ]
    rows = F.array_compact(F.array(*(F.when(cond, F.struct(F.lit(k).alias("kind"), sev.alias("severity"))) for k, cond, sev in kinds)))
    return j.select(*KEYS, F.explode(rows).alias("a")).select(*KEYS, "a.kind", "a.severity")


def coverage(documents: DataFrame, now: Column, log: DataFrame | None = None) -> DataFrame:
    """Per entity the nine coverage criteria as rows (criterion, met, partial).

    documents may have a column provider.  log: one row per entity of what its ingest run and provider report: stop_reason,
    known_aliases, queried_aliases (arrays), total_citations; an entity without a row meets none of those criteria.
    """
    ok = F.col("verdict") == "accept"
    provider = F.col("provider") if "provider" in documents.columns else F.lit(None).cast("string")
    sums = documents.groupBy("entity_id").agg(
        F.count_if(ok).alias("total"), F.countDistinct(F.when(ok, F.col("root_domain"))).alias("domains"), F.count_if(ok & F.col("published_at").isNull() & F.col("group_date").isNotNull()).alias("inferred"),
        F.count_if(ok & F.col("effective_date").isNull()).alias("undated"), F.min(F.when(ok, F.col("effective_date"))).alias("earliest"), F.countDistinct(provider).alias("providers"),
        F.sum(F.when(ok, X.scaled(F.col("entity_confidence")))).alias("confidence"), F.count_if(F.col("verdict") == "review").alias("review"),
    )
    fields = {"stop_reason": "string", "known_aliases": "array<string>", "queried_aliases": "array<string>", "total_citations": "long"}
    if log is None:
        known = sums.select("*", *(F.lit(None).cast(kind).alias(name) for name, kind in fields.items()))
    else:
        known = sums.join(log.select("entity_id", *fields), "entity_id", "left")
    total, years = F.col("total"), F.coalesce(X.age_days(F.col("earliest"), now) / 365.25, F.lit(0.0))
    mean = X.half_up(X.unscaled(F.col("confidence")) / total, 3)
    folded = lambda c: F.array_distinct(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), F.lower))
    aliases, asked = folded("known_aliases"), F.size(F.array_intersect(folded("known_aliases"), folded("queried_aliases")))
    cited = F.coalesce(F.col("total_citations"), F.lit(0))
    criteria = [
        ("corpus_size", total >= 500, total >= 100), ("domain_diversity", F.col("domains") >= 150, F.col("domains") >= 40),
        ("corpus_exhausted", F.col("stop_reason") == "exhausted", F.col("stop_reason") == "max_documents"), ("alias_coverage", F.col("stop_reason").isNotNull() & (asked == F.size(aliases)), asked > 0),
        ("disambiguation", (mean >= 0.85) & (F.col("review") < total * 0.25), mean >= 0.75), ("historical_depth", years >= 5, years >= 2),
        ("dating", F.col("undated") + F.col("inferred") < total * 0.3, F.col("undated") < total * 0.3), ("provider_diversity", F.col("providers") >= 2, F.col("providers") >= 1),
        ("corpus_sampling", (cited > 0) & (total >= cited * 0.5), (cited > 0) & (total >= cited * 0.1)),
    ]
    rows = F.array(*(F.struct(F.lit(k).alias("criterion"), F.coalesce(met, F.lit(False)).alias("met"), F.coalesce(part, F.lit(False)).alias("partial")) for k, met, part in criteria))
    return known.select("entity_id", F.explode(rows).alias("c")).select("entity_id", "c.*")


def stop_reason_text(reason: Column, available: Column) -> Column:
    """An ingest run's reason to stop, in words."""
    of = F.when(available > 0, F.concat(F.lit(" of "), F.format_number(available, 0), F.lit(" available"))).otherwise("")
    return (
        F.when(reason == "exhausted", "provider corpus exhausted").when(reason == "max_documents", F.concat(F.lit("stopped at the document ceiling"), of)).when(reason == "budget", "stopped at the cost ceiling")
        .when(reason == "provider_depth_limit", "stopped at the provider pagination limit").when(reason == "provider_balance", "stopped — provider account balance exhausted")
        .when(F.coalesce(reason, F.lit("")) != "", F.concat(F.lit("stopped: "), reason)).otherwise("unknown")
    )


def coverage_level(criteria: DataFrame) -> DataFrame:
    score = F.count_if(F.col("met")) + F.count_if(~F.col("met") & F.col("partial")) * 0.5
    return criteria.groupBy("entity_id").agg(score.alias("score")).withColumn("level", F.when(F.col("score") >= 7, "HIGH").when(F.col("score") >= 4.5, "MEDIUM").otherwise("LOW"))


# ---- action plans ---------------------------------------------------------------------------------------------


def characterise(scored: DataFrame, documents: DataFrame, board: DataFrame) -> DataFrame:
    """What kind of association this is, from all its evidence rows.  documents: with classification."""
    rows = scored.drop("root_domain").join(documents.select("document_id", "root_domain", "classification"), "document_id")
    domain = rows.groupBy(*KEYS, "root_domain").agg(F.count("*").alias("n"), F.first("classification").alias("kind")).groupBy(*KEYS).agg(
        F.max("n").alias("largest"), F.count_if(F.col("kind").isin("major", "specialist")).alias("top_tier_domains"), F.count_if(F.col("kind") == "major").alias("major_domains")
    )
    per = rows.groupBy(*KEYS).agg(
        F.count("*").alias("n"), F.count_if(F.col("relationship_confidence") >= 0.8).alias("direct"), F.sum(X.scaled(F.col("entity_confidence"))).alias("confidence"),
        F.sum(X.scaled(F.col("proximity"))).alias("near"), F.count_if(F.col("classification").isin("major", "specialist")).alias("top"),
    )
    j = per.join(domain, KEYS).join(board.select(*KEYS, "domains"), KEYS)
    direct, top, largest = F.col("direct") / F.col("n"), F.col("top") / F.col("n"), F.col("largest") / F.col("n")
    mean = X.unscaled(F.col("confidence")) / F.col("n")
    strong = (top >= 0.25) | (F.col("top_tier_domains") >= 5) | (F.col("major_domains") >= 3)
    verdict = (
        F.when(mean < 0.75, "possibly_misattributed").when((F.col("domains") >= 8) & (direct >= 0.5) & strong, "central_and_corroborated").when((F.col("domains") >= 5) & (direct >= 0.4), "substantive")
        .when((largest >= 0.6) | (F.col("domains") <= 2), "concentrated").otherwise("peripheral")
    )
    return j.select(
        *KEYS, verdict.alias("verdict"), X.half_up(direct, 3).alias("direct_relationship_share"), X.half_up(mean, 3).alias("mean_entity_confidence"),
        X.half_up(X.unscaled(F.col("near")) / F.col("n"), 3).alias("mean_proximity"), X.half_up(top, 3).alias("top_tier_share"), "top_tier_domains", "major_domains", X.half_up(largest, 3).alias("top_domain_share"),
    )


def project_decay(scored: DataFrame, now: Column, half_life: float = 365.0, horizons: Sequence[int] = (90, 180, 365, 730), window: int = CURRENT_WINDOW_DAYS) -> DataFrame:
    """Per association and horizon: evidence still in the current window, and the weight that is left."""
    aged = scored.select(*KEYS, X.age_days(F.col("effective_date"), now).alias("age")).where("age IS NOT NULL")
    weight = lambda d: F.sum(X.scaled(F.power(F.lit(0.5), (F.col("age") + d) / half_life)))
    sums = aged.groupBy(*KEYS).agg(weight(0).alias("now"), *(weight(h).alias(f"w{h}") for h in horizons), *(F.count_if(F.col("age") + h <= window).alias(f"n{h}") for h in horizons))
    stacked = ", ".join(f"{h}, n{h}, w{h}" for h in horizons)
    return sums.selectExpr(*KEYS, "now", f"stack({len(horizons)}, {stacked}) AS (in_days, still_in_window, weight)").select(
        *KEYS, "in_days", "still_in_window", X.half_up(X.safe_div(F.col("weight"), F.col("now")), 3).alias("weight_remaining")
    )


def plan_displacement(board: DataFrame, counts: DataFrame, target: float | None = None) -> DataFrame:
    """Documents without the association that would bring its current share to the target (a third of it by default)."""
    j = board.join(counts, "entity_id")
    share = X.safe_div(F.col("current_documents"), F.col("entity_documents"))
    aim = F.lit(target) if target is not None else share / 3
    state = F.when(F.col("current_documents") == 0, "none_to_displace").when(aim >= share, "at_target").when(share < 0.02, "too_few").otherwise("applicable")
    needed = F.greatest(F.lit(0).cast("long"), F.ceil(X.safe_div(F.col("current_documents"), aim)) - F.col("entity_documents"))
    return j.select(*KEYS, state.alias("state"), X.half_up(share, 4).alias("current_share"), F.when(state == "applicable", needed).alias("additional_documents"))


def what_if(documents: DataFrame, evidence: DataFrame, new_documents: DataFrame, new_evidence: DataFrame, board_of) -> DataFrame:
    """Boards without and with hypothetical rows, joined; nothing is written, so nothing need be rolled back."""
    before = board_of(documents, evidence).select(*KEYS, "pias", "current_pias")
    after = board_of(documents.unionByName(new_documents, allowMissingColumns=True), evidence.unionByName(new_evidence, allowMissingColumns=True)).select(*KEYS, F.col("pias").alias("new_pias"), F.col("current_pias").alias("new_current_pias"))
    joined = before.join(after, KEYS, "full").fillna(0.0, ["pias", "current_pias", "new_pias", "new_current_pias"])
    moved = joined.select(*KEYS, X.half_up(F.col("new_pias") - F.col("pias"), 1).alias("delta"), X.half_up(F.col("new_current_pias") - F.col("current_pias"), 1).alias("current_delta"))
    return moved.where((F.abs("delta") >= 0.5) | (F.abs("current_delta") >= 0.5))


def by_movement(deltas: DataFrame) -> DataFrame:
    """what_if() with each association's place in its entity by how much it moves in all."""
    order = Window.partitionBy("entity_id").orderBy(F.desc(F.abs("delta") + F.abs("current_delta")), "association_id")
    return deltas.withColumn("place", F.row_number().over(order))

