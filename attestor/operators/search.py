"""The entity's search page beside its corpus: which surfaces carry an association, what became of each result, probes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from attestor.functions import exprs as X
from attestor.functions import text as T
from attestor.operators.scoring import KEYS

# The default hierarchy, parent before its children.
HIERARCHY = (
    ("Arts & Culture", ("Contemporary Art", "Museum Patronage", "Collecting", "Art Collection")),
    ("Philanthropy", ("Education Philanthropy", "Arts Philanthropy", "Medical Philanthropy", "Charitable Foundation")),
    ("Legal", ("Lawsuit", "Litigation", "Settlement", "Regulatory Action")),
    ("Controversy", ("Investigation", "Allegation", "Criticism")),
)
STAGES = ("evidence", "fallback_only", "no_evidence", "not_read", "in_review", "rejected", "not_checked", "not_collected")


def link_results(results: DataFrame, documents: DataFrame) -> DataFrame:
    """results (entity_id, rank, url) with document_id: by address or canonical address, two equi joins rather than an OR."""
    by_url = documents.select("url", F.col("document_id").alias("by_url"))
    by_canonical = documents.select(F.col("canonical_url").alias("_canonical"), F.col("document_id").alias("by_canonical")).groupBy("_canonical").agg(F.min("by_canonical").alias("by_canonical"))
    joined = results.withColumn("_canonical", X.canonical_url(F.col("url"))).join(by_url, "url", "left").join(by_canonical, "_canonical", "left")
    return joined.withColumn("document_id", F.coalesce("by_url", "by_canonical")).drop("by_url", "by_canonical", "_canonical")


def document_ranks(results: DataFrame) -> DataFrame:
    """Best rank of each document."""
    return results.where("document_id IS NOT NULL").groupBy("document_id").agg(F.min("rank").alias("rank"))


def match_by_text(results: DataFrame, labels: DataFrame) -> DataFrame:
    """(entity_id, rank, association_id) of results whose title holds a label, by equi join on the label's words.

    results: entity_id, rank, title; labels: entity_id, association_id, label.
    """
    folded = results.select("entity_id", "rank", T.words_column(F.col("title")).alias("w"))
    sizes = labels.select(F.size(T.words_column(F.col("label"))).alias("n")).where("n > 0").distinct()
    keyed = labels.select("entity_id", "association_id", T.folded_column(F.col("label")).alias("run"), F.size(T.words_column(F.col("label"))).alias("n")).where("n > 0")
    # label lengths are a handful of numbers; each title is cut once per length
    lengths = F.broadcast(sizes.agg(F.array_sort(F.collect_set("n")).alias("lengths")).withColumn("_one", F.lit(1)))
    runs = folded.withColumn("_one", F.lit(1)).join(lengths, "_one").select("*", F.explode("lengths").alias("n")).where(F.size("w") >= F.col("n"))
    grams = runs.select("entity_id", "rank", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.array_join(F.slice("w", i, F.col("n")), " "))).alias("run"))
    return grams.join(keyed, ["entity_id", "n", "run"]).select("entity_id", "rank", "association_id").distinct()


def overlay(classified: DataFrame) -> DataFrame:
    """Per result its associations as one text, null where nothing is classified."""
    return classified.groupBy("entity_id", "rank", "document_id").agg(F.nullif(F.array_join(F.array_sort(F.collect_set(F.col("association_id").cast("string"))), ","), F.lit("")).alias("associations"))


def unclassified(results: DataFrame, classified: DataFrame) -> DataFrame:
    return results.join(classified.where("association_id IS NOT NULL").select("entity_id", "rank").distinct(), ["entity_id", "rank"], "left_anti")


def surfaces(classified: DataFrame, signals: DataFrame, labels: DataFrame) -> DataFrame:
    """Per association: share of the organic first page, and whether each other surface names it.

    signals: entity_id, surface, text (related searches, questions, stories, panel); labels: entity_id, association_id, label.
    """
    page = classified.where("rank <= 10").groupBy("entity_id").agg(F.countDistinct("rank").alias("results"))
    organic = classified.where("rank <= 10 AND association_id IS NOT NULL").groupBy(*KEYS).agg(F.countDistinct("rank").alias("organic"))
    named = match_by_text(signals.select("entity_id", F.struct("surface", F.xxhash64("text").alias("k")).alias("rank"), F.col("text").alias("title")), labels)
    seen = named.groupBy(*KEYS).agg(*(F.max(F.col("rank.surface") == s).alias(s) for s in ("related", "questions", "stories", "panel")))
    joined = labels.select(*KEYS).join(organic, KEYS, "left").join(seen, KEYS, "left").join(page, "entity_id")
    return joined.select(*KEYS, X.half_up(X.safe_div(F.coalesce("organic", F.lit(0)), F.col("results")), 4).alias("organic_share"), *(F.coalesce(s, F.lit(False)).alias(s) for s in ("related", "questions", "stories", "panel")))


def needs_full_read(status: Column, body_chars: Column, least: int = 1500) -> Column:
    return status.isin("snippet_only", "failed", "blocked") | (F.coalesce(body_chars, F.lit(0)) < least)


def page_trace(results: DataFrame, documents: DataFrame, evidence: DataFrame) -> DataFrame:
    """What became of each result: the first stage at which it stopped.

    results: entity_id, rank, document_id; documents: document_id, verdict, fetch_status, body_chars;
    evidence: document_id, extractor.
    """
    rows = evidence.groupBy("document_id").agg(F.count("*").alias("rows"), F.count_if(F.col("extractor") == "heuristic").alias("heuristic"))
    j = results.join(documents.select("document_id", "verdict", "fetch_status", "body_chars", F.lit(True).alias("collected")), "document_id", "left").join(rows, "document_id", "left")
    n = F.coalesce("rows", F.lit(0))
    stage = (
        F.when(F.col("collected").isNull(), "not_collected").when(F.col("verdict").isNull(), "not_checked").when(F.col("verdict") == "reject", "rejected").when(F.col("verdict") == "review", "in_review")
        .when((n == 0) & needs_full_read(F.col("fetch_status"), F.col("body_chars")), "not_read").when(n == 0, "no_evidence").when(F.col("heuristic") >= n, "fallback_only").otherwise("evidence")
    )
    return j.select("entity_id", "rank", "document_id", n.alias("rows"), stage.alias("stage"))


def probe_budget(most: Column, explicit: Column, automatic: Column, share: float = 0.4, weight: float = 0.75) -> dict[str, Column]:
    """Documents for probes, and for each probe that someone asked for or that was found."""
    budget = F.greatest(F.lit(0).cast("long"), F.floor(most * share))
    own = F.when(automatic > 0, budget * weight).otherwise(budget.cast("double"))
    found = F.when(explicit > 0, budget * (1 - weight)).otherwise(budget.cast("double"))
    each = lambda pool, n, least: F.when(n > 0, F.greatest(F.lit(least).cast("long"), F.floor(F.try_divide(pool, n.cast("double"))))).otherwise(F.lit(0).cast("long"))
    return {"budget": budget, "per_explicit": each(own, explicit, 20), "per_automatic": each(found, automatic, 10)}


def probe_terms(related: DataFrame, names: Sequence[str], limit: int = 8) -> DataFrame:
    """Related searches (place, query) without the entity's own words and generic ones: up to four words, each term once."""
    own = F.array(*(F.lit(w) for n in names for w in T.fold(n).split()), *(F.lit(w) for w in sorted(T.GENERIC_WORDS)))
    words = F.array_except(T.words_column(F.col("query")), own)
    terms = related.select("place", F.array_join(words, " ").alias("term"), F.size(words).alias("n")).where("n BETWEEN 1 AND 4")
    return terms.groupBy("term").agg(F.min("place").alias("place")).orderBy("place", "term").limit(limit)


def default_hierarchy(associations: DataFrame, hierarchy: Sequence[tuple[str, Sequence[str]]] = HIERARCHY) -> DataFrame:
    """associations (label): (parent, child) for known children; a parent that is not there needs two children."""
    spark = associations.sparkSession
    seed = spark.createDataFrame([(p, T.label_key(p), T.label_key(c)) for p, children in hierarchy for c in children], "parent string, parent_key string, child_key string")
    keyed = associations.select("label", T.label_key_column(F.col("label")).alias("key")).groupBy("key").agg(F.min("label").alias("label"))
    children = keyed.join(F.broadcast(seed), keyed["key"] == seed["child_key"]).select("parent", "parent_key", F.col("label").alias("child"), "child_key")
    counts = children.groupBy("parent").agg(F.count("*").alias("n"))
    there = keyed.select(F.col("key").alias("parent_key"), F.lit(True).alias("there"))
    ok = children.join(counts, "parent").join(there, "parent_key", "left").where(F.col("there").isNotNull() | (F.col("n") >= 2))
    return ok.where("parent_key <> child_key").select("parent", "child")


def diagnose(entities: DataFrame, jobs: DataFrame, documents: DataFrame, evidence: DataFrame, associations: DataFrame) -> DataFrame:
    """Why an entity shows nothing: the first stage of its last build that left nothing behind.

    jobs: entity_id, job_id, status; documents: entity_id, document_id, verdict; evidence: entity_id;
    associations: entity_id, status.
    """
    last = jobs.groupBy("entity_id").agg(F.max_by("status", "job_id").alias("job"))
    docs = documents.groupBy("entity_id").agg(F.count("*").alias("documents"), F.count_if(F.col("verdict") == "accept").alias("accepted"))
    rows = evidence.groupBy("entity_id").agg(F.count("*").alias("evidence"))
    active = associations.where("status = 'active'").groupBy("entity_id").agg(F.count("*").alias("associations"))
    j = entities.join(last, "entity_id", "left").join(docs, "entity_id", "left").join(rows, "entity_id", "left").join(active, "entity_id", "left").fillna(0, ["documents", "accepted", "evidence", "associations"])
    verdict = (
        F.when(F.col("job").isNull(), "never_built").when(F.col("job").isin("running", "queued"), "in_progress").when(F.col("job") == "failed", "failed").when(F.col("job") == "cancelled", "cancelled")
        .when(F.col("documents") == 0, "no_corpus").when(F.col("accepted") == 0, "all_rejected").when(F.col("evidence") == 0, "no_evidence").when(F.col("associations") == 0, "all_merged_or_excluded").otherwise("ok")
    )
    return j.select("entity_id", verdict.alias("verdict"), "documents", "accepted", "evidence", "associations")


#: What an event makes of a draft, by its state before.
DRAFT_STEPS: Mapping[tuple[str, str], str] = {
    ("draft", "edit"): "draft", ("approved", "edit"): "draft", ("published", "edit"): "draft", ("draft", "approve"): "approved", ("approved", "publish"): "published", ("approved", "approve"): "approved",
}


def draft_states(events: DataFrame) -> DataFrame:
    """events (draft_id, at, event): each draft's state after all its events; steps that are not allowed change nothing."""
    ordered = events.groupBy("draft_id").agg(F.array_sort(F.collect_list(F.struct("at", "event"))).alias("events"))

    def step(state: Column, e: Column) -> Column:
        out = F.when(F.lit(False), state)
        for (before, event), after in DRAFT_STEPS.items():
            out = out.when((state == before) & (e["event"] == event), F.lit(after))
        return out.otherwise(state)

    return ordered.select("draft_id", F.aggregate("events", F.lit("draft"), step).alias("state"))


def entity_summary(board: DataFrame, prior: DataFrame, gaps: DataFrame, top: int = 5) -> DataFrame:
    """Per entity and reading its associations: the strongest, those that moved 15 points on three documents or more, gaps of 15."""
    strongest = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("pias"), "association_id")) <= top
    moved = board.join(prior.select(*KEYS, F.col("current_pias").alias("was")), KEYS, "left")
    change = F.col("current_pias") - F.col("was")
    rows = [
        board.withColumn("_ok", strongest).where("_ok").select(*KEYS, F.lit("strongest").alias("reading"), F.col("pias").alias("value")),
        moved.where((F.abs(change) >= 15) & (F.col("current_documents") >= 3)).select(*KEYS, F.lit("moved").alias("reading"), X.half_up(change, 1).alias("value")),
        gaps.where(F.abs("gap") >= 15).select(*KEYS, F.lit("gap").alias("reading"), F.col("gap").alias("value")),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])



_ITEMS = "array<struct<type:string,title:string,subtitle:string,description:string,items:array<string>>>"


def search_signals(items: Column) -> Column:
    """What a captured page (its items as JSON) shows beside results: struct<related_searches, people_also_ask, people_also_search,
    top_stories, knowledge_graph>.  An element of an item is a string or an object; objects stay JSON until they are read."""
    listed = F.coalesce(F.from_json(items, _ITEMS), F.from_json(F.lit("[]"), _ITEMS))
    of = lambda kind: F.flatten(F.transform(F.filter(listed, lambda i: i["type"] == kind), lambda i: F.coalesce(i["items"], F.array().cast("array<string>"))))
    is_object = lambda e: F.startswith(F.ltrim(e), F.lit("{"))
    field = lambda e, name: F.get_json_object(e, f"$.{name}")
    given = lambda array: F.array_distinct(F.filter(array, lambda x: x.isNotNull() & (x != "")))
    related = given(F.transform(F.filter(of("related_searches"), lambda e: ~is_object(e)), lambda e: F.trim(e)))
    asked = given(F.transform(F.filter(of("people_also_ask"), is_object), lambda e: field(e, "title")))
    searched = given(F.transform(of("people_also_search"), lambda e: F.when(is_object(e), field(e, "title")).otherwise(e)))
    stories = F.filter(F.transform(of("top_stories"), lambda e: F.struct(field(e, "title").alias("title"), field(e, "url").alias("url"), F.coalesce(field(e, "source"), field(e, "domain")).alias("source"))), lambda s: s["title"].isNotNull())
    panel = F.get(F.filter(listed, lambda i: i["type"] == "knowledge_graph"), F.lit(0))
    rows = F.coalesce(panel["items"], F.array().cast("array<string>"))
    facts = F.transform(
        F.filter(rows, lambda e: (field(e, "type") == "knowledge_graph_row_item") & (F.coalesce(field(e, "text"), F.lit("")) != "")), lambda e: F.struct(field(e, "title").alias("label"), field(e, "text").alias("text"))
    )
    domains = given(F.flatten(F.transform(rows, lambda e: F.coalesce(F.from_json(field(e, "links"), "array<struct<domain:string>>")["domain"], F.array().cast("array<string>")))))
    graph = F.when(panel.isNotNull(), F.struct(panel["title"].alias("title"), panel["subtitle"].alias("subtitle"), panel["description"].alias("description"), facts.alias("facts"), domains.alias("sources")))
    return F.struct(related.alias("related_searches"), asked.alias("people_also_ask"), searched.alias("people_also_search"), stories.alias("top_stories"), graph.alias("knowledge_graph"))


def surface_texts(signals: Column) -> Column:
    """struct<related, also_ask, panel>: each surface of search_signals() as one text."""
    graph = signals["knowledge_graph"]
    panel = F.concat(F.array(graph["subtitle"], graph["description"]), F.coalesce(F.transform(graph["facts"], lambda f: f["text"]), F.array().cast("array<string>")))
    join = lambda array: F.array_join(F.filter(array, lambda x: x.isNotNull() & (x != "")), " | ")
    return F.struct(join(signals["related_searches"]).alias("related"), join(signals["people_also_ask"]).alias("also_ask"), join(F.coalesce(panel, F.array().cast("array<string>"))).alias("panel"))


def search_view(classified: DataFrame, page: DataFrame, labels: DataFrame, shown: DataFrame, limit: int = 30) -> DataFrame:
    """Per entity and association of its page: results, those in the first ten, best rank, share of the results, and on which other
    surface it stands.  classified: entity_id, rank, association_id; page: entity_id, rank; labels: association_id, forms
    (array); shown: entity_id and the fields of surface_texts()."""
    total = page.groupBy("entity_id").agg(F.count("*").alias("total"))
    rows = classified.where("association_id IS NOT NULL").select(*KEYS, "rank").distinct().groupBy(*KEYS).agg(
        F.count("*").alias("results"), F.count_if(F.col("rank") <= 10).alias("top10"), F.min("rank").alias("best_rank")
    )
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("results"), "best_rank", "association_id"))
    kept = rows.withColumn("place", place).where(F.col("place") <= limit)
    joined = kept.join(total, "entity_id").join(labels, "association_id").join(shown, "entity_id", "left")
    on = lambda surface: F.exists("forms", lambda f: T.contains_phrase_column(F.coalesce(F.col(surface), F.lit("")), f)).alias(f"in_{surface}")
    return joined.select(*KEYS, "place", "results", "top10", "best_rank", X.half_up(X.safe_div(F.col("results"), F.col("total")), 3).alias("organic_share"), on("related"), on("also_ask"), on("panel"))


def top_by_document(scores: DataFrame, top: int = 5) -> DataFrame:
    """evidence_scores() to each document's associations with the highest single score."""
    best = scores.groupBy("document_id", "association_id").agg(F.max("evidence_score").alias("score"))
    place = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("score"), "association_id"))
    return best.withColumn("place", place).where(F.col("place") <= top).select("document_id", "association_id", "place")
