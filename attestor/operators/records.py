"""Records that analysts keep: aliases, markers, polarity, surface forms, drafts, assets; updates as folds over events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from attestor.functions import exprs as X
from attestor.functions import hashing as H
from attestor.functions import text as T
from attestor.functions.html import host_of
from attestor.model import DEFAULT, MARKER_WEIGHTS, Model
from attestor.operators.scoring import KEYS

# What a new document is taken to be like (entity and relationship confidence, proximity).
NEW_DOCUMENT = (0.95, 0.85, 0.75)


def add_aliases(known: DataFrame, added: DataFrame) -> DataFrame:
    """Aliases (entity_id, alias, origin, searchable) with new ones, squeezed; one that is known stays as it is."""
    clean = added.withColumn("alias", T.squeezed_column(F.col("alias"))).where("alias <> ''")
    first = clean.groupBy("entity_id", "alias").agg(F.min(F.struct("origin", "searchable")).alias("x")).select("entity_id", "alias", "x.*")
    return known.unionByName(first.join(known.select("entity_id", "alias"), ["entity_id", "alias"], "left_anti").select(*known.columns))


def normal_markers(markers: DataFrame) -> DataFrame:
    """Markers (entity_id, kind, value, weight, polarity, at) as stored: unknown kinds are other, addresses their root domain,
    weights by kind; of one marker the last weight and polarity."""
    kind = F.when(F.col("kind").isin(*MARKER_WEIGHTS), F.col("kind")).otherwise("other")
    plain = T.squeezed_column(F.col("value"))
    host = F.coalesce(host_of(plain), F.lower(plain))
    value = F.when(F.col("kind") == "url", X.root_domain(host)).otherwise(plain)
    default = F.coalesce(*(F.when(F.col("kind") == k, F.lit(w)) for k, w in MARKER_WEIGHTS.items()))
    rows = markers.withColumn("kind", kind).withColumn("value", value).where("value <> ''").withColumn("weight", F.coalesce("weight", default))
    last = F.max_by(F.struct("weight", "polarity"), F.struct("at", "weight", "polarity")).alias("x")
    return rows.groupBy("entity_id", "kind", "value").agg(last).select("entity_id", "kind", "value", "x.*")


def own_domains(markers: DataFrame, assets: DataFrame) -> DataFrame:
    """(entity_id, domain): address markers that do not speak against the entity, and hosts of owned assets."""
    bare = lambda c: F.regexp_replace(F.lower(c), r"^www\.", "")
    marked = markers.where((F.col("kind") == "url") & (F.col("polarity") != -1)).select("entity_id", bare(F.col("value")).alias("domain"))
    owned = assets.where(F.col("kind") == "owned").select("entity_id", bare(F.col("host_domain")).alias("domain"))
    return marked.unionByName(owned).where("domain <> ''").distinct()


def polarity(settings: DataFrame) -> DataFrame:
    """settings (entity_id, association_id, polarity, set_at): the last of each association; null takes it back."""
    last = settings.groupBy(*KEYS).agg(F.max_by(F.coalesce("polarity", F.lit("")), F.struct("set_at", F.coalesce("polarity", F.lit("")))).alias("polarity"))
    return last.where("polarity <> ''")


def suggest_adverse(evidence: DataFrame, documents: DataFrame, decided: DataFrame, markers: DataFrame | None = None, least: int = 5, share: float = 0.45, limit: int = 10) -> DataFrame:
    """Per entity associations an analyst may want to mark adverse: in enough documents, mostly negative, not decided and no
    marker of the entity's; the largest first."""
    rows = evidence.join(documents.select("document_id", "entity_id"), "document_id")
    sums = rows.groupBy(*KEYS).agg((F.sum(X.scaled(F.col("negative"))) / F.count("*") / F.lit(float(X.NANO))).alias("_share"), F.countDistinct("document_id").alias("documents"))
    fit = sums.where((F.col("documents") >= least) & (F.col("_share") >= share)).join(decided.select(*KEYS), KEYS, "left_anti")
    if markers is not None:
        keys = markers.select("entity_id", T.label_key_column(F.col("value")).alias("_key")).distinct()
        fit = fit.withColumn("_key", T.label_key_column(F.col("association_id"))).join(keys, ["entity_id", "_key"], "left_anti").drop("_key")
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("documents"), "association_id"))
    return fit.withColumn("place", place).where(F.col("place") <= limit).select(*KEYS, "documents", X.half_up(F.col("_share"), 2).alias("negative_share"), "place")


def surface_forms(evidence: DataFrame) -> DataFrame:
    """(association_id, surface_form, occurrences) of evidence's forms, squeezed."""
    return evidence.withColumn("surface_form", T.squeezed_column(F.col("surface_form"))).where("surface_form <> ''").groupBy("association_id", "surface_form").agg(F.count("*").alias("occurrences"))


def split_association(evidence: DataFrame, splits: DataFrame) -> DataFrame:
    """evidence with the surface forms that splits (association_id, surface_form, new_association_id) name moved out."""
    joined = evidence.join(splits, ["association_id", "surface_form"], "left")
    return joined.withColumn("association_id", F.coalesce("new_association_id", "association_id")).drop("new_association_id").select(*evidence.columns)


def rekeyed(rows: DataFrame, merges: DataFrame, sums: Sequence[str], maxima: Sequence[str]) -> DataFrame:
    """Rows per (association_id, document_id) after merges (association_id, target): rows that now share a key are added up, so
    that a merge loses none of them."""
    moved = rows.join(merges, "association_id", "left").withColumn("association_id", F.coalesce("target", "association_id"))
    return moved.groupBy("association_id", "document_id").agg(*(F.sum(c).alias(c) for c in sums), *(F.max(c).alias(c) for c in maxima))


def support(evidence: DataFrame, documents: DataFrame, excluded_urls: DataFrame | None = None) -> DataFrame:
    """Accepted documents with evidence for each association, without the given addresses: (entity_id, association_id, sources,
    independent_sources)."""
    ok = documents.where(F.col("verdict") == "accept")
    if excluded_urls is not None:
        ok = ok.join(excluded_urls, "canonical_url", "left_anti")
    pairs = evidence.select("association_id", "document_id").distinct().join(ok.select("entity_id", "document_id", "root_domain", "cluster_id"), "document_id")
    key = F.coalesce(F.concat(F.lit("cluster:"), F.col("cluster_id").cast("string")), F.concat(F.lit("domain:"), F.col("root_domain").cast("string")))
    return pairs.groupBy(*KEYS).agg(F.count("*").alias("sources"), F.countDistinct(key).alias("independent_sources"))


def resolve_facts(claims: DataFrame, associations: DataFrame, aliases: DataFrame, supported: DataFrame, least: int = 1) -> DataFrame:
    """claims (entity_id, claim_id, claim) with the association their label stands for (itself or by an alias, active ones only) and
    whether enough sources support it.  associations: entity_id, association_id, label, status, merged_into."""
    key = lambda c: T.label_key_column(F.col(c))
    target = associations.select(F.col("association_id").alias("_t"), F.col("status").alias("_t_status"))
    direct = associations.withColumn("_to", F.when(F.col("status") == "merged", F.col("merged_into")).otherwise(F.col("association_id")))
    keyed = direct.select("entity_id", key("label").alias("_key"), F.col("_to"), F.when(F.col("status") == "active", 0).otherwise(1).alias("_order"))
    named = aliases.join(direct.select("association_id", "entity_id", "_to"), "association_id").select("entity_id", key("surface_form").alias("_key"), "_to", F.lit(2).alias("_order"))
    best = keyed.unionByName(named).join(target, F.col("_to") == F.col("_t")).groupBy("entity_id", "_key").agg(F.min_by(F.when(F.col("_t_status") == "active", F.col("_to")), F.struct("_order", "_to")).alias("association_id"))
    found = claims.withColumn("_key", key("claim")).join(best, ["entity_id", "_key"], "left").join(supported, KEYS, "left")
    sources = F.coalesce("sources", F.lit(0).cast("long"))
    return found.select("entity_id", "claim_id", "association_id", sources.alias("sources"), F.when(F.col("association_id").isNotNull() & (sources >= least), "resolved").otherwise("unsupported").alias("resolution"))


def new_drafts(texts: DataFrame, audited: DataFrame, shortest: int = 80) -> DataFrame:
    """texts (draft_id, text): those long enough, with the hash that freezes them and whether the draft's text was audited
    before (audited: draft_id, text_hash)."""
    body = F.length(T.squeezed_column(F.col("text")))
    rows = texts.where(body >= shortest).select("draft_id", H.content_hash(F.col("text")).alias("text_hash"))
    return rows.join(audited.withColumn("reused", F.lit(True)), ["draft_id", "text_hash"], "left").withColumn("reused", F.coalesce("reused", F.lit(False)))


def current_signoffs(signoffs: DataFrame, drafts: DataFrame) -> DataFrame:
    """Sign-offs (draft_id, text_hash, ...) of the text a draft has now."""
    return signoffs.join(drafts.select("draft_id", "text_hash"), ["draft_id", "text_hash"], "left_semi")


def assets(registrations: DataFrame) -> DataFrame:
    """registrations (entity_id, url, kind, label, at, status): per asset the last kind and status and the last label given."""
    order = F.struct("at", "kind", "status")
    kind = F.when(F.col("kind") == "owned", "owned").otherwise("placed")
    return registrations.groupBy("entity_id", "url").agg(
        F.max_by(kind, order).alias("kind"), F.max_by("status", order).alias("status"), F.max_by("label", F.when(F.col("label").isNotNull(), order)).alias("label"),
    ).withColumn("host_domain", X.root_domain(host_of(F.col("url"))))


def asset_report(live: DataFrame, checks: DataFrame) -> DataFrame:
    """Per entity: live assets (entity_id, asset_id), those audited, the share that only restates (C9 fails) and those to rewrite
    (C5 neither passes nor lacks data while C8 warns).  checks: asset_id, check_id, result of the last audit."""
    of = lambda check: F.max(F.when(F.col("check_id") == check, F.col("result")))
    wide = checks.groupBy("asset_id").agg(of("C5").alias("c5"), of("C8").alias("c8"), of("C9").alias("c9"))
    rows = live.join(wide, "asset_id", "left").withColumn("_audited", F.coalesce("c5", "c8", "c9").isNotNull())
    rewrite = ~F.col("c5").isin("pass", "insufficient") & (F.col("c8") == "warn")
    sums = rows.groupBy("entity_id").agg(F.count("*").alias("live"), F.count_if("_audited").alias("audited"), F.count_if(F.col("c9") == "fail").alias("_restated"), F.count_if(F.coalesce(rewrite, F.lit(False))).alias("rewrite_candidates"))
    return sums.select("entity_id", "live", "audited", X.half_up(X.safe_div(F.col("_restated"), F.col("audited"), None), 4).alias("restatement_share"), "rewrite_candidates")


def tier_evidence(tier: Column, model: Model = DEFAULT) -> Column:
    """What a new document of a source tier would add, by the assumptions for new documents."""
    weights = model["classification"]
    weight = F.coalesce(*(F.when(tier == k, F.lit(w)) for k, w in weights.items()), F.lit(0.5))
    return X.half_up(F.lit(NEW_DOCUMENT[0] * NEW_DOCUMENT[1] * NEW_DOCUMENT[2]) * weight, 6)


def with_spam(documents: DataFrame, scores: DataFrame) -> DataFrame:
    """documents with the spam score of their root domain, where one is known and the document has none."""
    known = scores.groupBy("root_domain").agg(F.max("spam_score").alias("_spam"))
    return documents.join(known, "root_domain", "left").withColumn("spam_score", F.coalesce("spam_score", "_spam")).drop("_spam")


def page_content(page: Column) -> Column:
    """A parsed page struct<header, main, secondary, footer: array<string>> as text, parts and paragraphs apart."""
    parts = F.concat(*(F.coalesce(page[name], F.array().cast("array<string>")) for name in ("header", "main", "secondary", "footer")))
    return F.array_join(F.filter(F.transform(parts, T.squeezed_column), lambda x: x != ""), "\n\n")


def pasted_page(direct: Column, fallback: Column, redirects: Column, least: int = 1500, most: int = 3_000_000, hops: int = 4) -> Column:
    """struct<text, via>: the page as fetched, unless it was redirected too often or is too short and the provider's is longer."""
    read = F.when(redirects <= hops, F.substring(F.coalesce(direct, F.lit("")), 1, most)).otherwise("")
    other = F.coalesce(fallback, F.lit(""))
    use = (F.length(read) >= least) | (F.length(other) <= F.length(read))
    return F.struct(F.when(use, read).otherwise(other).alias("text"), F.when(use, "direct").otherwise("provider").alias("via"))


def contains_any(columns: Sequence[str], term: str) -> Column:
    """Whether any of the columns contains the term, whatever its case (LIKE '%term%')."""
    out = F.lit(False)
    for c in columns:
        out = out | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(term.lower()))
    return out


def strict_schema(schema):
    """A JSON schema with every property required and no others allowed, at all depths."""
    if isinstance(schema, list):
        return [strict_schema(x) for x in schema]
    if not isinstance(schema, dict):
        return schema
    out = {k: strict_schema(v) if k in ("anyOf", "oneOf", "allOf", "items") else v for k, v in schema.items()}
    if out.get("type") == "object" or "properties" in out:
        if "properties" in out:
            out["properties"] = {k: strict_schema(v) for k, v in out["properties"].items()}
            out["required"] = list(out["properties"])
        out["additionalProperties"] = False
    return out
