"""Corrections and updates without mutation: event tables folded into the rows they correct, each a new DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from attestor.functions import exprs as X
from attestor.operators.graph import follow_merges


def merge_sources(sources: Sequence[DataFrame], key: str) -> DataFrame:
    """One row per key from several sources: the first source that has the row owns it, later ones fill its nulls."""
    tagged = [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)]
    rows = tagged[0]
    for more in tagged[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    columns = [c for c in rows.columns if c not in (key, "_source")]
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_source"))).alias(c)
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(*map(first, columns), F.min("_source").alias("owner"))


def upsert(current: DataFrame, incoming: DataFrame, key: str, fill_only: bool = True) -> DataFrame:
    """New keys are added; of known ones only nulls are filled, or with fill_only off, given values replace."""
    return merge_sources([current, incoming] if fill_only else [incoming, current], key).drop("owner")


def changed_versions(versions: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Versions whose value differs from the one before."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return versions.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col(value))).drop("_before")


def latest(rows: DataFrame, keys: Sequence, *order) -> DataFrame:
    """The first row per key by the given order."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def apply_reviews(documents: DataFrame, evidence: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reviews (action, target, value, reviewed_at; surface for splits) applied before scoring; of contrary ones the last holds.

    wrong_entity / right_entity set a document's verdict, exclude_source drops a domain's documents, set_tier overrides a
    domain's class; exclude_evidence / include_evidence drop a piece of evidence by its evidence_id, split_association moves a
    surface form to an association of its own, merge_association renames an association, exclude_association drops it.
    """
    surface = F.col("surface") if "surface" in reviews.columns else F.lit(None).cast("string")
    rows = reviews.withColumn("surface", surface)
    group = F.when(F.col("action").isin("wrong_entity", "right_entity"), "verdict").when(F.col("action").isin("exclude_evidence", "include_evidence"), "evidence").otherwise(F.col("action"))
    last = latest(rows.withColumn("_group", group), ["_group", "target", F.coalesce("surface", F.lit(""))], F.desc("reviewed_at"), "action")
    of = lambda action, *cols: last.where(F.col("action") == action).select(*cols)
    verdicts = last.where(F.col("_group") == "verdict").select(F.col("target").alias("_doc"), F.when(F.col("action") == "wrong_entity", "reject").otherwise("accept").alias("_verdict"))
    docs = documents.join(verdicts, documents["document_id"].cast("string") == F.col("_doc"), "left").withColumn("verdict", F.coalesce("_verdict", "verdict")).drop("_doc", "_verdict")
    sources = of("exclude_source", F.col("target").alias("_domain"))
    docs = docs.join(sources, docs["root_domain"].cast("string") == F.col("_domain"), "left_anti")
    tiers = of("set_tier", F.col("target").alias("_domain"), F.col("value").alias("classification"))
    docs = docs.drop("classification").join(tiers, docs["root_domain"].cast("string") == F.col("_domain"), "left").drop("_domain")
    if "evidence_id" in evidence.columns:
        dropped = of("exclude_evidence", F.col("target").alias("_evidence"))
        evidence = evidence.join(dropped, evidence["evidence_id"].cast("string") == F.col("_evidence"), "left_anti")
    if "surface_form" in evidence.columns:
        splits = of("split_association", F.col("target").alias("_from"), F.col("surface").alias("_form"), F.col("value").alias("_to"))
        joined = evidence.join(splits, (evidence["association_id"] == F.col("_from")) & (evidence["surface_form"] == F.col("_form")), "left")
        evidence = joined.withColumn("association_id", F.coalesce("_to", "association_id")).drop("_from", "_form", "_to")
    merges = of("merge_association", F.col("target").alias("id"), F.col("value").alias("merged_into"))
    targets = follow_merges(merges.unionByName(merges.selectExpr("merged_into AS id", "CAST(NULL AS STRING) AS merged_into").join(merges.select("id"), "id", "left_anti")).distinct())
    ev = evidence.join(targets, evidence["association_id"] == targets["id"], "left").withColumn("association_id", F.coalesce("target", "association_id")).drop("id", "target")
    gone = of("exclude_association", F.col("target").alias("_gone"))
    return docs, ev.join(gone, ev["association_id"] == F.col("_gone"), "left_anti")


def recategorised(associations: DataFrame, reviews: DataFrame) -> DataFrame:
    """associations (association_id, category, ...) with the category that the last recategorise review gives them."""
    last = latest(reviews.where(F.col("action") == "recategorise"), ["target"], F.desc("reviewed_at")).select(F.col("target").alias("_target"), F.col("value").alias("_category"))
    return associations.join(last, associations["association_id"] == F.col("_target"), "left").withColumn("category", F.coalesce("_category", "category")).drop("_target", "_category")


def usage(calls: DataFrame) -> DataFrame:
    """Calls, failures and cost by provider and endpoint."""
    return calls.groupBy("provider", "endpoint").agg(F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("failures"), X.half_up(F.coalesce(F.sum("cost"), F.lit(0.0)), 4).alias("cost"))
