"""Choosing what a new text is about: candidates, facts under caps, passages."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from attestor.functions import text as T


def growth_candidates(board: DataFrame, limit: int = 15) -> DataFrame:
    """Associations worth writing about: present, not negative, not already dominant, by recent strength and sources."""
    fit = (F.col("sentiment") != "negative") & (F.col("documents") >= 2) & (F.col("domains") >= 2) & (F.col("current_pias") < 75) & (F.col("current_documents") > 0)
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("current_pias"), F.desc("independent_sources"), F.desc("documents"), "association_id"))
    return board.where(fit).withColumn("place", place).where(F.col("place") <= limit)


FACT = "entity_id {0}, association_id string, document_id long, evidence_id long, place int"


def pick_facts(facts: DataFrame, per_association: int = 5, most: int = 25, pool: int = 600, shortest: int = 40, block_terms: Sequence[str] = ()) -> DataFrame:
    """Facts (entity_id, association_id, document_id, cluster_id, evidence_id, weight, page_rank, passage) for a text.

    Of an entity's ``pool`` heaviest, those on the search page come first by rank, then the others by weight, and one after the
    other is taken unless its association has ``per_association``, its passage is short or names a blocked term, or its
    document or cluster is used; ``most`` are taken.  What is taken depends on what was taken before, so the pool, which has
    a fixed size, is walked in one task.
    """
    heaviest = Window.partitionBy("entity_id").orderBy(F.desc("weight"), "association_id", "document_id", "evidence_id", "passage")
    wanted = facts.withColumn("_place", F.row_number().over(heaviest)).where(F.col("_place") <= pool).select("entity_id", "association_id", "document_id", F.col("cluster_id").cast("string").alias("cluster_id"), "evidence_id", "page_rank", F.col("_place").alias("at"), "passage")
    kind = facts.schema["entity_id"].dataType.simpleString()
    blocked = list(block_terms)

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["page_rank", "at"], na_position="last")
        taken, counts, documents, clusters = [], {}, set(), set()
        for entity, association, document, cluster, evidence, passage in zip(*(frame[c] for c in ("entity_id", "association_id", "document_id", "cluster_id", "evidence_id", "passage"))):
            body = T.squeeze(passage or "")
            used = document in documents or (cluster is not None and cluster in clusters)
            if counts.get(association, 0) >= per_association or len(body) < shortest or used or (blocked and T.occurrences(body, blocked)):
                continue
            documents.add(document)
            clusters.add(cluster)
            counts[association] = counts.get(association, 0) + 1
            taken.append((entity, association, document, evidence, len(taken) + 1))
            if len(taken) == most:
                break
        return pd.DataFrame(taken, columns=["entity_id", "association_id", "document_id", "evidence_id", "place"])

    return wanted.groupBy("entity_id").applyInPandas(walk, FACT.format(kind))


def passages(texts: DataFrame, size: int = 700, most: int = 25) -> DataFrame:
    """(text_id, place, passage): paragraphs packed up to ``size`` characters; longer ones are cut between sentences."""

    @F.pandas_udf("array<string>")
    def chunk(column: pd.Series) -> pd.Series:
        def one(text):
            out: list[str] = []
            for p in T.paragraphs(text or ""):
                body = T.squeeze(p.text)
                pieces = [body] if len(body) <= size else [T.squeeze(s.text) for s in T.sentences(body)]
                for piece in pieces:
                    if out and len(out[-1]) + 1 + len(piece) <= size:
                        out[-1] = f"{out[-1]} {piece}"
                    else:
                        out.append(piece)
            return out[:most]

        return column.map(one)

    return texts.select("text_id", F.posexplode(chunk("text")).alias("place", "passage"))


def target_coverage(texts: DataFrame, label: str, terms: list[str], names: list[str]) -> DataFrame:
    """Per text: mentions of a target, those that count, whether the title and opening have it, and its nearness to a name."""
    spans = T.occurrence_spans(F.col("text"), [label, *terms])
    named = T.occurrence_spans(F.col("text"), names)
    near = F.exists("_t", lambda t: F.exists("_n", lambda n: F.abs(t["start"] - n["start"]) <= 200))
    found = texts.select("text_id", "title", spans.alias("_t"), named.alias("_n"))
    return found.select(
        "text_id", F.size("_t").alias("mentions"), F.least(F.size("_t"), F.lit(3)).alias("counted"), near.alias("beside_name"), T.contains_phrase_column(F.col("title"), F.lit(label)).alias("in_title"),
        F.exists("_t", lambda t: t["start"] < 400).alias("in_opening"),
    )


def displaced_documents(evidence: DataFrame, documents: DataFrame, association: str) -> DataFrame:
    """Accepted documents that do not carry the association."""
    carrying = evidence.where(F.col("association_id") == association).select("document_id").distinct()
    return documents.where(F.col("verdict") == "accept").join(carrying, "document_id", "left_anti").select("entity_id", "document_id")


