"""Which documents are about the entity: name hits, markers beside them, verdicts, search priors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from attestor.functions import exprs as X
from attestor.functions import text as T
from attestor.model import DEFAULT, MARKER_WEIGHTS, Model

# What a name alone is worth by its origin, and what a search rank adds.
NAME_BASE = {"canonical": 0.05, "user": 0.05, "generated": 0.04, "partial": 0.02}
SEARCH_PRIOR = ((3, 0.6), (10, 0.5), (30, 0.35), (100, 0.2))
SINGLE_MARKER_CAP = 0.97


@dataclass(frozen=True)
class Marker:
    kind: str
    value: str
    weight: float | None = None
    polarity: int = 1

    @property
    def strength(self) -> float:
        return MARKER_WEIGHTS.get(self.kind, MARKER_WEIGHTS["other"]) if self.weight is None else self.weight


@dataclass(frozen=True)
class Profile:
    name: str
    aliases: tuple[str, ...] = ()
    markers: tuple[Marker, ...] = ()
    kind: str = "person"

    def names(self) -> list[str]:
        return list(dict.fromkeys([self.name, *self.aliases, *T.name_variants(self.name, self.kind)]))

    def ordered_markers(self) -> list[Marker]:
        """Markers by kind and value: the order matters once one of them is negative."""
        return sorted(self.markers, key=lambda m: (m.kind, m.value))


def missing_aliases(known: Column, queried: Column) -> Column:
    """Aliases that no query used, whatever their case."""
    lower = lambda a: F.transform(a, lambda x: F.lower(x))
    return F.filter(known, lambda x: ~F.array_contains(lower(queried), F.lower(x)))


def search_queries(profile: Profile) -> list[str]:
    return [f'"{n}"' for n in profile.names()]


def marker_hits(text: Column, profile: Profile) -> Column:
    """array<struct<marker, factor>>: each marker found, at its closest to any name; null without a name in the text."""
    names, markers = profile.names(), [m for m in profile.ordered_markers()]
    factors = DEFAULT["identity_boundary"]

    @F.pandas_udf("array<struct<marker:int,factor:double>>")
    def find(texts: pd.Series) -> pd.Series:
        def one(t: str | None):
            named = T.occurrences(t or "", names)
            if not named:
                return None
            layout = T.Layout(t)
            out = []
            for k, m in enumerate(markers):
                hits = [] if m.kind == "url" else T.occurrences(t, [m.value])
                if hits:
                    out.append({"marker": k, "factor": max(factors[layout.boundary(n.start, h.start)] for h in hits for n in named)})
            return out

        return texts.map(one)

    return find(text)


def score_documents(docs: DataFrame, profile: Profile, model: Model = DEFAULT) -> DataFrame:
    """docs (document_id, text, root_domain) with confidence and verdict.

    A page on one of the entity's own addresses is accepted.  Otherwise a name is needed; every marker near it shrinks what
    doubt remains, and a negative one restores it, in marker order.
    """
    own = [m.value.lower().removeprefix("www.") for m in profile.markers if m.kind == "url"]
    markers = profile.ordered_markers()
    weights = F.array(*(F.lit(float(m.strength)) for m in markers)) if markers else F.array().cast("array<double>")
    signs = F.array(*(F.lit(m.polarity) for m in markers)) if markers else F.array().cast("array<int>")
    found = docs.withColumn("_hits", marker_hits(F.col("text"), profile))
    strengths = F.transform("_hits", lambda h: F.struct(X.clamp(F.get(weights, h["marker"]) * h["factor"], 0, SINGLE_MARKER_CAP).alias("strength"), F.get(signs, h["marker"]).alias("polarity")))
    by_markers = F.when(F.col("_hits").isNull(), 0.0).otherwise(X.noisy_or(F.lit(NAME_BASE["user"]), strengths))
    known = F.col("root_domain").isin(*own) if own and "root_domain" in docs.columns else F.lit(False)
    confidence = F.when(known, 0.98).otherwise(by_markers)
    method = F.when(known, "known_url").when(F.col("_hits").isNull(), "no_name").otherwise("markers")
    return found.withColumn("confidence", confidence).withColumn("verdict", X.verdict(F.col("confidence"), model)).withColumn("method", method).drop("_hits")


def with_search_prior(scored: DataFrame, ranks: DataFrame, model: Model = DEFAULT) -> DataFrame:
    """Documents that rank for the name gain by their rank (document_id, rank), unless known or without the name."""
    gain = F.lit(0.0)
    for most, strength in reversed(SEARCH_PRIOR):
        gain = F.when(F.col("rank") <= most, strength).otherwise(gain)
    joined = scored.join(ranks.groupBy("document_id").agg(F.min("rank").alias("rank")), "document_id", "left")
    applies = F.col("rank").isNotNull() & (F.col("method") == "markers")
    confidence = F.when(applies, X.half_up(1 - (1 - F.col("confidence")) * (1 - gain), 3)).otherwise(F.col("confidence"))
    return joined.withColumn("confidence", confidence).withColumn("verdict", X.verdict(F.col("confidence"), model))


def with_manual_verdicts(scored: DataFrame, reviews: DataFrame) -> DataFrame:
    """A person's verdict (document_id, manual_verdict) stands above the computed one."""
    return scored.join(reviews, "document_id", "left").withColumn("verdict", F.coalesce("manual_verdict", "verdict"))


def summary(matches: DataFrame) -> DataFrame:
    """Per entity: counts by verdict, acceptance rate, mean confidence of the accepted."""
    accepted = F.col("verdict") == "accept"
    sums = matches.groupBy("entity_id").agg(
        F.count("*").alias("total"), F.count_if(accepted).alias("accepted"), F.count_if(F.col("verdict") == "review").alias("review"), F.count_if(F.col("verdict") == "reject").alias("rejected"),
        F.sum(F.when(accepted, X.scaled(F.col("entity_confidence")))).alias("c"),
    )
    return sums.select("entity_id", "total", "accepted", "review", "rejected", X.half_up(X.safe_div(F.col("accepted"), F.col("total")), 4).alias("accept_rate"), X.half_up(X.unscaled(F.col("c")) / F.col("accepted"), 3).alias("mean_accepted_confidence"))


def review_queue(matches: DataFrame, limit: int = 100) -> DataFrame:
    """What a person should look at next."""
    waiting = F.col("manual_verdict").isNull() if "manual_verdict" in matches.columns else F.lit(True)
    return matches.where((F.col("verdict") == "review") & waiting).orderBy(F.desc("entity_confidence"), "document_id").limit(limit)


def alias_rows(profile: Profile) -> Sequence[tuple[str, str]]:
    """(alias, origin) rows of the profile."""
    return [(profile.name, "canonical"), *((a, "user") for a in profile.aliases), *((v, "generated") for v in T.name_variants(profile.name, profile.kind))]
