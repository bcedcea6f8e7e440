"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (one value of every dimension).  The cells' tokens are raked until their sums over each
dimension's values match the target shares; a cell's weight is raked tokens over tokens.  Documents are sampled with
calibrated probabilities: starting from the weights, the fitting goes on with every probability kept at 1 or less, so that
the sample's expected marginals are the targets too.  It keeps the largest share of the tokens, found by bisection, at
which that is possible (``keep_tokens`` at most).  A document's draw is a hash of its id, so the same documents are drawn
again on any cluster.

Cells are a catalogue: one row per combination of categories that occurs, counted by Spark.  They are fitted on the driver,
and a table with more than ``most_cells`` of them is refused with an error: its dimensions are no categories.

Defined results: a null in a dimension is a value of its own; null and empty texts have no tokens and are sampled like their
cell; a cell without tokens has weight 1; values without a target keep their own share; targets that the cells cannot meet
are approached, and ``residual`` tells by how much the expected sample misses them; an empty table gives an empty result.
Copies of a row are drawn alike, and rows of one id (or none) by one draw.  A very long text is counted whole.  Columns of
docs keep their values whatever their names: those added get names of their own (``added``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from attestor.llm.frames import columns, drop, keep, private

#: What a null counts as in a dimension.
NONE = "\x00null"
_WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    dimensions: tuple[str, ...] = ("source", "lang", "topic")
    #: Without given targets a dimension's target shares are its own shares to this power, made to sum to 1.
    flatten: float = 0.7
    #: Most expected tokens, as a share; None: as many as the targets allow.
    keep_tokens: float | None = None
    seed: str = "mix"
    most_cells: int = 1_000_000
    tolerance: float = 1e-9
    rounds: int = 500
    #: How far the expected sample may be off a target, relatively.
    calibration: float = 1e-6


def topic_of(text: Column) -> Column:
    """A coarse topic by form: tables, sectioned texts, short notes, prose."""
    text = F.coalesce(text, F.lit(""))
    return (
        F.when(F.contains(text, F.lit("|")), "table").when(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) >= 10, "sectioned")
        .when(F.length(text) < 1000, "note").otherwise("prose")
    )


def tokens_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_WORD)).cast("long")


def rake(tokens: np.ndarray, codes: Sequence[np.ndarray], targets: Sequence[np.ndarray], rounds: int, tolerance: float) -> np.ndarray:
    """Raked tokens of each cell; codes[d]: the cell's value of dimension d; targets[d]: tokens wanted per value."""
    fitted = tokens.astype(float)
    for _ in range(rounds):
        worst = 0.0
        for code, target in zip(codes, targets):
            have = np.bincount(code, fitted, len(target))
            factor = np.divide(target, have, out=np.ones_like(target), where=have > 0)
            worst = max(worst, float(np.abs(factor[have > 0] - 1).max(initial=0)))
            fitted *= factor[code]
        if worst <= tolerance:
            break
    return fitted


def missed(fitted: np.ndarray, codes: Sequence[np.ndarray], targets: Sequence[np.ndarray]) -> float:
    """The largest relative miss of a target."""
    worst = 0.0
    for code, target in zip(codes, targets):
        have = np.bincount(code, fitted, len(target))
        some = target > 0
        worst = max(worst, float(np.abs(have[some] / target[some] - 1).max(initial=0)))
    return worst


def bounded(tokens: np.ndarray, start: np.ndarray, codes: Sequence[np.ndarray], targets: Sequence[np.ndarray], mix: Mix) -> tuple[np.ndarray, float]:
    """Probabilities min(1, start times a factor per value) whose tokens meet the targets, and by how much they miss."""
    free = start.astype(float)
    miss = np.inf
    for k in range(mix.rounds):
        for code, target in zip(codes, targets):
            have = np.bincount(code, tokens * np.minimum(1.0, free), len(target))
            free *= np.divide(target, have, out=np.ones_like(target), where=have > 0)[code]
            np.minimum(free, 1e9, out=free)
        if k % 5 == 4:
            miss = missed(tokens * np.minimum(1.0, free), codes, targets)
            if miss <= mix.calibration / 2:
                break
    return np.minimum(1.0, free), miss


def calibrated(tokens: np.ndarray, weights: np.ndarray, codes: Sequence[np.ndarray], targets: Sequence[np.ndarray], mix: Mix) -> tuple[np.ndarray, float]:
    """Each cell's probability, and the largest relative miss of a target by the expected sample."""
    total = tokens.sum()
    if not total:
        return np.ones(len(tokens)), 0.0
    at_most = 1.0 if mix.keep_tokens is None else mix.keep_tokens
    most = max(float(weights[tokens > 0].max()), 1.0)
    # weights over the greatest weight are always calibrated; no value can give more than all it has
    least = min(at_most, 1.0 / most)
    best = np.minimum(1.0, weights * least)
    miss = missed(tokens * best / least, codes, targets)
    high = min([at_most, *(float((np.bincount(c, tokens, len(t))[t > 0] / t[t > 0]).min()) for c, t in zip(codes, targets))])
    if miss > mix.calibration:  # the targets themselves are out of reach
        return best, miss
    share = high
    for _ in range(14):
        if share <= least:
            break
        found, miss_here = bounded(tokens, weights * share, codes, [t * share for t in targets], mix)
        if miss_here <= mix.calibration:
            best, miss, least = found, miss_here, share
        else:
            high = share
        share = (least + high) / 2
    return np.where(tokens > 0, best, least), miss


def cell_weights(cells: DataFrame, mix: Mix, targets: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """(dimensions ..., weight, probability, residual) of the cells (dimensions ..., tokens)."""
    spark, dims, targets = cells.sparkSession, list(mix.dimensions), targets or {}
    found = cells.count()
    if found > mix.most_cells:
        raise ValueError(f"{found} combinations of {', '.join(dims)}: more than {mix.most_cells}; group the values of a dimension")
    frame = cells.toPandas()
    tokens = frame["tokens"].to_numpy(dtype=np.int64)
    codes, wanted = [], []
    for d in dims:
        values, code = np.unique(frame[d].to_numpy(dtype=object).astype(str), return_inverse=True)
        share = np.bincount(code, tokens, len(values)) / max(tokens.sum(), 1)
        aim = np.array([targets[d].get(v, s) for v, s in zip(values, share)]) if d in targets else share**mix.flatten
        aim = np.where(share > 0, aim, 0.0)
        codes.append(code)
        wanted.append(aim / max(aim.sum(), 1e-300) * tokens.sum())
    fitted = rake(tokens, codes, wanted, mix.rounds, mix.tolerance)
    weight = np.divide(fitted, tokens, out=np.ones(len(tokens)), where=tokens > 0)
    frame["weight"] = weight
    frame["probability"], frame["residual"] = calibrated(tokens, weight, codes, wanted, mix)
    schema = ", ".join([*(f"`{d}` string" for d in dims), "weight double, probability double, residual double"])
    return spark.createDataFrame(frame[[*dims, "weight", "probability", "residual"]].values.tolist(), schema)


def added(docs: DataFrame) -> dict[str, str]:
    """The names of the columns that with_probabilities adds to docs."""
    return private(docs, "tokens", "topic", "weight", "probability", "residual", "sampled")


def with_probabilities(docs: DataFrame, mix: Mix = Mix(), targets: Mapping[str, Mapping[str, float]] | None = None, id_column: str = "doc_id", text_column: str = "text", topic: Column | None = None) -> DataFrame:
    """docs and the columns added(docs): a document's tokens and topic, its cell's weight, probability and residual, and
    whether it is sampled.  Dimensions are columns of docs, or topic."""
    names = added(docs)
    cell = list(private(docs, *(f"cell_{i}" for i in range(len(mix.dimensions)))).values())
    topic = topic_of(docs[text_column]) if topic is None else topic
    marked = docs.withColumn(names["topic"], topic).withColumn(names["tokens"], tokens_of(docs[text_column]))
    value = [F.coalesce((F.col(names["topic"]) if d == "topic" else docs[d]).cast("string"), F.lit(NONE)) for d in mix.dimensions]
    cells = keep(marked.groupBy(*(v.alias(d) for v, d in zip(value, mix.dimensions))).agg(F.sum(names["tokens"]).alias("tokens")), "cells")
    weights = cell_weights(cells, mix, targets).toDF(*cell, names["weight"], names["probability"], names["residual"])
    drop(cells)
    joined = marked.join(weights, [v == weights[c] for v, c in zip(value, cell)], "left").drop(*cell)
    digest = F.md5(F.concat(F.coalesce(docs[id_column].cast("string"), F.lit("null")), F.lit("|" + mix.seed)))
    draw = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    return joined.withColumn(names["sampled"], draw < F.col(names["probability"]))


def sample(docs: DataFrame, mix: Mix = Mix(), targets: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """The sampled rows of docs, with its columns."""
    return with_probabilities(docs, mix, targets).where(F.col(added(docs)["sampled"])).select(*columns(docs))
