"""Calls, costs, caches, queues and schedules read from their logs: what a service would hold in mutable state."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from attestor.functions import exprs as X


def fresh_responses(cache: DataFrame, now: Column, ttl_days: float) -> DataFrame:
    """The latest response of each key that is not older than the time to live.  cache: key, stored_at and others."""
    kept = cache.where((F.col("stored_at") > X.days_before(now, ttl_days)) & (F.col("stored_at") <= now))
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("stored_at"), *[c for c in cache.columns if c not in ("key", "stored_at")]))
    return kept.withColumn("_place", place).where("_place = 1").drop("_place")


def spend(calls: DataFrame) -> DataFrame:
    """What each entity's calls cost; an entity without a priced call has spent nothing."""
    return calls.groupBy("entity_id").agg(X.half_up(F.coalesce(F.sum(F.col("cost")), F.lit(0.0)), 4).alias("spent"))


def over_ceiling(calls: DataFrame, ceilings: DataFrame) -> DataFrame:
    """Calls (entity_id, called_at, call_id, cost) that a ceiling (entity_id, ceiling) allows: those before which less than
    the ceiling was spent.  A refused call costs nothing, but spending never falls, so the first refusal ends it."""
    before = F.coalesce(F.sum(F.col("cost")).over(Window.partitionBy("entity_id").orderBy("called_at", "call_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    joined = calls.withColumn("_before", before).join(ceilings, "entity_id", "left")
    return joined.select("entity_id", "call_id", (F.col("ceiling").isNull() | (X.half_up(F.col("_before"), 6) < F.col("ceiling"))).alias("allowed"))


def breaker_states(calls: DataFrame, failures: int = 5) -> DataFrame:
    """calls (provider, called_at, call_id, ok): whether the provider was available before each call: not after so many
    failures in a row; one success clears them."""
    order = Window.partitionBy("provider").orderBy("called_at", "call_id")
    runs = calls.withColumn("_run", F.sum(F.col("ok").cast("int")).over(order))
    streak = F.when(F.col("ok"), 0).otherwise(F.row_number().over(Window.partitionBy("provider", "_run").orderBy("called_at", "call_id")) - F.when(F.col("_run") > 0, 1).otherwise(0))
    counted = runs.withColumn("_streak", streak)
    before = F.coalesce(F.lag("_streak").over(order), F.lit(0))
    return counted.withColumn("available", before < failures).select("provider", "call_id", "available")


def job_states(events: DataFrame, now: Column, orphan_minutes: float = 30) -> DataFrame:
    """events (job_id, at, event) of a queue, event one of queued, running, progress, done, failed, cancelled: the last state
    of each job; one that runs without a sign of life for too long is an orphan and to be queued again."""
    last = events.groupBy("job_id").agg(F.max("at").alias("seen_at"), F.max_by("event", F.struct("at", F.col("event"))).alias("last"), F.count_if(F.col("event") == "progress").alias("steps"))
    silent = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("seen_at").cast("timestamp"))) / 60_000_000.0 > orphan_minutes
    alive = F.col("last").isin("running", "progress")
    return last.select("job_id", F.when(alive & silent, "orphaned").when(alive, "running").otherwise(F.col("last")).alias("state"), "steps")


def due(entities: DataFrame, runs: DataFrame, now: Column, every_days: float = 7) -> DataFrame:
    """Entities whose last run is older than the interval, or that never ran."""
    last = runs.groupBy("entity_id").agg(F.max("ran_at").alias("ran_at"))
    return entities.join(last, "entity_id", "left").where(F.col("ran_at").isNull() | (F.col("ran_at") <= X.days_before(now, every_days))).select("entity_id")


def request_pages(totals: DataFrame, page: int = 1000, depth: int = 10_000, ceiling: int | None = None) -> DataFrame:
    """totals (query, total): one request (query, offset, limit) per page of at most 1,000 results until the results end, the
    provider's depth or the ceiling is reached, and why the requests stop there."""
    page = max(1, min(page, 1000))
    most = min(depth, ceiling or depth)
    wanted = F.least(F.col("total"), F.lit(most))
    reason = F.when(F.col("total") <= most, "exhausted").when(F.lit(ceiling is not None and ceiling <= depth), "max_documents").otherwise("provider_depth_limit")
    offsets = F.when(wanted > 0, F.sequence(F.lit(0).cast("long"), wanted - 1, F.lit(page).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    rows = totals.select("query", reason.alias("stop_reason"), wanted.alias("_wanted"), F.explode(offsets).alias("offset"))
    return rows.select("query", "offset", F.least(F.lit(page).cast("long"), F.col("_wanted") - F.col("offset")).alias("limit"), "stop_reason")


def search_requests(entities: DataFrame, associations: DataFrame | None = None) -> DataFrame:
    """(entity_id, query_kind, query): the entity's name, quoted, and one query for each of its associations' labels."""
    named = entities.select("entity_id", F.lit("entity").alias("query_kind"), F.concat(F.lit('"'), "name", F.lit('"')).alias("query"))
    if associations is None:
        return named
    asked = associations.join(entities, "entity_id").select("entity_id", F.lit("association").alias("query_kind"), F.concat(F.lit('"'), F.col("name"), F.lit('" '), F.col("label")).alias("query"))
    return named.unionByName(asked)


def map_pool(df: DataFrame, worker: Callable[[pd.DataFrame], pd.DataFrame], schema: str, size: int) -> DataFrame:
    """worker over batches of rows, ``size`` of them at a time: as many tasks as that."""
    return df.repartition(size).mapInPandas(lambda batches: (worker(b) for b in batches), schema)


def listing(df: DataFrame, limit: int | None = None, most: int = 200, order: Sequence[Column] = (), **equal) -> DataFrame:
    """Rows by filters that are given (None: any), ordered, and the first ``limit`` of them, between 1 and ``most``."""
    for column, value in equal.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    ordered = df.orderBy(*order) if order else df
    return ordered if limit is None else ordered.limit(max(1, min(int(limit), most)))


def run_statement(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame], **params) -> DataFrame:
    """A statement over the given tables, its parameters bound by name (``:name``); nothing is written."""
    return spark.sql(sql, args=params, **tables) if not params else _with_views(spark, sql, tables, params)


def _with_views(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame], params: Mapping) -> DataFrame:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=dict(params))


def skip_steps(steps: Sequence[tuple[str, Callable]], done: Sequence[str], state: dict) -> tuple[dict, list[str]]:
    """Runs the steps (name, function of the state) that are not done, in order; the new state and what ran."""
    ran = []
    for name, step in steps:
        if name not in done:
            state = {**state, **(step(state) or {})}
            ran.append(name)
    return state, ran
