"""Where documents come from: readers that give candidate rows, their normal form, and sinks.

A source is a function (spark, **options) -> DataFrame registered by name.  Reading the network is not the engine's task;
sources read files that a fetcher left.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as Ty

from attestor.functions import exprs as X
from attestor.functions.html import host_of
from attestor.operators.corrections import merge_sources

_FIELDS = {
    "url": "string", "title": "string", "main_title": "string", "snippet": "string", "body": "string", "author": "string", "language": "string", "country": "string", "content_type": "string",
    "domain_rank": "double", "url_rank": "double", "prominence": "double", "spam_score": "double", "sentiment_positive": "double", "sentiment_negative": "double", "sentiment_neutral": "double",
    "published_at": "timestamp", "group_date": "timestamp", "fetched_at": "timestamp", "provider": "string", "provider_ref": "string", "fetch_status": "string",
}
SCHEMA = ", ".join(f"{k} {v}" for k, v in _FIELDS.items())
REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def source(name: str):
    def add(fn):
        REGISTRY[name] = fn
        return fn

    return add


def normalise(candidates: DataFrame) -> DataFrame:
    """All fields, missing ones null; canonical address, host and root domain derived; rows without an address dropped."""
    have = set(candidates.columns)
    rows = candidates.select(*(F.col(c).cast(t).alias(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in _FIELDS.items()))
    kept = rows.where(F.col("url").isNotNull() & (F.trim("url") != ""))
    return kept.withColumn("canonical_url", X.canonical_url(F.col("url"))).withColumn("root_domain", X.root_domain(host_of(F.col("url")))).withColumn("domain_rank", X.clamp(F.col("domain_rank"), 0, 100))


@source("parquet")
def parquet(spark: SparkSession, path: str) -> DataFrame:
    return normalise(spark.read.parquet(path))


@source("citations")
def citations(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of a citation index; ranks of 0 to 1000 become 0 to 100."""
    schema = "url string, title string, main_title string, snippet string, language string, domain_rank double, url_rank double, date_published string, group_date string, content_info struct<sentiment_connotations:struct<positive:double,negative:double,neutral:double>>"
    raw = spark.read.schema(schema).json(path)
    ten = lambda c: X.clamp(F.col(c) / 10, 0, 100)
    mood = F.col("content_info.sentiment_connotations")
    return normalise(raw.select(
        "url", "title", "main_title", "snippet", "language", ten("domain_rank").alias("domain_rank"), ten("url_rank").alias("url_rank"), F.try_to_timestamp("date_published").alias("published_at"),
        F.try_to_timestamp("group_date").alias("group_date"), mood["positive"].alias("sentiment_positive"), mood["negative"].alias("sentiment_negative"), mood["neutral"].alias("sentiment_neutral"), F.lit("citations").alias("provider"),
    ))


@source("url_index")
def url_index(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of a crawl index: pages with status 200, dated by their capture."""
    raw = spark.read.schema("url string, status string, timestamp string, mime string").json(path)
    return normalise(raw.where("status = '200'").select("url", F.col("mime").alias("content_type"), F.to_timestamp(F.substring("timestamp", 1, 8), "yyyyMMdd").alias("group_date"), F.lit("url_index").alias("provider")))


@source("manual")
def manual(spark: SparkSession, rows: Sequence[dict] | Iterable[str]) -> DataFrame:
    """Rows or addresses given by hand."""
    listed = [r if isinstance(r, dict) else {"url": r} for r in rows]
    return normalise(spark.createDataFrame([tuple(r.get(k) for k in _FIELDS) for r in listed], SCHEMA).withColumn("provider", F.lit("manual")))


@source("search_page")
def search_page(spark: SparkSession, results: DataFrame) -> DataFrame:
    """Results of a captured search page as candidates; the rank stays in provider_ref."""
    return normalise(results.select("url", "title", F.col("description").alias("snippet"), F.concat(F.lit("rank:"), F.col("rank").cast("string")).alias("provider_ref"), F.lit("search_page").alias("provider")))


def search_across(sources: Sequence[DataFrame], limit: int | None = None) -> DataFrame:
    """Candidates of several sources, one row per canonical address, owned by the first source that has it."""
    merged = merge_sources(sources, "canonical_url")
    return merged if limit is None else merged.orderBy("owner", "canonical_url").limit(limit)


def rank_from_ref(ref: Column) -> Column:
    return F.regexp_extract(ref, r"^rank:(\d+)$", 1).try_cast("int")


def phrase_trends(documents: DataFrame, granularity: str, now: Column) -> DataFrame:
    """Documents and domains per period; the period that now lies in is partial."""
    period = F.date_trunc(granularity, F.col("effective_date"))
    return documents.where("effective_date IS NOT NULL").groupBy(period.alias("period")).agg(F.count("*").alias("documents"), F.countDistinct("root_domain").alias("domains")).withColumn("partial", F.col("period") >= F.date_trunc(granularity, now))


def content_summary(documents: DataFrame, facet: str, top: int = 10) -> DataFrame:
    """The largest groups of a facet and their shares."""
    counts = documents.groupBy(facet).agg(F.count("*").alias("documents"))
    total = documents.agg(F.count("*").alias("total")).withColumn("_one", F.lit(1))  # one row
    best = counts.orderBy(F.desc("documents"), facet).limit(top).withColumn("_one", F.lit(1))
    return best.join(F.broadcast(total), "_one").select(facet, "documents", X.half_up(F.col("documents") / F.col("total"), 4).alias("share"))


@F.pandas_udf(Ty.BooleanType())
def is_private_address(hosts: pd.Series) -> pd.Series:
    """Whether an address must not be fetched: not public, or not an address at all."""
    def one(host):
        try:
            return not ipaddress.ip_address(str(host).strip("[]")).is_global
        except ValueError:
            return True

    return hosts.map(one)


def is_public_url(url: Column) -> Column:
    """http or https, without credentials, on a name that is not local."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.coalesce(
        F.try_parse_url(url, F.lit("PROTOCOL")).isin("http", "https") & F.try_parse_url(url, F.lit("USERINFO")).isNull() & host.isNotNull() & ~host.rlike(r"(^|\.)(localhost|local|internal)$"), F.lit(False)
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("quote", '"').option("escape", '"').mode("overwrite").csv(path)


def to_json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def parsed_or(text: Column, schema: str, fallback: Column) -> Column:
    """JSON by schema, or the fallback where it does not parse."""
    return F.coalesce(F.from_json(text, schema), fallback)


def robots_allow(path: str, rules: Iterable[tuple[str, str]]) -> bool:
    """Whether robots rules (allow or disallow, pattern) let a path be read: the longest match decides, allow wins ties."""
    import regex

    matched = [(len(p), kind == "allow") for kind, p in rules if p and regex.match(regex.escape(p).replace(r"\*", ".*").replace(r"\$", "$"), path)]
    return max(matched, default=(0, True))[1]


def store_body(body: Column, limit: int = 60_000) -> Column:
    return F.substring(body, 1, limit)
