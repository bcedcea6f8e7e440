"""Duplicate clusters: equal hashes or addresses, and near copies among documents that share a fingerprint band."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from attestor.durable import keep
from attestor.functions import hashing as H
from attestor.functions.text import folded_column
from attestor.model import DEFAULT, Model
from attestor.operators.graph import components


def fingerprints(docs: DataFrame, id_column: str = "document_id", text_column: str = "text") -> DataFrame:
    """docs with content_hash, simhash and minhash of the text; texts are dealt out evenly and cross to Python once."""
    text = F.col(text_column)
    signed = docs.repartition(F.col(id_column)).withColumn("_signed", H.both_signatures(text, folded_column(text)))
    return signed.select(*docs.columns, H.content_hash(text).alias("content_hash"), F.col("_signed.simhash").alias("simhash"), F.col("_signed.minhash").alias("minhash"))


def variant_fingerprints(docs: DataFrame, id_column: str, columns: tuple[str, str]) -> DataFrame:
    """(id, place, simhash, minhash), as fingerprints() has them, of the texts in two columns, which have place 0 and 1.

    Both are signed in one pass: runs of words that both begin with are hashed once.
    """
    dealt = docs.select(F.col(id_column), *(F.col(c) for c in columns)).repartition(F.col(id_column))
    rows = dealt.select(id_column, *columns, *(folded_column(F.col(c)) for c in columns))
    key = dealt.schema[id_column]

    def sign(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                raw_a, raw_b, a, b = (part.column(k).to_pylist() for k in range(1, 5))
                signed = [x for row in zip(raw_a, raw_b, a, b) for x in H.signatures(row[:2], row[2:])]
                ids = part.column(0).take(pa.array([i for i in range(part.num_rows) for _ in range(2)], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([0, 1] * part.num_rows, pa.int32()), pa.array([s for s, _ in signed], pa.int64()), pa.array([m for _, m in signed], pa.list_(pa.int64()))],
                    names=[key.name, "place", "simhash", "minhash"],
                )

    return rows.mapInArrow(sign, StructType([key, *StructType.fromDDL("place int, simhash long, minhash array<long>").fields]))


def exact_links(docs: DataFrame) -> DataFrame:
    """(a, b) from each document to the least one with its address or its content: a star per group, not all pairs."""
    links = []
    for key in ("canonical_url", "content_hash"):
        if key in docs.columns:
            known = docs.where(F.col(key).isNotNull() & (F.col(key) != ""))
            hub = known.groupBy(key).agg(F.min("document_id").alias("a"))
            links.append(known.join(hub, key).select("a", F.col("document_id").alias("b")).where("a <> b"))
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out.distinct()


def banded_pairs(docs: DataFrame, largest: int = 400, within: int = 64) -> DataFrame:
    """Pairs that share one of four 16-bit bands and differ in at most ``within`` bits, once each, with their simhashes.

    Buckets over ``largest`` are not paired: the bound belongs to the definition of a near copy here, as the banding does.
    Documents with equal content are represented by one of them.  Bits are compared where a pair is met, so those that differ
    more are never moved.
    """
    one = docs.where(F.col("simhash").isNotNull()).groupBy("content_hash").agg(F.min("document_id").alias("document_id"))
    slim = docs.join(one, ["content_hash", "document_id"], "left_semi").select("document_id", "simhash")
    rows = slim.withColumn("band", F.explode(H.band_keys(F.col("simhash"))))
    small = rows.groupBy("band").count().where(F.col("count").between(2, largest)).select("band")
    rows = rows.join(small, "band", "left_semi")
    a, b = rows.alias("a"), rows.alias("b")
    near = H.hamming(F.col("a.simhash"), F.col("b.simhash")) <= within
    met = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.document_id") < F.col("b.document_id")) & near)
    return met.select(*(F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("document_id", "simhash"))).distinct()


def near_pairs(docs: DataFrame, model: Model = DEFAULT) -> DataFrame:
    """The banded_pairs() that near_links() can link, with minhash and title of both."""
    d = model["duplicates"]
    pairs = banded_pairs(docs, within=max(d["exact"], d["near"]))
    title = F.col("title") if "title" in docs.columns else F.lit(None).cast("string")
    for s in "ab":
        pairs = pairs.join(docs.select(F.col("document_id").alias(f"document_id_{s}"), F.col("minhash").alias(f"minhash_{s}"), title.alias(f"title_{s}")), f"document_id_{s}")
    return pairs


def near_links(pairs: DataFrame, model: Model = DEFAULT) -> DataFrame:
    """(a, b, kind): exact within few bits, near within more bits if signatures or titles agree."""
    d = model["duplicates"]
    bits = H.hamming(F.col("simhash_a"), F.col("simhash_b"))
    agree = (H.minhash_similarity(F.col("minhash_a"), F.col("minhash_b")) >= d["minhash"]) | (H.title_similarity(F.col("title_a"), F.col("title_b")) >= d["title"])
    kind = F.when(bits <= d["exact"], "exact").when((bits <= d["near"]) & agree, "near")
    return pairs.select(F.col("document_id_a").alias("a"), F.col("document_id_b").alias("b"), kind.alias("kind")).where("kind IS NOT NULL")


def cluster_documents(docs: DataFrame, model: Model = DEFAULT) -> DataFrame:
    """(document_id, cluster_id, kind, is_primary) of the documents in clusters.  docs: fingerprints() with document_id,
    root_domain, domain_rank and effective_date as far as known.

    A cluster is exact if any of its links is.  Its primary is a dated document, the earliest, then the best ranked.
    """
    docs = keep(docs.drop("text"), "fingerprints")  # read several times below
    links = exact_links(docs).withColumn("kind", F.lit("exact")).unionByName(near_links(near_pairs(docs, model), model))
    roots = components(links.select("a", "b")).toDF("document_id", "cluster_id")
    kinds = links.join(roots, links["a"] == roots["document_id"]).groupBy("cluster_id").agg(F.min("kind").alias("kind"))  # exact < near
    have = lambda c, t: F.col(c) if c in docs.columns else F.lit(None).cast(t)
    info = docs.select("document_id", have("effective_date", "timestamp").alias("date"), have("domain_rank", "double").alias("rank"))
    order = Window.partitionBy("cluster_id").orderBy(F.col("date").asc_nulls_last(), F.coalesce("rank", F.lit(0.0)).desc(), "document_id")
    return roots.join(kinds, "cluster_id").join(info, "document_id").withColumn("is_primary", F.row_number().over(order) == 1).select("document_id", "cluster_id", "kind", "is_primary")


def cluster_members(clusters: DataFrame, cluster_id) -> DataFrame:
    return clusters.where(F.col("cluster_id") == cluster_id).orderBy(F.desc("is_primary"), "document_id")
