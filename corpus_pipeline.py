"""From raw documents to shards: quality rules, near-duplicate removal, decontamination, mixing, sharding.

Every stage takes what its predecessor kept, as written to and read back from Parquet, and all but the last return the
columns of documents.  Mixing samples documents, so it drops some by design; the other filtering stages drop only what
they find at fault.

Defined results: null, empty and very long texts are rows like any other (rules 6 reject those without 50 words); rows with
one id and different texts, or no id, are told apart by their text, equal rows are one after near_dedup; ties fall to the
least id; extra columns pass through all stages but the last whatever their names; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attestor.durable import drop, keep_beyond, scratch
from attestor.llm import kdtree, raking, repetition, setsketch, winnowing
from attestor.llm.frames import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repetition.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return setsketch.drop_copies(docs, setsketch.Sketch(words=5, threshold=80))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return winnowing.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return raking.sample(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kdtree.assign(docs, kdtree.Tree(shards=16)).select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: Suffix arrays, sketches and raking have no SQL form; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch():  # what a stage writes for itself goes with it
            before, docs = docs, keep_beyond(stage(spark, docs, sf_dir), f"stage-{name}")
        drop(before)  # the next stage reads only its predecessor's rows
    return STAGES[-1][1](spark, docs, sf_dir)
