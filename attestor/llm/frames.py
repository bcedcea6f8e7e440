"""Shared plumbing of the corpus operators: tables, and texts in chunks of bounded size."""

from __future__ import annotations

from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from attestor.durable import drop, fresh_path, keep

__all__ = ["columns", "drop", "fresh_path", "keep", "map_chunks", "private", "rows_per_batch", "same_columns", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def private(df: DataFrame, *names: str) -> dict[str, str]:
    """For each name one led by as many underscores, at least one, as no column of df has it."""
    taken = {c.lower() for c in df.columns}
    found = {}
    for name in names:
        own = f"_{name}"
        while own.lower() in taken:
            own = f"_{own}"
        found[name] = own
        taken.add(own.lower())
    return found


def columns(df: DataFrame) -> list[Column]:
    """The columns of df by name, whatever signs the names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def map_chunks(df: DataFrame, fn, schema, column: str = "text", limit: int = 6 << 20) -> DataFrame:
    """mapInArrow with fn applied to slices of bounded text size; fn returns a RecordBatch or None.

    Spark bounds the batch that arrives by spark.sql.execution.arrow.maxBytesPerBatch (64 MB unless set otherwise).  fn's
    columns come in the order of df's; they are named c0, c1 and so on, whatever signs df's names hold.
    """
    text = f"c{df.columns.index(column)}"

    def run(batches):
        from attestor.llm.text import chunks

        for batch in batches:
            for part in chunks(batch, text, limit):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out

    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(run, schema)


def same_columns(df: DataFrame, fn, column: str = "text", more: str = "") -> DataFrame:
    """map_chunks of a fn that returns df's columns, and ``more`` after them."""
    extra = StructType.fromDDL(more) if more else StructType()
    fields = [StructField(f"c{i}", f.dataType) for i, f in enumerate([*df.schema.fields, *extra.fields])]

    def run(part):
        out = fn(part)
        return pa.RecordBatch.from_arrays(out.columns if isinstance(out, pa.RecordBatch) else out, names=[f.name for f in fields])

    return map_chunks(df, run, StructType(fields), column).toDF(*df.columns, *extra.names)


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int):
    """Within it, jobs hand rows to Python in batches of ``rows``: for tables whose rows are megabytes each."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
