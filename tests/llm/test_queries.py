"""The registered corpus queries: names, columns, and SQL where there is some."""

import duckdb
import pytest

from attestor.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"}, "op2": {"doc_id", "tokens", "weight", "probability", "sampled"},
    "op3": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}, "op4": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
    "op5": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"}, "op6": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op7": {"doc_id", "start", "n_tokens", "ids_crc32"}, "op8": {"doc_id", "n_shingles", "component_id", "kept"}, "op9": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op10": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert COLUMNS[name.split("_")[0]] <= set(df.columns)
    table = "pages" if name.startswith("op9_") else "documents"
    assert df.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str) == sorted(found.fetchall(), key=str)
