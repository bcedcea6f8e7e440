import hashlib
import zlib

from pyspark.sql import functions as F

import corpus_pipeline
from attestor.llm.raking import Mix, calibrated, rake

import numpy as np

from tests.llm.cases import OWN_NAMES, SPACE_WORD, clashing, edge_docs
from tests.llm.test_repetition import brute as quality
from tests.llm.test_setsketch import brute as near
from tests.llm.test_winnowing import brute as leaks

SF = "/root/testdata/sf0.001"


def topic(text):
    return "table" if "|" in text else "sectioned" if text.count("\n") >= 10 else "note" if len(text) < 1000 else "prose"


def sampled(rows):
    """Raking and sampling by hand over (doc_id, text, lang, source)."""
    mix = Mix()
    cells = {}
    for _, text, lang, source in rows:
        key = (source, lang, topic(text))
        cells[key] = cells.get(key, 0) + len(SPACE_WORD.findall(text))
    keys = list(cells)
    tokens = np.array([cells[k] for k in keys])
    codes, aims = [], []
    for d in range(3):
        values, code = np.unique([k[d] for k in keys], return_inverse=True)
        share = np.bincount(code, tokens) / tokens.sum()
        codes.append(code)
        aims.append(share**mix.flatten / (share**mix.flatten).sum() * tokens.sum())
    weight = rake(tokens, codes, aims, mix.rounds, mix.tolerance) / np.maximum(tokens, 1)
    p = dict(zip(keys, calibrated(tokens, weight, codes, aims, mix)[0]))
    return [r for r in rows if int(hashlib.md5(f"{r[0]}|mix".encode()).hexdigest()[:13], 16) / 2**52 < p[(r[3], r[2], topic(r[1]))]]


def test_pipeline_equals_brute_force(spark):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [r for r in rows if quality(r[1])["kept"]]
    first = {doc for doc, _, root in near([r[:2] for r in rows], 5) if doc == root}
    rows = [r for r in rows if r[0] in first]
    clean = {doc for doc, _, hit, _ in leaks([r[:2] for r in rows], items) if not hit}
    rows = sampled([r for r in rows if r[0] in clean])
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got) == sorted((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t, _, _ in rows)
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r)
    assert sorted(shards) == list(range(16)) and all(sorted(x.slot for x in s) == list(range(len(s))) for s in shards.values())


def test_stages_keep_columns_and_take_awkward_rows(spark, tmp_path):
    docs = clashing(edge_docs(spark))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        extra = [F.col("`" + c.replace("`", "``") + "`") for c in OWN_NAMES]
        assert out.select(*extra).distinct().collect() == [("extra",) * len(extra)], name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_stages_take_empty_tables(spark):
    docs = edge_docs(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def test_there_are_five_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "shard"]
