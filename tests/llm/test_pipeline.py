"""Registered queries run, and the pipeline's stages take effect in their order."""
import os

import duckdb
import pytest

import corpus_pipeline
from sitewright.llm import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables")
COLUMNS = {
    "op3": {"doc_id", "start", "n_tokens", "ids_crc32"}, "op4": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}, "op5": {"doc_id", "held_out", "score", "predicted"},
    "op6": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}, "op7": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op8": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"}, "op9": {"doc_id", "held_out", "score", "predicted"}, "op10": {"doc_id", "held_out", "lang_pred", "score"},
}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_whole_tables(spark, name):
    df = registry.queries()[name](spark, DATA)
    want = COLUMNS.get(name.split("_")[0], {"doc_id"})
    assert want <= set(df.columns)
    n = df.count()
    assert n == 200 or name.startswith("op1_")


def test_sql(spark):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    for name, sql in registry.oracle_sql().items():
        df = registry.queries()[name](spark, DATA)
        columns = sorted(df.columns)
        got = c.execute(sql)
        names = [d[0] for d in got.description]
        assert sorted(tuple(str(r[x]) for x in columns) for r in df.collect()) == sorted(tuple(str(r[names.index(x)]) for x in columns) for r in got.fetchall())


def test_pipeline(spark):
    docs, seen = spark.read.parquet(f"{DATA}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns
        docs = docs.persist()
        seen.append(docs.count())
    assert len(corpus_pipeline.STAGES) == 5 and seen == sorted(seen, reverse=True) and seen[0] < 200
    out = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert out.count() == seen[-1]
    whole = corpus_pipeline.run(spark, DATA)
    assert sorted(r["ids_sha256"] for r in whole.collect()) == sorted(r["ids_sha256"] for r in out.collect())


def test_pipeline_of_no_rows(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
