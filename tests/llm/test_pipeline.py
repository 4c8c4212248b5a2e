"""The pipeline as a whole, on a small fixture and on the smallest tables."""

import random
import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import prose
from tidemark.llm.queries import ORACLES, QUERIES
from tidemark.llm.tables import sweep
from tools.check_queries import rows_of

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="sample tables are not here")


def test_stages_keep_clean_documents(spark, docs, corpus, tmp_path):
    folder = str(tmp_path)
    words = dict(corpus)[20].split()
    secret = 'token = "0123456789abcdef0123456789abcdef01234567"'
    extra = spark.createDataFrame([(700, f"{prose(random.Random(77), 80)} {secret} and so on")], "doc_id bigint, text string")
    docs = docs.unionByName(extra, allowMissingColumns=True)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(words[:12]))], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        nxt = stage(spark, docs, folder)
        if name != "token_ids":
            assert nxt.columns == docs.columns
        docs = nxt.cache()
        after[name] = {r.doc_id: r for r in docs.collect()}
    assert len(after["quality"]) == len({i for i, _ in corpus}) + 1          # only good labels, so all stay
    assert 20 in after["near_duplicates"] and 20 not in after["decontamination"]
    assert not {100, 101, 102, 103, 104} & set(after["near_duplicates"])
    assert {6, 8, 15, 25, 39} <= set(after["token_ids"])
    assert 'token = "[SECRET]" and so on' in after["secrets"][700].text and after["secrets"][700].n_chars == len(after["secrets"][700].text)
    assert after["secrets"].keys() == after["decontamination"].keys() == after["token_ids"].keys()


def test_sweep_gives_back_what_the_drivers_jvm_has_freed(spark):
    jvm = spark.sparkContext._jvm
    status = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/status")
    if not status.exists():
        pytest.skip("memory can't be read here")

    def used():
        return int(re.search(r"RssAnon:\s+(\d+)", status.read_text())[1]) / 1024

    for _ in range(2):  # the heap itself shrinks first
        jvm.System.gc()
    held = [jvm.java.util.zip.Deflater() for _ in range(1200)]  # some 250 KB each, outside the heap
    for d in held[:-1]:  # the last one keeps the pool from shrinking by itself
        d.end()
    del held[:-1]
    jvm.System.gc()
    before = used()
    sweep(spark)
    assert used() < before - 100


@needs_tables
def test_run_equals_its_stages(spark):
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert got == {r.doc_id: r.n_tokens for r in docs.collect()} and got


@needs_tables
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs_over_the_whole_table(spark, name):
    df = QUERIES[name](spark, FOLDER)
    rows = df.collect()
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    if name.startswith("op10"):
        ids = {d for r in rows for d in r.doc_ids}
        assert ids == {r.doc_id for r in documents.where(F.length("text") > 0).collect()}
    elif name.startswith("op12"):  # one row per group and item
        assert {(r.lang, r.source) for r in rows} <= {(r.lang or "", r.source or "") for r in documents.collect()}
    elif name.startswith("op13"):
        turns = spark.read.parquet(f"{FOLDER}/conversations.parquet")
        assert sorted(r.conv_id for r in rows) == sorted(r.conv_id for r in turns.select("conv_id").distinct().collect())
    else:
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in documents.collect())
    if name in ORACLES:
        con = duckdb.connect()
        for t in ("documents", "benchmark", "conversations"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
        cur = con.execute(ORACLES[name])
        cols = [d[0] for d in cur.description]
        assert sorted(cols) == sorted(df.columns)
        assert rows_of(df.columns, [tuple(r) for r in rows]) == rows_of(cols, cur.fetchall())
