"""The queries of this package, each a thin digest of an operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import conversations, divergence, language, linededup, packing, quality, secret_scan, simhash, spotsigs, superkmers, transducer, winnowing, wordtable
from tidemark.llm.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_simhash")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return rows.select("doc_id", simhash.hex16().alias("fingerprint"), "component_id")


@query("op4_quality_classifier")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


@query("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))


@query("op5_benchmark_decontamination", winnowing.ORACLE)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("oid", "key")


@query("op3_substring_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = superkmers.without_repeats(table(spark, sf_dir, "documents"), window=20)
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.counted(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


@query("op9_bpe_word_table")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordtable.digest(wordtable.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


@query("op2_spot_signatures")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.digest(table(spark, sf_dir, "documents"))


@query("op7_secret_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secret_scan.scan(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), threshold=0.5)
    spans = F.array_join(F.transform("secrets", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return rows.select("doc_id", "n_candidates", F.size("secrets").cast("bigint").alias("n_secrets"), spans.alias("spans"), "score",
                       F.sha2(F.coalesce("redacted", F.lit("")), 256).alias("redacted_sha256"))


@query("op10_packed_rows")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), length=2048)


@query("op11_line_dedup", linededup.ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linededup.deduplicated(table(spark, sf_dir, "documents"), shortest=10)
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query("op12_source_divergence", divergence.ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least_docs=30, top=50)


@query("op13_conversation_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.audits(conversations.damaged(table(spark, sf_dir, "conversations")))
