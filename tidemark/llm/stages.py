"""Stages of the corpus pipeline. Each takes (spark, docs, sf_dir) and works on all rows of ``docs``.

All but the last return the columns of ``docs``, whatever these are besides doc_id and text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import quality, secret_scan, simhash, winnowing, wordtable
from tidemark.llm.tables import cut, order_id, table, text_key

VOCABULARY = "byte_bpe_50k.json"


def _among(docs: DataFrame, chosen: DataFrame, how: str) -> DataFrame:
    """The rows of ``docs`` whose (order id, text key) is in ``chosen`` (left_semi) or is not (left_anti)."""
    chosen = cut(chosen.select("oid", "key").distinct())
    return docs.join(chosen, (order_id(docs["doc_id"]) == chosen["oid"]) & (text_key(docs["text"]) == chosen["key"]), how)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at 0.7 or more; the others go. Null texts are scored as empty ones."""
    return quality.kept(docs, table(spark, sf_dir, "labels"), threshold=0.7)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies (five-word shingles, similarity 0.8 or more).

    The least id stays. Rows that repeat both id and text are copies as well: one of them stays.
    """
    copies = cut(simhash.near_copies(docs, shingle=5, least=0.8))
    kept = _among(docs, copies, "left_anti")
    repeated = copies.where("n > 1 and oid = first_oid and key = first_key")
    if repeated.isEmpty():
        return kept
    marks = {"__oid_of_row": order_id(), "__key_of_row": text_key()}
    one = _among(docs, repeated, "left_semi").withColumns(marks).dropDuplicates([*marks]).drop(*marks)
    return kept.unionByName(one)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window; the others go. Null and empty texts have none and stay."""
    found = winnowing.contamination(docs, table(spark, sf_dir, "benchmark"))
    return _among(docs, found.where("contaminated"), "left_anti")


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked; n_chars, where there is one, counts the new text."""
    out = secret_scan.masked(docs, public_tokenizers.path(VOCABULARY))
    if "n_chars" in docs.columns:
        changed = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(changed))
    return out


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit numbers) and the SHA-256 of the decoded text. Null texts read as empty."""
    rows = wordtable.encoded(docs, public_tokenizers.path(VOCABULARY), block=1_500_000)
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))
