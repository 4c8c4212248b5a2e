"""File readers: explicit schemas, no inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.alerts import parse_alert_documents
from tidemark.operators.ledger import normalize_ledger
from tidemark.operators.panel import clean_bars, clean_closes

BAR_SCHEMA = "symbol string, dt date, open string, high string, low string, close string, volume string"
CLOSE_SCHEMA = "symbol string, dt date, close string"
MACRO_SCHEMA = "series_id string, dt date, value double"


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.option("header", True).schema(BAR_SCHEMA) if fmt == "csv" else spark.read
    return clean_bars(reader.format(fmt).load(path))


def read_closes(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.option("header", True).schema(CLOSE_SCHEMA) if fmt == "csv" else spark.read
    return clean_closes(reader.format(fmt).load(path).select("symbol", "dt", "close"))


def read_ledger_csv(spark: SparkSession, path: str) -> DataFrame:
    """Ledger files with a header; older files may lack the newer columns."""
    return normalize_ledger(spark.read.option("header", True).csv(path))


def read_alert_documents(spark: SparkSession, path: str) -> DataFrame:
    """One alert document per file; a malformed one contributes no rows."""
    return parse_alert_documents(spark.read.text(path, wholetext=True))


def read_macro(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(MACRO_SCHEMA).csv(path).filter(F.col("value").isNotNull())
