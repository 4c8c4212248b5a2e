"""Registry of named queries and their check SQL.

A query is declared once with its output columns; the same declaration finishes the Spark
result and wraps the check SQL, so both sides share names, types and rounding.
Column codes: ``s`` text, ``d`` date, ``i`` integer, ``b`` boolean, a digit = double rounded so.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.queries.oracle_ctes import CTES
from tidemark.sources.adapters import Domain

TIE = 0.5078125
SPARK_TYPES = {"s": "string", "d": "date", "i": "bigint", "b": "boolean"}
SQL_TYPES = {"s": "VARCHAR", "d": "DATE", "i": "BIGINT", "b": "BOOLEAN"}


@dataclass(frozen=True)
class Query:
    name: str
    columns: tuple[tuple[str, str], ...]
    build: Callable[[Domain], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.run_on(Domain(spark, folder))

    def run_on(self, domain: Domain) -> DataFrame:
        out = []
        df = self.build(domain)
        for col, code in self.columns:
            if code.isdigit():
                # The same arithmetic on both engines: their round() differ on half-way values. Money
                # averages often end on exact halves, so the tie sits a little below the half.
                scale = float(10 ** int(code))
                out.append((F.floor(F.col(col).cast("double") * scale + TIE).cast("double") / scale).alias(col))
            else:
                out.append(F.col(col).cast(SPARK_TYPES[code]).alias(col))
        return df.select(*out)

    def check_sql(self) -> str | None:
        if self.sql is None:
            return None
        out = []
        for col, code in self.columns:
            if code.isdigit():
                scale = f"CAST({10 ** int(code)} AS DOUBLE)"
                value = f'CAST(floor(CAST("{col}" AS DOUBLE) * {scale} + CAST({TIE} AS DOUBLE)) AS BIGINT)'
                out.append(f'CAST({value} AS DOUBLE) / {scale} AS "{col}"')
            else:
                out.append(f'CAST("{col}" AS {SQL_TYPES[code]}) AS "{col}"')
        return with_ctes(self.sql, ", ".join(out))


def with_ctes(sql: str, select: str) -> str:
    """Prepend the shared CTEs that ``sql`` names, in dependency order."""
    needed: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for word in re.findall(r"[A-Za-z_][A-Za-z_0-9]*", text):
            if word in CTES and word not in seen:
                seen.add(word)
                visit(CTES[word])
                needed.append(word)

    visit(sql)
    parts = [f"{name} AS MATERIALIZED ({CTES[name]})" if name in MATERIALIZED
             else f"{name}{CTES[name]}" if CTES[name].startswith("(") else f"{name} AS ({CTES[name]})"
             for name in needed]
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        local, body = split_local(body[5:])
        parts.append(local)
    prefix = f"WITH RECURSIVE {', '.join(parts)} " if parts else ""
    return f"{prefix}SELECT {select} FROM ({body}) AS result"


MATERIALIZED = {"bars", "px", "ewm", "feat", "transactions"}


def split_local(text: str) -> tuple[str, str]:
    """Split ``a AS (...), b AS (...) SELECT ...`` into the CTE list and the final SELECT."""
    depth = 0
    for m in re.finditer(r"[()]|\bSELECT\b", text):
        token = m.group()
        if token == "(":
            depth += 1
        elif token == ")":
            depth -= 1
        elif depth == 0:
            return text[:m.start()].rstrip(), text[m.start():]
    raise ValueError("no final SELECT in check SQL")


REGISTRY: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None):
    """Register the decorated ``Domain -> DataFrame`` builder under ``name``."""

    def add(build: Callable[[Domain], DataFrame]) -> Callable[[Domain], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        cols = tuple(tuple(part.rsplit(":", 1)) for part in columns.split())
        REGISTRY[name] = Query(name, cols, build, sql)
        return build

    return add
