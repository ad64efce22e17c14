"""Registry of queries: a Spark callable, and where SQL can say it, its oracle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terravalor.plans.proxies import ORACLE_ONLY, PROXIES
from terravalor.plans.tables import Tables, macros

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under a name, with an optional oracle."""

    def keep(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return keep


def run(fn: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(Tables(spark, sf_dir))


def with_views(sql: str) -> str:
    """Prefix a statement with the views it needs, in dependency order."""
    views = {**PROXIES, **ORACLE_ONLY}
    names = re.compile(r"\b(?:" + "|".join(sorted(views, key=len, reverse=True)) + r")\b")
    order: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(names.findall(text)):
            if name not in order:
                visit(views[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    if not order:
        return sql.strip()
    heads = ",\n".join(f"{n} AS (\n{macros(views[n], 'duckdb').strip()}\n)" for n in order)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {heads},\n{body[5:]}"
    return f"WITH {heads}\n{body}"


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round double columns; both engines then show the same number."""
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    return df.select(
        *[F.round(F.col(c), digits).alias(c) if c in doubles else F.col(c) for c in df.columns]
    )
