"""Registration of queries: a DataFrame function and the SQL that must give its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL for DuckDB where there is one."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def sql_query(name: str, text: str, frames: Callable[[SparkSession, str], dict[str, DataFrame]], prefix: str) -> None:
    """Register SQL that both engines read.

    ``text`` names its inputs in braces; Spark gets them as DataFrames from
    ``frames``, DuckDB as the common tables of ``prefix``.
    """
    names = {n for n in _names(text)}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        given = frames(spark, sf_dir)
        return spark.sql(text, **{n: given[n] for n in names})

    query(name, f"{prefix}\n{text.format(**{n: n for n in names})}")(run)


def _names(text: str) -> set[str]:
    import string

    return {n for _, n, _, _ in string.Formatter().parse(text) if n}
