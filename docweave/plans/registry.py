"""The registry of queries and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docweave.session import prepare

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (tables, spark) under its name; tables(name) reads a table."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return register
