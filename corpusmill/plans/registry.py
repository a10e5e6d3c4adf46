"""How plan modules register their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def registry() -> tuple[dict[str, Query], dict[str, str], Callable]:
    """Two tables, of queries and of their SQL, and a decorator that enters a query in both."""
    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}

    def query(oracle: str | None = None):
        def enter(f: Query) -> Query:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                df = f(spark, sf_dir)
                return df.withColumns({c: df[c].cast("long") for c, kind in df.dtypes if kind == "int"})

            queries[f.__name__] = run  # counts are longs, as in the SQL
            if oracle:
                sql[f.__name__] = oracle
            return f

        return enter

    return queries, sql, query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
