"""Registered queries of the engine: name -> a query over the tables in a folder, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weft.functions import postgres
from weft.plans import relational, search, sessions

Query = Callable[[SparkSession, str], DataFrame]


def views(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """Temporary views of the tables that a text of SQL names."""
    for t in relational.TABLES:
        if t in sql:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def _sql(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, relational.spark_sql(name))
        if "weft_" in relational.spark_sql(name):
            postgres.register(spark)
        return spark.sql(relational.spark_sql(name))

    return run


def queries() -> dict[str, Query]:
    return {name: _sql(name) for name in relational.SQL} | search.RUN | sessions.RUN


def oracle_sql() -> dict[str, str]:
    return {name: relational.oracle(name) for name in relational.SQL} | search.SQL | sessions.SQL
