"""Queries of the scanned-page operator (p1_)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparloom.llm.scans import noise, repaired
from sparloom.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return noise(table(spark, d, "blocks"))


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    return repaired(table(spark, d, "blocks"))


QUERIES = {f.__name__: f for f in (p1_found, p1_repaired)}
SQL: dict[str, str] = {}
