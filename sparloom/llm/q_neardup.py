"""Queries of the near-duplicate operator (p4_)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparloom.llm import neardup
from sparloom.sources.tables import table


def _records(spark: SparkSession, d: str) -> DataFrame:
    return neardup.records(table(spark, d, "qa_pairs"), "qa_id", "question", "answer", "instruction")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.alike_pairs(_records(spark, d)).select(F.col("id1").alias("qa_id_1"), F.col("id2").alias("qa_id_2"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per QA pair: the class of its text, how many have that text, its number of links and its group."""
    return neardup.memberships(_records(spark, d)).withColumnRenamed("id", "qa_id")


QUERIES = {f.__name__: f for f in (p4_found, p4_groups)}
SQL: dict[str, str] = {}
