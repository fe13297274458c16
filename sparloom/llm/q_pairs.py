"""Queries of the pair checks (p6_)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparloom.llm.pairs import broken_pairs
from sparloom.sources.tables import table


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return broken_pairs(table(spark, d, "qa_pairs"))


def p6_against_older_check(spark: SparkSession, d: str) -> DataFrame:
    """Defects found against the flag of the older check."""
    old = table(spark, d, "qa_pairs").where("qa_id is not null").groupBy("qa_id").agg(F.max(F.coalesce("is_low_quality", F.lit(False))).alias("flagged"))
    both = old.join(p6_found(spark, d), "qa_id", "left")
    return both.groupBy(F.coalesce("defect", F.lit("none")).alias("defect"), "flagged").agg(F.count_distinct("qa_id").alias("pairs"))


QUERIES = {f.__name__: f for f in (p6_found, p6_against_older_check)}
SQL: dict[str, str] = {}
