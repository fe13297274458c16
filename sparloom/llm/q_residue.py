"""Queries of the residue operator (p9_)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparloom.llm.residue import residue, without_residue
from sparloom.sources.tables import table


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue(table(spark, d, "documents"))


def p9_kept(spark: SparkSession, d: str) -> DataFrame:
    """The documents that stay."""
    return without_residue(table(spark, d, "documents")).select("doc_id", "source", "lang", F.char_length("text").alias("chars"))


QUERIES = {f.__name__: f for f in (p9_found, p9_kept)}
SQL: dict[str, str] = {}
