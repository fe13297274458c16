"""Queries of the mixing operator (p8_)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparloom.llm import mixing
from sparloom.sources.tables import table


#: The vocabulary file, unless the session names another.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _path(spark: SparkSession) -> str:
    return spark.conf.get("spark.sparloom.tokenizer", TOKENIZER)


def p8_plan(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_plan(table(spark, d, "documents"), table(spark, d, "mix_targets"), _path(spark))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.short_sources(p8_plan(spark, d))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix: one row per use of a document."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), _path(spark))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.actual_shares(table(spark, d, "documents"), table(spark, d, "mix_targets"), _path(spark))


def p8_tempered(spark: SparkSession, d: str) -> DataFrame:
    """The mix by the sources' own token shares, flattened to the entropy of the target shares as far as repetition allows."""
    return mixing.tempered(table(spark, d, "documents"), table(spark, d, "mix_targets"), _path(spark))


QUERIES = {f.__name__: f for f in (p8_found, p8_plan, p8_mix, p8_shares, p8_tempered)}
SQL = {
    "p8_found": """
with t as (select sum(length(text)) as all_chars from documents),
s as (select lower(trim(source)) as source, sum(length(text)) as chars from documents group by 1)
select m.source from mix_targets m left join s on s.source = m.source, t where coalesce(chars, 0) * max_repeats < target_share * all_chars
"""
}
