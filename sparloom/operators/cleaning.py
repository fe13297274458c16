"""The cleaning cascade over blocks: each rule sees the output of the one before; issues as rows; a summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparloom.functions.text import CASCADE


def once(blocks: DataFrame) -> DataFrame:
    """Blocks without second deliveries (the copies differ in the load time only)."""
    return blocks.drop("loaded_at").dropDuplicates(["block_id"])


def cascade(df: DataFrame, text: str = "content") -> DataFrame:
    """``df`` with ``step_0`` (the text) to ``step_5`` (the cleaned text): one projection each, fused by the optimizer."""
    df = df.withColumn("step_0", F.col(text))
    for i, (_, rule) in enumerate(CASCADE):
        df = df.withColumn(f"step_{i + 1}", rule(F.col(f"step_{i}")))
    return df


def issues(df: DataFrame, key: str = "block_id") -> DataFrame:
    """(key, issue_type, original, cleaned): one row per rule that changed a text, with previews of 200 characters."""
    made = [
        F.when(~F.col(f"step_{i}").eqNullSafe(F.col(f"step_{i + 1}")), F.struct(F.lit(name).alias("issue_type"), F.substring(f"step_{i}", 1, 200).alias("original"), F.substring(f"step_{i + 1}", 1, 200).alias("cleaned")))
        for i, (name, _) in enumerate(CASCADE)
    ]
    return cascade(df).select(key, F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("s")).select(key, "s.*")


def summary(df: DataFrame, *by: str) -> DataFrame:
    """Blocks found, blocks modified and the rate as text, per group."""
    done = cascade(df)
    changed = F.count_if(~F.col("step_0").eqNullSafe(F.col("step_5")))
    return done.groupBy(*by).agg(F.count("*").alias("total"), changed.alias("modified"), F.format_string("%.1f%%", changed * F.lit(100.0) / F.count("*")).alias("rate"))
