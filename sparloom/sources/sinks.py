"""Sinks: partitioned tables, merges, training exports, envelopes and vector stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparloom.session import cut


def write_table(df: DataFrame, path: str, by: str = "project_id") -> None:
    """Append rows, partitioned by owner, so that reads by owner prune; a hot owner is spread over several files."""
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if c != by][:1]), F.lit(16))
    df.repartition(F.col(by), salt).write.mode("append").partitionBy(by).parquet(path)


def merge(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New values over old ones where given; new keys added (no update in place: the result is written anew). Of several new
    rows of a key each column takes its largest value, so that a key stays one row."""
    cols = [c for c in new.columns if c != key]
    n = new.groupBy(key).agg(*[F.max(c).alias(f"n_{c}") for c in cols])
    j = old.join(n, key, "full_outer")
    return j.select(key, *[F.coalesce(F.col(f"n_{c}"), F.col(c)).alias(c) if c in cols else F.col(c) for c in old.columns if c != key])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the rows of each key the one with the latest ``order``; among equals the new one. Rows without a key are left out."""
    cols = old.columns
    both = old.select(*cols, F.lit(0).alias("is_new")).unionByName(new.select(*cols, F.lit(1).alias("is_new")))
    for k in keys:
        both = both.where(F.col(k).isNotNull())
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in cols if c not in keys]), F.struct(order, "is_new")).alias("r"))
    return last.select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in cols])


def with_ids(df: DataFrame, order: list[str], start: int, name: str = "id") -> DataFrame:
    """Rows numbered from ``start`` in order, without gaps: sorted by ranges, numbered within each range, moved on by the rows
    of the ranges before. Only one number per range reaches the driver."""
    ranged = cut(df.sort(*order).withColumn("part", F.spark_partition_id()))
    before, offsets = 0, {}
    for r in ranged.groupBy("part").count().orderBy("part").collect():
        offsets[r["part"]] = before
        before += r["count"]
    if not offsets:
        return df.withColumn(name, F.lit(None).cast("bigint"))
    shift = F.create_map(*[F.lit(v) for kv in offsets.items() for v in kv])[F.col("part")]
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return ranged.withColumn(name, (F.lit(start - 1) + shift + place).cast("bigint")).drop("part")


def envelopes(df: DataFrame, owner: str, name: str) -> DataFrame:
    """(owner, value): per owner one JSON envelope with its rows in order of all columns and their number."""
    rows = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in df.columns if c != owner])))
    return df.groupBy(owner).agg(F.to_json(F.struct(F.col(owner), F.count("*").alias(f"total_{name}"), rows.alias(name))).alias("value"))


def preference_lines(pairs: DataFrame) -> DataFrame:
    """(value): one JSON line per preference pair: prompt, chosen, rejected."""
    return pairs.where("chosen is not null and rejected is not null").select(F.to_json(F.struct("prompt", "chosen", "rejected")).alias("value"))


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the deleted ones."""
    return df.join(gone.select(key).distinct(), key, "left_anti")


def training_lines(qa: DataFrame) -> DataFrame:
    """(value): one JSON line per pair that is not low quality; conversion pairs as instruction, input and output."""
    good = qa.where(~F.coalesce("is_low_quality", F.lit(False)))
    conversion = F.to_json(F.struct(F.col("instruction"), F.col("question").alias("input"), F.col("answer").alias("output")))
    talk = F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content"))).alias("messages")))
    return good.select(F.when(F.col("qa_task_type") == "protocol_conversion", conversion).otherwise(talk).alias("value"))


def write_training(qa: DataFrame, path: str) -> None:
    training_lines(qa).write.mode("overwrite").text(path)


def rule_package(rules: DataFrame, by: str = "package") -> DataFrame:
    """(package, value): the rules of each package in order as one JSON text, in packages as they stand in the column ``by``."""
    rows = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in rules.columns if c != by])))
    return rules.groupBy(by).agg(F.to_json(F.struct(F.lit("1.0").alias("version"), F.col(by).alias("project_name"), rows.alias("rules"))).alias("value"))


class VectorStore:
    """Vectors as an append-only table; deletes are rows of a second table, applied when reading."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def insert(self, df: DataFrame) -> None:
        df.write.mode("append").parquet(f"{self.path}/rows")

    def delete(self, ids: DataFrame) -> None:
        ids.select("chunk_id").write.mode("append").parquet(f"{self.path}/deleted")

    def delete_dataset(self, dataset_id: str) -> None:
        """All vectors of a dataset."""
        self.delete(self.read().where(F.col("dataset_id") == dataset_id))

    def drop(self) -> None:
        """Everything: both tables become empty."""
        self.read().limit(0).write.mode("overwrite").parquet(f"{self.path}/empty")
        self.spark.read.parquet(f"{self.path}/empty").write.mode("overwrite").parquet(f"{self.path}/rows")

    def read(self) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/rows")
        try:
            gone = self.spark.read.parquet(f"{self.path}/deleted")
        except Exception:  # noqa: BLE001
            return rows
        return without(rows, gone, "chunk_id")

    def count(self) -> int:
        return self.read().count()
