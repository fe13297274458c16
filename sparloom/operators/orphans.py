"""References to records that do not exist.

Distributed left anti-join of the distinct non-null foreign keys against the parent keys; only the suspect keys are
joined back to the referring rows, salted, so that a key named by a third of all rows does not land in one task.

Defined results
    * null and empty keys refer to nothing and give no row; an id list that is null or empty gives no row.
    * a referring key delivered several times counts once, with its earliest load time; ids repeated in a list count once.
    * a null load time of the referring row never makes a reference late or deleted; a parent whose load times are all
      null counts as present. A null row key is one key of its own.
    * an empty referring table gives no rows; an empty parent table makes every reference missing.
    * further columns of the tables, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 8


@dataclass(frozen=True)
class Reference:
    """One foreign key: the rows of ``frame`` name rows of ``target`` in ``key`` (a column or an array column)."""

    table: str
    frame: DataFrame
    row_key: str
    key: str
    target: str
    is_list: bool


def plain_number(c: Column) -> Column:
    """A block id in any notation (outer blanks, leading zeros, a zero fraction) as a plain number; other text is kept trimmed."""
    t = F.trim(c.cast("string"))
    n = F.regexp_extract(t, r"^[+]?0*([0-9]+)(?:\.0*)?$", 1)
    return F.nullif(F.when(n != "", n).otherwise(t), F.lit(""))


def folded(c: Column) -> Column:
    """A dataset id in lower case without outer blanks; empty becomes null."""
    return F.nullif(F.lower(F.trim(c.cast("string"))), F.lit(""))


def reference_rows(ref: Reference, normal) -> DataFrame:
    """(table_name, row_key, target_table, target_key, ref_load): one row per distinct reference."""
    load = F.min("loaded_at").alias("ref_load")
    ids = F.array_distinct(F.flatten(F.collect_set(ref.key))) if ref.is_list else F.collect_set(ref.key)
    keyed = ref.frame.where(F.col(ref.row_key).isNotNull()).groupBy(F.col(ref.row_key).cast("string").alias("row_key")).agg(load, ids.alias("ids"))
    rows = keyed.select("row_key", "ref_load", F.explode("ids").alias("raw"))
    # Rows without a key may be many; their ids are never gathered, and their one load time is a single row.
    lost = ref.frame.where(F.col(ref.row_key).isNull())
    raw = (F.explode(ref.key) if ref.is_list else F.col(ref.key)).alias("raw")
    rows = rows.unionByName(lost.select(F.lit(None).cast("string").alias("row_key"), raw).distinct().join(F.broadcast(lost.agg(load))))
    rows = rows.select(
        F.lit(ref.table).alias("table_name"), "row_key", F.lit(ref.target).alias("target_table"), normal(F.col("raw")).alias("target_key"), "ref_load"
    ).where("target_key is not null")
    return rows.dropDuplicates(["table_name", "row_key", "target_table", "target_key"])


def orphans(refs: list[Reference], parents: dict[str, tuple[DataFrame, str]], deleted: DataFrame, normal: dict) -> DataFrame:
    """Every orphan reference with its reason and month.

    ``parents``: target table name -> (frame, key column); ``deleted``: entity, entity_key, deleted_at;
    ``normal``: target table name -> function that brings a key into its plain form.
    """
    rows = None
    for r in refs:
        one = reference_rows(r, normal[r.target])
        rows = one if rows is None else rows.unionByName(one)

    parent = None
    for name, (frame, key) in parents.items():
        one = (
            frame.select(F.lit(name).alias("target_table"), normal[name](F.col(key)).alias("target_key"), "loaded_at")
            .where("target_key is not null")
            .groupBy("target_table", "target_key")
            .agg(F.min("loaded_at").alias("parent_load"))
        )
        parent = one if parent is None else parent.unionByName(one)
    gone = None
    for name in parents:
        one = deleted.where(F.col("entity") == name).select(F.lit(name).alias("target_table"), normal[name](F.col("entity_key")).alias("target_key"), "deleted_at")
        gone = one if gone is None else gone.unionByName(one)
    gone = gone.where("target_key is not null").groupBy("target_table", "target_key").agg(F.min("deleted_at").alias("deleted_at"))

    on = ["target_table", "target_key"]
    keys = rows.groupBy(*on).agg(F.min("ref_load").alias("first_ref"), F.max("ref_load").alias("last_ref"))
    known = parent.join(gone, on, "left").select(*[F.col(c).alias(f"p_{c}") for c in on], "parent_load", F.col("deleted_at").alias("p_deleted"))
    sound = (
        (F.col("target_table") == F.col("p_target_table"))
        & (F.col("target_key") == F.col("p_target_key"))
        & ~F.coalesce(F.col("parent_load") > F.col("first_ref"), F.lit(False))
        & ~F.coalesce(F.col("p_deleted") <= F.col("last_ref"), F.lit(False))
    )
    suspects = keys.join(known, sound, "left_anti").select(*on)
    suspects = suspects.join(parent.withColumn("present", F.lit(True)), on, "left").join(gone, on, "left")

    salted = suspects.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    joined = rows.withColumn("salt", F.pmod(F.xxhash64("row_key"), F.lit(SALTS)).cast("int")).join(salted, [*on, "salt"])
    reason = (
        F.when(F.col("deleted_at") <= F.col("ref_load"), "deleted")
        .when(F.col("present").isNull(), "missing")
        .when(F.col("parent_load") > F.col("ref_load"), "late")
    )
    return (
        joined.withColumn("reason", reason)
        .where("reason is not null")
        .select("table_name", "row_key", "target_table", "target_key", "reason", F.date_format("ref_load", "yyyy-MM").alias("period"))
    )


def orphan_counts(found: DataFrame) -> DataFrame:
    """References and distinct keys per table, reason and month; pre-aggregated per key before the distinct count."""
    per_key = found.groupBy("table_name", "target_table", "reason", "period", "target_key").agg(F.count("*").alias("n"))
    return per_key.groupBy("table_name", "target_table", "reason", "period").agg(F.sum("n").alias("refs"), F.count("*").alias("missing_keys"))
