"""Queries of the leakage operator (p7_)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparloom.llm import leakage
from sparloom.sources.tables import table


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_reparameterised(spark: SparkSession, d: str) -> DataFrame:
    return leakage.reparameterised(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """How many documents each leaked item stands in, per suite."""
    found = p7_found(spark, d).groupBy("item_id").agg(F.count("*").alias("docs"))
    return found.join(table(spark, d, "eval_items").select("item_id", "suite"), "item_id").select("suite", "item_id", "docs")


QUERIES = {f.__name__: f for f in (p7_found, p7_reparameterised, p7_items)}
_SQL = r"""
with w as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as l from documents),
v as (select item_id, suite, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as l from eval_items),
dw as (select doc_id, array_to_string(l[i:i + 11], ' ') as k from (select doc_id, l, unnest(range(1, len(l) - 10)) as i from w)),
iw as (select distinct item_id, array_to_string(l[i:i + 11], ' ') as k from (select item_id, l, unnest(range(1, len(l) - 10)) as i from v)),
f as (select distinct doc_id, item_id from dw join iw using (k))
"""
SQL = {"p7_found": _SQL + "select * from f", "p7_items": _SQL + "select suite, item_id, count(*)::bigint as docs from f join eval_items using (item_id) group by 1, 2"}
