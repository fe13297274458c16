"""Queries of the orphan-reference and nested-record operators (p3_, p5_)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparloom.operators import nested
from sparloom.operators.orphans import Reference, folded, orphan_counts, orphans, plain_number
from sparloom.sources.tables import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    refs = [
        Reference("chunks", table(spark, d, "chunks"), "chunk_id", "source_block_ids", "blocks", True),
        Reference("qa_pairs", table(spark, d, "qa_pairs"), "qa_id", "source_block_ids", "blocks", True),
        Reference("finetune_jobs", table(spark, d, "finetune_jobs"), "job_id", "dataset_id", "datasets", False),
    ]
    parents = {"blocks": (table(spark, d, "blocks"), "block_id"), "datasets": (table(spark, d, "datasets"), "dataset_id")}
    return orphans(refs, parents, table(spark, d, "deleted_records"), {"blocks": plain_number, "datasets": folded})


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphan_counts(p3_found(spark, d))


def _flat(spark: SparkSession, d: str, *entities: str) -> DataFrame:
    """The objects with the attributes of the named tables, or all objects with their paths alone."""
    return nested.flatten_trees(table(spark, d, "pageindex_workspace"), {e: nested.ATTRIBUTES[e] for e in entities} or nested.PATHS)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d).select("tree_id", "entity", "path", "parent_path")


def p5_nodes(spark: SparkSession, d: str) -> DataFrame:
    return nested.node_table(_flat(spark, d, "node"))


def p5_fields(spark: SparkSession, d: str) -> DataFrame:
    return nested.field_table(_flat(spark, d, "field"))


def p5_documents(spark: SparkSession, d: str) -> DataFrame:
    return nested.document_table(_flat(spark, d, "document"))


QUERIES = {f.__name__: f for f in (p3_found, p3_counts, p5_found, p5_nodes, p5_fields, p5_documents)}

_P3 = r"""
with pb as (select block_id::varchar as k, min(loaded_at) as l from blocks group by 1),
pd as (select lower(trim(dataset_id)) as k, min(loaded_at) as l from datasets group by 1),
parents as (select 'blocks' as t, k, l from pb union all select 'datasets', k, l from pd),
gone as (select entity as t, lower(trim(entity_key)) as k, min(deleted_at) as g from deleted_records group by 1, 2),
c as (select chunk_id as r, unnest(source_block_ids)::varchar as k, loaded_at from chunks),
q as (select qa_id as r, regexp_replace(trim(x), '^0*([0-9]+)(\.0*)?$', '\1') as k, loaded_at from (select qa_id, unnest(source_block_ids) as x, loaded_at from qa_pairs)),
f as (select job_id as r, lower(trim(dataset_id)) as k, loaded_at from finetune_jobs),
refs as (select table_name, r, target_table, k, min(l) as l from (
  select 'chunks' as table_name, r, 'blocks' as target_table, k, min(loaded_at) over (partition by r) as l from c
  union all select 'qa_pairs', r, 'blocks', k, min(loaded_at) over (partition by r) from q
  union all select 'finetune_jobs', r, 'datasets', k, min(loaded_at) over (partition by r) from f) where k is not null and k <> '' group by all),
found as (select table_name, r as row_key, target_table, refs.k as target_key,
  case when g <= refs.l then 'deleted' when parents.k is null then 'missing' when parents.l > refs.l then 'late' end as reason,
  strftime(refs.l, '%Y-%m') as period
  from refs left join parents on parents.t = target_table and parents.k = refs.k left join gone on gone.t = target_table and gone.k = refs.k)
"""
SQL = {
    "p3_found": _P3 + "select * from found where reason is not null",
    "p3_counts": _P3 + "select table_name, target_table, reason, period, count(*)::bigint as refs, count(distinct target_key)::bigint as missing_keys from found where reason is not null group by all",
}
