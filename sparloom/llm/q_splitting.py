"""Queries of the splitting operator (p2_)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparloom.llm.splitting import oversized_items, split_items
from sparloom.sources.tables import table


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces of all oversized items."""
    return split_items(oversized_items(table(spark, d, "blocks"), table(spark, d, "chunks"), table(spark, d, "split_limits")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The items that came out in more than one piece."""
    return p2_pieces(spark, d).where("piece = 1").select("table_name", "item_key")


def p2_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """How many pieces end at which kind of boundary."""
    return p2_pieces(spark, d).groupBy("table_name", "boundary").agg(F.count("*").alias("pieces"), F.max(F.char_length("text")).alias("longest"))


QUERIES = {f.__name__: f for f in (p2_found, p2_pieces, p2_boundaries)}
SQL = {
    "p2_found": r"""
with lim as (select * from split_limits),
b as (select distinct 'blocks' as table_name, block_id::varchar as item_key from blocks join lim on item_kind = block_type where length(content) > max_chars),
c as (select distinct chunk_id, content_snapshot, source_block_ids from chunks),
u as (select chunk_id, unnest(source_block_ids) as id, generate_subscripts(source_block_ids, 1) as pos from c where content_snapshot is null or trim(content_snapshot, E' \t\n\r　') = ''),
s as (select chunk_id, string_agg(content, E'\n' order by pos) as text from u join (select block_id, max(content) as content from blocks where content is not null group by 1) on block_id = id group by 1),
w as (select chunk_id, content_snapshot as text from c where not (content_snapshot is null or trim(content_snapshot, E' \t\n\r　') = '') union all select * from s)
select * from b union all
select distinct 'chunks', chunk_id from w, lim where item_kind = 'chunk' and length(text) > max_chars
""",
}
