"""Block features, chunk roll-up and ordered grouping under a token budget."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparloom.functions import features as X
from sparloom.functions.text import tokens


def block_features(blocks: DataFrame) -> DataFrame:
    """One row per block with all its features; the text is the cleaned one where there is one."""
    text = F.coalesce(F.nullif(F.trim("cleaned_content"), F.lit("")), F.col("content"))
    b = blocks.select("block_id", "project_id", "file_name", F.coalesce("page_num", F.lit(0)).alias("page_num"), F.lower(F.coalesce("block_type", F.lit("text"))).alias("block_type"), text.alias("text"), "protocol_fields")
    n = X.field_counts(F.col("protocol_fields"))
    b = b.withColumns({"anchor": X.anchor(F.col("text")), "names": X.field_names(F.col("text"), F.col("protocol_fields")), "bit_coverage": n["bits"], "range_coverage": n["ranges"], "mapping_pairs": n["pairs"] + X.mapping_pairs(F.col("text")), "own_formulas": n["formulas"]})
    formulas = F.col("own_formulas") + (F.coalesce(F.col("text").rlike(X.FORMULA_HINT), F.lit(False)) | (F.col("own_formulas") > 0)).cast("int")
    b = b.withColumns({"formulas": formulas, "tokens": tokens(F.col("text")), "semantic": X.semantic_type(F.col("text"), F.col("block_type")), "noise": X.noise_penalty(F.col("text"), F.col("block_type"), F.coalesce(F.size("protocol_fields") > 0, F.lit(False)))})
    evidence = X.evidence_score(F.col("text"), F.col("block_type"), F.col("anchor") != "", F.size("names"), F.col("formulas"), F.col("mapping_pairs"), F.col("bit_coverage") + F.col("range_coverage"))
    return b.withColumn("evidence", evidence).drop("own_formulas")


def chunk_rollup(features: DataFrame, membership: DataFrame) -> DataFrame:
    """Statistics of chunks from the features of their blocks. ``membership``: chunk_id, block_id, pos."""
    j = membership.join(features, "block_id")
    g = j.groupBy("chunk_id").agg(
        F.count("*").alias("block_count"), F.sum("tokens").alias("token_estimate"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"), F.sum("formulas").alias("formula_count"),
        F.sum("mapping_pairs").alias("mapping_pair_count"), F.sum("bit_coverage").alias("bit_coverage_count"), F.sum("range_coverage").alias("range_coverage_count"), F.round(F.sum("evidence"), 4).alias("evidence_score"),
        F.round(F.sum("noise"), 4).alias("noise_penalty"), F.count_if(F.col("noise") >= 8).alias("noisy_block_count"), F.min_by(F.when(F.col("anchor") != "", F.col("anchor")), F.when(F.col("anchor") != "", F.col("pos"))).alias("protocol_anchor"),
    )
    base = (
        F.least(F.lit(40), F.size("names") * 3) + F.least(F.lit(20), F.col("formula_count") * 2) + F.least(F.lit(15), F.col("mapping_pair_count")) + F.least(F.lit(15), F.col("bit_coverage_count") + F.col("range_coverage_count"))
        + F.when(F.col("protocol_anchor").isNotNull(), 10).otherwise(0)
    )
    quality = F.round(base + F.least(F.lit(24.0), F.col("evidence_score") * 0.35) - F.least(F.lit(24.0), F.col("noise_penalty") * 0.8) - F.col("noisy_block_count") * 1.5, 4)
    return g.select("*", F.size("names").alias("field_count"), F.array_join(F.slice("names", 1, 24), ",").alias("field_names"), F.greatest(F.lit(0.0), quality).alias("quality_score")).drop("names")


#: Points for and against a block joining the group before it.
POINTS = {"anchor": 4, "other_anchor": -3, "names": 3, "next_page": 1, "far_page": -2, "type": 1, "fixed_type": -1, "semantic": 1, "formulas": 1, "evidence": 1, "noise": -2, "over": -2}
#: A block joins from so many points; a group may exceed its budget by this factor at most.
JOIN, STRETCH = 3, 1.35


def pair_points(features: DataFrame) -> DataFrame:
    """The features with ``points``: what the block and the one before it in its file say for one group, whatever its size."""
    w = Window.partitionBy("project_id", "file_name").orderBy("page_num", "block_id")
    cols = ("anchor", "names", "page_num", "block_type", "semantic", "formulas", "evidence", "noise")
    f = features.withColumn("prev", F.lag(F.struct(*cols)).over(w))
    p = lambda c: F.col("prev")[c]
    when = lambda cond, key, rest=0: F.when(F.coalesce(cond, F.lit(False)), POINTS[key]).otherwise(rest)
    fixed = F.col("block_type").isin("table", "code") | p("block_type").isin("table", "code")
    jump = F.col("page_num") - p("page_num")
    parts = [
        F.when((F.col("anchor") != "") & (p("anchor") != ""), when(F.col("anchor") == p("anchor"), "anchor", POINTS["other_anchor"])).otherwise(0),
        when(F.arrays_overlap("names", p("names")), "names"),
        when(jump <= 1, "next_page", when(jump >= 3, "far_page")),
        when(F.col("block_type") == p("block_type"), "type", when(fixed, "fixed_type")),
        when(F.col("semantic") == p("semantic"), "semantic"),
        when(F.least("formulas", p("formulas")) >= 1, "formulas"),
        when(F.least("evidence", p("evidence")) >= 18, "evidence"),
        when((F.col("noise") >= 8) & (F.col("evidence") < 12), "noise"),
    ]
    total = F.coalesce(parts[0], F.lit(0))
    for x in parts[1:]:
        total = total + x
    return f.select("project_id", "file_name", "block_id", "page_num", "block_type", "tokens", total.alias("points"))


GROUPS = "project_id string, file_name string, block_id bigint, group_no int"


def _fold(rows: DataFrame, step) -> DataFrame:
    """Group numbers of the blocks of each file in order. ``step(held, tokens, points, alone)`` tells whether a block starts
    a new group; only whole numbers pass through Python."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by([("page_num", "ascending"), ("block_id", "ascending")])
        group, held, out = 0, 0, []
        for tokens, points, alone in zip(*(t.column(c).to_pylist() for c in ("tokens", "points", "alone"))):
            if out and step(held, tokens, points, alone):
                group, held = group + 1, 0
            held += tokens
            out.append(group)
        yield pa.RecordBatch.from_arrays([t.column(c).combine_chunks() for c in ("project_id", "file_name", "block_id")] + [pa.array(out, pa.int32())], names=["project_id", "file_name", "block_id", "group_no"])

    cols = ["project_id", "file_name", "block_id", F.coalesce("page_num", F.lit(0)).cast("int").alias("page_num"), F.col("tokens").cast("bigint").alias("tokens"), "points", "alone"]
    return rows.select(*cols).groupBy("project_id", "file_name").applyInArrow(run, GROUPS)


def group_blocks(features: DataFrame, budget: int = 1024, scored: bool = True) -> DataFrame:
    """(project_id, file_name, block_id, group_no): blocks of a file in order, put into groups.

    Scored: a block joins with JOIN points or more, those of the pair and of what the group would hold. Otherwise by budget:
    a group ends before a block that would exceed it and before each table or code block. The fold is per file, the unit
    that is read in order.
    """
    alone = F.col("block_type").isin("table", "code").alias("alone")
    if not scored:
        return _fold(features.select("*", F.lit(0).alias("points"), alone), lambda held, tokens, points, alone: held + tokens > budget or alone)

    def split(held, tokens, points, alone):
        total = held + tokens
        return total > int(budget * STRETCH) or points + (POINTS["over"] if total > budget else 0) < JOIN

    return _fold(pair_points(features).select("*", alone), split)


def budget_split(features: DataFrame, budget: int = 1024) -> DataFrame:
    """Greedy fill of a file's blocks under a budget; a block over the budget stands alone."""
    return _fold(features.select("*", F.lit(0).alias("points"), F.lit(False).alias("alone")), lambda held, tokens, points, alone: held > 0 and (held + tokens > budget or tokens > budget))
