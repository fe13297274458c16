"""Deeply nested records as related flat tables.

The JSON text of a tree is decoded once; from there on nothing walks row by row: each depth of all trees of a batch is
one Arrow list array, whose offsets and parent-index kernel give the child arrays, and keys and paths are propagated
by vectorised ``take``. Depth is not bounded.

Defined results
    * of several versions of a tree the one with the latest ``updated_at`` counts, even if unreadable; a null
      ``updated_at`` is the earliest; among equal times the largest (nodes, metadata) text counts.
    * null, empty or unreadable JSON in a column gives no rows from that column; a single object is a list of one;
      JSON inside a string counts as JSON; null and scalar elements hold their position and give no row.
    * an empty table gives no rows; further columns, whatever their names, are ignored.
    * ``attrs`` holds the attributes a table asks for, as JSON; an attribute that is missing or of another type is null there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE = 512
SCHEMA = "tree_id string, entity string, path string, parent_path string, ordinal int, depth int, name string, ref string, attrs string"


def latest_trees(df: DataFrame) -> DataFrame:
    """(tree_id, nodes, metadata) of the latest version of each tree."""
    order = F.struct(F.col("updated_at").isNotNull(), "updated_at", F.coalesce("nodes", F.lit("")), F.coalesce("metadata", F.lit("")))
    picked = df.groupBy("tree_id").agg(F.max_by(F.struct("nodes", "metadata"), order).alias("v"))
    return picked.select("tree_id", "v.nodes", "v.metadata")


def _decode(text):
    """The value of JSON text, of JSON text inside JSON text and so on; None where it can't be read."""
    for _ in range(8):
        if not isinstance(text, str):
            return text
        try:
            text = json.loads(text)
        except (ValueError, RecursionError):
            return None
    return None


def _listed(value) -> list:
    value = _decode(value)
    if isinstance(value, dict):
        return [value]
    return value if isinstance(value, list) else []


def _children(lists: list[list]) -> tuple[list, pa.Array, pa.Array]:
    """Flatten one depth: the child objects, the index of each one's parent and its position, by list offsets."""
    sizes = np.fromiter((len(x) for x in lists), dtype=np.int32, count=len(lists))
    offsets = np.zeros(len(lists) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    flat = [_decode(x) for one in lists for x in one]
    arr = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.arange(len(flat), dtype=np.int32)))
    parents = pc.list_parent_indices(arr)
    position = pc.subtract(arr.flatten(), pa.array(offsets[:-1]).take(parents)).cast(pa.int32())
    keep = np.fromiter((isinstance(x, dict) for x in flat), dtype=bool, count=len(flat))
    mask = pa.array(keep)
    return [x for x, k in zip(flat, keep) if k], parents.filter(mask), position.filter(mask)


def _text(v):
    return None if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def _rows(tree: pa.Array, kind: str, path: pa.Array, parent: pa.Array, pos: pa.Array, depth: int, objects: list, name: str, ref: str, wanted: tuple) -> pa.RecordBatch:
    n = len(objects)
    attrs = [json.dumps({k: o[k] for k in wanted if k in o}, ensure_ascii=False) for o in objects] if wanted else [None] * n
    return pa.RecordBatch.from_arrays(
        [
            tree, pa.array([kind] * n, pa.string()), path, parent, pos, pa.array(np.full(n, depth, dtype=np.int32)),
            pa.array([_text(o.get(name)) for o in objects], pa.string()), pa.array([_text(o.get(ref)) for o in objects], pa.string()), pa.array(attrs, pa.string()),
        ],
        names=["tree_id", "entity", "path", "parent_path", "ordinal", "depth", "name", "ref", "attrs"],
    )


def _join(a: pa.Array, b: pa.Array, sep: str) -> pa.Array:
    return pc.binary_join_element_wise(a, b.cast(pa.string()), sep)


def flatten_batch(tree: pa.Array, nodes: list, metadata: list, wanted: dict[str, tuple]) -> Iterator[pa.RecordBatch]:
    """The objects of a batch of trees of the ``wanted`` entities, depth by depth, with their wanted attributes."""
    tree = tree.cast(pa.string())
    empty = lambda n: pa.array([""] * n, pa.string())
    objects, up, pos = _children([_listed(x) for x in nodes])
    keys, path, parent, depth = tree.take(up), pos.cast(pa.string()), empty(len(objects)), 0
    while objects:
        if "node" in wanted:
            yield _rows(keys, "node", path, parent, pos, depth, objects, "title", "node_id", wanted["node"])
        meta = [_decode(o.get("metadata")) for o in objects] if "field" in wanted else []
        fields, fup, fpos = _children([_listed(m.get("protocol_fields")) if isinstance(m, dict) else [] for m in meta])
        if fields:
            owner = path.take(fup)
            yield _rows(keys.take(fup), "field", _join(owner, fpos, "#"), owner, fpos, depth, fields, "field_name", "bit_start", wanted["field"])
        objects, up, pos = _children([_listed(o.get("nodes")) for o in objects])
        parent = path.take(up)
        keys, path, depth = keys.take(up), _join(parent, pos, "."), depth + 1
    meta = [_decode(m) for m in metadata] if "document" in wanted else []
    docs, up, pos = _children([_listed(m.get("documents")) if isinstance(m, dict) else [] for m in meta])
    if docs:
        yield _rows(tree.take(up), "document", _join(empty(len(docs)), pos, "@"), empty(len(docs)), pos, 0, docs, "doc_id", "file_hash", wanted["document"])


#: Attributes of the three tables.
ATTRIBUTES = {"node": ("line_num", "physical_index", "text", "summary", "prefix_summary"), "field": ("bit_start", "bit_length"), "document": ("file_hash", "status", "source_block_ids")}
PATHS = {"node": (), "field": (), "document": ()}


def flatten_trees(df: DataFrame, wanted: dict[str, tuple] = PATHS) -> DataFrame:
    """One row per object of the wanted entities of the latest version of each tree, with its path and its parent's path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                s = b.slice(i, SLICE)
                yield from flatten_batch(s.column(0), s.column(1).to_pylist(), s.column(2).to_pylist(), wanted)

    return latest_trees(df).select("tree_id", "nodes", "metadata").mapInArrow(run, SCHEMA)


def _attr(name: str, kind: str):
    """An optional attribute, differently typed in places: null where it can't be cast."""
    return F.expr(f"try_cast(get_json_object(attrs, '$.{name}') as {kind})").alias(name)


def node_table(flat: DataFrame) -> DataFrame:
    """Nodes with typed columns and their parent link."""
    return flat.where("entity = 'node'").select(
        "tree_id", "path", "parent_path", "ordinal", "depth", F.col("name").alias("title"), F.col("ref").alias("node_id"),
        _attr("line_num", "int"), _attr("physical_index", "int"), _attr("text", "string"), F.coalesce(_attr("summary", "string"), _attr("prefix_summary", "string")).alias("summary"),
    )


def field_table(flat: DataFrame) -> DataFrame:
    """Fields with typed columns and the path of the node they stand in."""
    return flat.where("entity = 'field'").select(
        "tree_id", "path", F.col("parent_path").alias("node_path"), "ordinal", F.col("name").alias("field_name"), _attr("bit_start", "int"), _attr("bit_length", "int")
    )


def document_table(flat: DataFrame) -> DataFrame:
    """Documents with typed columns."""
    return flat.where("entity = 'document'").select(
        "tree_id", "path", "ordinal", F.col("name").alias("doc_id"), _attr("file_hash", "string"), _attr("status", "string"),
        F.expr("from_json(get_json_object(attrs, '$.source_block_ids'), 'array<bigint>')").alias("source_block_ids"),
    )
