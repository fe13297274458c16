import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sparloom.operators import nested
from sparloom.operators.orphans import Reference, folded, orphan_counts, orphans, plain_number
from sparloom.plans import integrity

T = lambda day: datetime(2024, 1, day)
CH = "chunk_id string, source_block_ids array<bigint>, loaded_at timestamp, reason string, salt int"
BL = "block_id bigint, loaded_at timestamp, target_key string"
DEL = "entity string, entity_key string, deleted_at timestamp"


def run(spark, chunks, blocks, gone):
    refs = [Reference("chunks", spark.createDataFrame(chunks, CH), "chunk_id", "source_block_ids", "blocks", True)]
    found = orphans(refs, {"blocks": (spark.createDataFrame(blocks, BL), "block_id")}, spark.createDataFrame(gone, DEL), {"blocks": plain_number})
    return found, {(r.row_key, r.target_key, r.reason, r.period) for r in found.collect()}


def test_reasons_ties_copies_and_clashing_columns(spark):
    chunks = [("a", [1, 2, 2, 3, None, 4], T(5), "x", 9), ("a", [1, 2, 2, 3, None, 4], T(9), "x", 9), ("b", None, T(5), None, None), ("c", [], T(5), None, None), (None, [2], T(5), None, None), ("d", [1, 5], None, None, None)]
    blocks = [(1, T(5), "k"), (1, T(8), "k"), (3, T(6), "k"), (4, T(1), "k"), (5, None, None)]
    gone = [("blocks", " 4 ", T(5)), ("blocks", "4", T(9)), ("blocks", "1", T(6)), ("datasets", "3", T(1)), ("blocks", None, T(1))]
    _, got = run(spark, chunks, blocks, gone)
    assert got == {("a", "2", "missing", "2024-01"), ("a", "3", "late", "2024-01"), ("a", "4", "deleted", "2024-01"), (None, "2", "missing", "2024-01")}


def test_empty_tables(spark):
    assert run(spark, [], [(1, T(1), "")], [])[1] == set()
    found, got = run(spark, [("a", [7], T(2), "", 0)], [], [])
    assert got == {("a", "7", "missing", "2024-01")}
    assert [tuple(r) for r in orphan_counts(found).collect()] == [("chunks", "blocks", "missing", "2024-01", 1, 1)]


def test_plain_number_and_folded(spark):
    df = spark.createDataFrame([(x,) for x in ["5", " 5 ", "005", "5.0", "+5", "x5", "", " ", None, "0"]], "x string")
    assert [r[0] for r in df.select(plain_number(F.col("x"))).collect()] == ["5"] * 5 + ["x5", None, None, None, "0"]
    assert spark.createDataFrame([(" DS_1 ",)], "x string").select(folded(F.col("x"))).first()[0] == "ds_1"


def test_hot_key_keeps_all_rows(spark):
    chunks = [(f"c{i}", [99], T(2), "", 0) for i in range(3000)]
    assert len(run(spark, chunks, [(1, T(1), "")], [])[1]) == 3000


TR = "tree_id string, nodes string, metadata string, updated_at timestamp, path string, entity int"


def flat(spark, rows):
    return {(r.tree_id, r.entity, r.path, r.parent_path) for r in nested.flatten_trees(spark.createDataFrame(rows, TR)).collect()}


def test_flatten_shapes(spark):
    deep = {"title": "x"}
    for _ in range(200):
        deep = {"title": "n", "nodes": [deep]}
    tree = [{"title": "a", "nodes": [None, {"title": "b", "metadata": json.dumps({"protocol_fields": {"field_name": "f"}})}, 5]}, None, json.dumps({"title": "c", "nodes": "[{}]"})]
    rows = [("t", json.dumps(tree), json.dumps(json.dumps({"documents": [None, {"doc_id": 1}]})), T(2), "p", 1), ("t", "[{}, {}, {}, {}]", None, T(1), "p", 1), ("t", json.dumps(tree), json.dumps(json.dumps({"documents": [None, {"doc_id": 1}]})), T(2), "p", 1)]
    rows += [("bad", '[{"title": "a"}', '{"documents": {}}', T(3), "", 0), ("bad", "[{}]", None, T(2), "", 0), ("null", None, None, None, "", 0), ("one", '{"title": 1}', "7", T(1), "", 0), ("deep", json.dumps(deep), "", T(1), "", 0)]
    got = flat(spark, rows)
    assert {g for g in got if g[0] == "t"} == {("t", "node", "0", ""), ("t", "node", "0.1", "0"), ("t", "field", "0.1#0", "0.1"), ("t", "node", "2", ""), ("t", "node", "2.0", "2"), ("t", "document", "@1", "")}
    assert {g for g in got if g[0] in ("bad", "null", "one")} == {("bad", "document", "@0", ""), ("one", "node", "0", "")}
    assert len([g for g in got if g[0] == "deep"]) == 201


def test_flatten_equals_walk(spark, small):
    """Against a plain recursive walk over the whole table."""
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/pageindex_workspace.parquet").select("tree_id", "nodes", "metadata", "updated_at").collect()]
    latest = {}
    for t, n, m, u in rows:
        if t not in latest or (u, n or "", m or "") > latest[t][0]:
            latest[t] = ((u, n or "", m or ""), n, m)
    want = set()

    def val(x):
        while isinstance(x, str):
            try:
                x = json.loads(x)
            except ValueError:
                return None
        return x

    def lst(x):
        x = val(x)
        return [x] if isinstance(x, dict) else x if isinstance(x, list) else []

    def walk(t, nodes, parent):
        for i, o in enumerate(lst(nodes)):
            o = val(o)
            if not isinstance(o, dict):
                continue
            p = f"{parent}.{i}" if parent else str(i)
            want.add((t, "node", p, parent))
            m = val(o.get("metadata"))
            for k, f in enumerate(lst(m.get("protocol_fields")) if isinstance(m, dict) else []):
                if isinstance(val(f), dict):
                    want.add((t, "field", f"{p}#{k}", p))
            walk(t, o.get("nodes"), p)

    for t, (_, n, m) in latest.items():
        walk(t, n, "")
        m = val(m)
        for k, x in enumerate(lst(m.get("documents")) if isinstance(m, dict) else []):
            if isinstance(val(x), dict):
                want.add((t, "document", f"@{k}", ""))
    got = {(r.tree_id, r.entity, r.path, r.parent_path) for r in integrity.p5_found(spark, small).collect()}
    assert got == want and len(want) > 100


@pytest.mark.parametrize("name", sorted(integrity.QUERIES))
def test_queries_run(spark, small, name):
    assert integrity.QUERIES[name](spark, small).count() > 0
