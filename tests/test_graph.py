import json

import pytest
from pyspark.sql import functions as F

from sparloom.functions import features, jsontext
from sparloom.operators import graph, retrieval
from sparloom.sources import sinks


def test_candidates_are_pruned(spark):
    t = spark.createDataFrame([("p", 1, "OUTER_TEMP_1"), ("p", 2, "SPEED_LIMIT"), ("p", 3, "ZZZ"), ("p", 4, None)], "package string, ordinal int, field_name string")
    s = spark.createDataFrame([("p", "OUTER_TEMP_1"), ("p", "OUTER_TEMP_2"), ("p", "msg.SPEED_MAX"), ("p", "HEADING"), ("q", "ZZZ"), ("p", None)], "package string, field_name string")
    got = {}
    for r in graph.source_candidates(t, s).collect():
        got.setdefault(r.ordinal, []).append((r.rank, r.source, r.score))
    assert got[1] == [(1, "OUTER_TEMP_1", 100.0)] and got[2][0][1] == "msg.SPEED_MAX" and 3 not in got and 4 not in got
    assert graph.source_candidates(t.limit(0), s).count() == 0 and graph.source_candidates(t, s.limit(0)).count() == 0


def test_resolution_in_tiers(spark):
    f = spark.createDataFrame([("p", "AB_C"), ("p", "X_AB_C"), ("p", "ab_d"), ("p", "AB_D"), ("q", "ONLY"), ("p", None)], "package string, field_name string")
    a = spark.createDataFrame([("p", i, x) for i, x in enumerate(["AB_C", "ab-c", "C", "Ab_D", "ab_d", "ONLY", None, " x_ab_c "])], "package string, ordinal int, asked string")
    got = [(r.resolved, r.how) for r in graph.resolve(a, f).orderBy("ordinal").collect()]
    assert got == [("AB_C", "exact"), ("AB_C", "normalised"), (None, "ambiguous"), (None, "ambiguous"), ("ab_d", "exact"), (None, "unknown"), (None, "unknown"), ("X_AB_C", "name")]
    assert graph.resolve(a.limit(0), f).count() == 0 and {r.how for r in graph.resolve(a, f.limit(0)).collect()} == {"unknown"}


def test_schema_fallback(spark):
    s = spark.createDataFrame([("a_x_1", "F", 8, 1, 0), ("a_x_2", "F", 9, 2, 0), ("b_y_1", "G", 4, 3, 0)], "package string, field_name string, bit_length int, block_id bigint, pos int")
    a = spark.createDataFrame([("a_x_1", 1, "f"), ("a_x_3", 1, "F "), ("c_z_1", 1, "G"), ("c_z_1", 2, "H"), ("c_z_1", 3, None)], "package string, ordinal int, field_name string")
    got = {(r.package, r.ordinal): (r.bit_length, r.level) for r in graph.schema_fallback(a, s, r"^([a-z]+_[a-z]+)").collect()}
    assert got == {("a_x_1", 1): (8, "message"), ("a_x_3", 1): (8, "family"), ("c_z_1", 1): (4, "default"), ("c_z_1", 2): (None, "none"), ("c_z_1", 3): (None, "none")}


@pytest.mark.parametrize("text, want", [('so {"a": [1, 2]} and [3]', {"a": [1, 2]}), ("```json\n[1]\n``` {\"b\": 2}", [1]), ('{"a": 1', None), ('x } {"q": "}"} y', {"q": "}"}), ("[broken] {\"ok\": true}", {"ok": True}), ("", None), (None, None), ("plain", None), ("[{]} [7]", [7])])
def test_json_in_text(text, want):
    got = jsontext.found(text)
    assert (json.loads(got) if got else None) == want


def test_preferred_json_first():
    assert json.loads(jsontext.found('[1] {"a": 2}', "{")) == {"a": 2}


def test_anchor_of_metadata_first(spark):
    df = spark.createDataFrame([("see AB1.2", "x JG3.4c1"), ("see ab1.2", None), ("none", ""), (None, None), ("AB1.2报文", None)], "t string, m string")
    assert [r[0] for r in df.select(features.anchor(F.col("t"), F.col("m"))).collect()][:4] == ["JG3.4C1", "AB1.2", "", ""]


def test_sinks_keep_keys_single(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 2, 5)], "k string, v int, at int")
    new = spark.createDataFrame([("b", 3, 5), ("b", 9, 4), ("c", 4, 1), (None, 7, 9)], "k string, v int, at int")
    assert {tuple(r) for r in sinks.upsert(old, new, ["k"], "at").collect()} == {("a", 1, 1), ("b", 3, 5), ("c", 4, 1)}
    assert {tuple(r) for r in sinks.merge(old, new.where("k is not null"), "k").collect()} == {("a", 1, 1), ("b", 9, 5), ("c", 4, 1)}
    numbered = sinks.with_ids(spark.range(1000).withColumn("x", F.rand(3)), ["x", "id"], 7, "no")
    rows = numbered.orderBy("x", "id").select("no").collect()
    assert [r.no for r in rows] == list(range(7, 1007)) and sinks.with_ids(spark.range(0).toDF("x"), ["x"], 1).count() == 0
    e = {r.k: json.loads(r.value) for r in sinks.envelopes(old.unionByName(old.where("k = 'a'")), "k", "rows").collect()}
    assert e["a"]["total_rows"] == 2 and e["b"]["rows"] == [{"v": 2, "at": 5}]
    p = spark.createDataFrame([("q", "good", "bad"), ("q", None, "bad")], "prompt string, chosen string, rejected string")
    assert [json.loads(r.value) for r in sinks.preference_lines(p).collect()] == [{"prompt": "q", "chosen": "good", "rejected": "bad"}]
    packs = {r.package: json.loads(r.value) for r in sinks.rule_package(spark.createDataFrame([("p", 2, "b"), ("p", 1, "a"), ("q", 1, "c")], "package string, pos int, formula string")).collect()}
    assert [x["formula"] for x in packs["p"]["rules"]] == ["a", "b"] and packs["q"]["project_name"] == "q"


def test_assembled_packages(spark):
    rules = spark.createDataFrame([("p", "a", "x*2 + x", ["u"]), ("p", "b", "result + 1", ["u"]), ("p", "c", "x", []), ("p", "gone", "x", ["u"]), ("p", "e", "max(x, ax)", ["v_1"])], "package string, key string, formula string, sources array<string>")
    targets = spark.createDataFrame([("p", k, k.upper()) for k in "abcde"] + [("q", "z", "Z")], "package string, key string, field_name string")
    got = {(r.package, r.target_field): (r.formula, r.rule_type, r.origin) for r in graph.assembled(rules, targets, "s").collect()}
    assert got == {("p", "A"): ("s.u*2 + s.u", "expression", "rule"), ("p", "B"): ("0", "const", "rule"), ("p", "C"): ("0", "const", "rule"), ("p", "D"): ("0", "const", "default"), ("p", "E"): ("max(s.v_1, ax)", "expression", "rule"), ("q", "Z"): ("0", "const", "default")}


def test_filtered_rules(spark):
    rules = spark.createDataFrame([("p", 1, "a", "x + 1", ["s.u"]), ("p", 2, "a", "x", ["lost"]), ("p", 3, "a", "", ["u"]), ("p", 4, "a", "w * 2", ["u"]), ("p", 5, "no", "u * 2", ["u"]), ("p", 6, "a", "7", [])], "package string, pos int, key string, formula string, sources array<string>")
    s = spark.createDataFrame([("p", "u")], "package string, key string")
    t = spark.createDataFrame([("p", "a")], "package string, key string")
    assert {r.pos: r.reason for r in graph.filtered_rules(rules, s, t).collect()} == {1: "", 2: "unknown source", 3: "no formula", 4: "undeclared name", 5: "unknown target", 6: ""}


def test_search_in_blocks_is_the_same(spark, monkeypatch):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    e = e.unionByName(e.where("vec_id < 20").select((F.col("vec_id") + 100000).alias("vec_id"), "embedding")).unionByName(e.limit(1).select(F.lit(-1).cast("bigint").alias("vec_id"), F.lit(None).cast("array<float>").alias("embedding")))
    q = e.where("vec_id % 100 = 0 or vec_id = -1")
    whole = {tuple(r) for r in retrieval.search(e, q, 7).select("query_id", "vec_id", "rank").collect()}
    monkeypatch.setattr(retrieval, "QUERY_ROWS", 2)
    assert {tuple(r) for r in retrieval.search(e, q, 7).select("query_id", "vec_id", "rank").collect()} == whole and len(whole) == 7 * (q.count() - 1)
    assert retrieval.search(e, q.limit(0), 7).count() == 0 and retrieval.search(e.limit(0), q, 7).count() == 0
    assert retrieval.ivf_search(e, q, 7).where("rank = 1").count() == q.count() - 1
