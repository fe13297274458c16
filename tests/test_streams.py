from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from sparloom.operators import retrieval
from sparloom.sources import files, sinks
from sparloom.streaming import messages as M

T0 = datetime(2024, 1, 1)
MSG = [("a", T0, "x"), ("a", T0 + timedelta(seconds=1), "x"), ("a", T0 + timedelta(seconds=2), "y"), ("b", T0, "z"), ("b", T0 + timedelta(seconds=5), None), ("b", T0 + timedelta(seconds=6), None)]


def test_batch_store(spark):
    df = spark.createDataFrame(MSG, "name string, ts timestamp, payload string")
    assert sorted((r.name, r.repeats) for r in M.repeat_runs(df).collect()) == [("a", 1), ("a", 1), ("a", 2), ("b", 1), ("b", 1), ("b", 2)]
    assert {(r.name, r.payload, r.repeats) for r in M.latest_values(df).collect()} == {("a", "y", 1), ("b", None, 2)}


def test_stream_store_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([m for m in MSG if m[2]], "name string, ts timestamp, payload string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = M.latest_stream(src).writeStream.outputMode("update").format("memory").queryName("store").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.name, r.payload, r.repeats) for r in spark.table("store").collect()}
    assert got == {("a", "y", 1), ("b", "z", 1)}


def test_joint_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = lambda n: [(int(rng.integers(3)), T0 + timedelta(milliseconds=int(rng.integers(3000))), i) for i in range(n)]
    a, b = (spark.createDataFrame(rows(40), "key int, ts timestamp, value int") for _ in range(2))
    want = {(r.key, r.a_value, r.b_value) for r in M.joint_pairs(a, b, 200, 50).collect()}
    brute = {(x.key, x.value, y.value) for x in a.collect() for y in b.collect() if x.key == y.key and timedelta(milliseconds=-50) <= y.ts - x.ts <= timedelta(milliseconds=200)}
    assert want == brute and want
    for n, d in (("a", a), ("b", b)):
        d.coalesce(1).write.parquet(str(tmp_path / n))
    sa, sb = (spark.readStream.schema(a.schema).parquet(str(tmp_path / n)) for n in ("a", "b"))
    q = M.joint_stream(sa, sb, 200, 50).writeStream.outputMode("append").format("memory").queryName("joint").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.key, r.a_value, r.b_value) for r in spark.table("joint").collect()} == want


def test_training_log(spark):
    df = spark.createDataFrame([(1, "step=5 loss=0.25 lr=1e-4 acc=0.9"), (2, "noise"), (3, "step: 6")], "id int, line string")
    assert [tuple(r) for r in M.training_log(df).collect()] == [(1, 5, 0.25, 1e-4, 0.9), (3, 6, None, None, None)]


def test_search_equals_brute_force_and_index_recall(spark, small):
    e = spark.read.parquet(f"{small}/embeddings.parquet")
    q = e.where("vec_id % 100 = 0")
    rows = e.collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in retrieval.search(e, q, 10).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = {}
    for r in retrieval.ivf_search(e, q, 10, lists=32, probes=24).collect():
        hit.setdefault(r.query_id, set()).add(r.vec_id)
    for i in got:
        want = set(ids[np.lexsort((ids, -np.round(x @ x[ids == i][0], 9)))[:10]])
        assert got[i] == want
    assert sum(len(got[i] & hit[i]) for i in got) / (10 * len(got)) >= 0.9
    assert retrieval.search(e, e.limit(0), 3).count() == 0


def test_files(spark, tmp_path):
    import zipfile

    d = tmp_path / "docs"
    d.mkdir()
    (d / "a.txt").write_text("hello world, a text long enough")
    (d / "b.html").write_text("<p>x &amp; y</p><script>no</script><p>z</p>")
    (d / "e.docx").write_bytes(b"broken")
    (d / "n.exe").write_bytes(b"MZ")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(d / "c.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>para</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>A</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>B</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    got = sorted((r.path.rsplit("/", 1)[-1], r.block_type, r.content) for r in files.read_documents(spark, str(d)).collect())
    assert ("b.html", "text", "x & y\nz") in got and ("c.docx", "table", "A | B") in got and ("c.docx", "text", "para") in got
    assert {g[0] for g in got if g[1] == "unreadable"} == {"e.docx", "n.exe"}
    gate = {r.path.rsplit("/", 1)[-1]: (r.valid, r.issues) for r in files.file_gate(spark, str(d)).collect()}
    assert gate["a.txt"] == (True, "") and gate["c.docx"][0] and gate["e.docx"] == (False, "authenticity,readability")


def test_definitions(spark, tmp_path):
    (tmp_path / "m.xml").write_text('<NameSpace name="N"><Item name="A" defaultValue="1">12</Item><Group name="G" count="2"><Item name="B">4</Item></Group></NameSpace>')
    (tmp_path / "bad.xml").write_text("<x")
    got = [(r.field_path, r.bit_length, r.bit_offset) for r in files.read_definitions(spark, str(tmp_path)).orderBy("ordinal").collect()]
    assert got == [("N/A", 12, 0), ("N/G[0]/B", 4, 12), ("N/G[1]/B", 4, 16)]


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, None)], "k string, v int, w string")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert {tuple(r) for r in sinks.merge(old, new, "k").collect()} == {("a", 1, "x"), ("b", 3, None), ("c", 4, None)}
    store = sinks.VectorStore(spark, str(tmp_path / "vec"))
    store.insert(spark.createDataFrame([("1", [0.1]), ("2", [0.2])], "chunk_id string, embedding array<float>"))
    assert store.count() == 2
    store.delete(spark.createDataFrame([("2",)], "chunk_id string"))
    assert store.count() == 1
    sinks.write_table(spark.createDataFrame([("p", 1), ("q", 2)], "project_id string, v int"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).where(F.col("project_id") == "p").count() == 1
