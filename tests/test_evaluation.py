import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparloom.functions import extract, interpret, similarity
from sparloom.functions.formula import FormulaError, compile_formula
from sparloom.operators import blocks, evaluation, rulechecks, splitter
from sparloom.sources import files

FIELDS = "package string, ordinal int, protocol string, file_name string, field_name string, path string, bit_length int, default_value string"
RULES = "package string, pos int, target_field string, formula string, source_fields array<string>, rule_type string"
SOURCES = [("p", 1, "temp_sensor", "temp_sensor.xml", "temperature", "NameSpace/temperature", 12, "0"), ("p", 2, "temp_sensor", "temp_sensor.xml", "status", "NameSpace/status", 4, "0")]
TARGETS = [("p", 1, "temp_report", "temp_report.xml", "temperature_c", "NameSpace/temperature_c", 10, "0"), ("p", 2, "temp_report", "temp_report.xml", "alarm", "NameSpace/alarm", 6, "0")]
RULE_ROWS = [("p", 1, "temperature_c", "temp_sensor.temperature", ["temp_sensor.temperature"], "direct"), ("p", 2, "alarm", "0", [], "const")]


def frames(spark, targets=TARGETS, sources=SOURCES, rules=RULE_ROWS):
    return spark.createDataFrame(targets, FIELDS), spark.createDataFrame(sources, FIELDS), spark.createDataFrame(rules, RULES)


def test_known_scores(spark):
    """Two target fields, one direct rule and one zero rule: the scores known for this case."""
    got = evaluation.evaluate(*frames(spark), k=5, coarse=0.1, fine=0.1).cache()
    rows = {r.field_name: r for r in got.collect()}
    t, a = rows["temperature_c"], rows["alarm"]
    assert (t.status, a.status) == ("pass", "fallback_zero")
    assert t.candidates == ["temperature", "status"] and t.similarities == [0.9082, 0.8] and a.candidates == ["status", "temperature"] and a.similarities == [0.8095, 0.7821]
    assert (t.field_match, t.semantic, t.structure, t.dimension) == (100.0, 90.82, 100.0, 60.0) and (a.field_match, a.semantic, a.structure, a.dimension) == (0.0, 0.0, 100.0, 0.0)
    s = evaluation.scores(got).first()
    assert (s.field_match, s.semantic, s.structure, s.dimension, s.overall) == (50.0, 45.41, 100.0, 30.0, 53.8525)
    assert (s.coverage_rate, s.conversion_rate, s.recall_rate, s.non_zero_rules, s.zero_rules) == (100.0, 50.0, 100.0, 1, 1)


def test_missing_repeated_and_unknown_rules(spark):
    rules = [("p", 1, "Temperature-C", "nope(", ["gone"], None), ("p", 2, "temperature_c", "1", [], None), ("p", 3, "elsewhere", "7", [], None), ("p", 4, None, "7", [], None), ("p", 5, " ", "7", None, None)]
    got = {r.field_name: r for r in evaluation.evaluate(*frames(spark, rules=rules)).collect()}
    assert got["alarm"].status == "missing_rule" and got["alarm"].structure == 100.0
    assert got["temperature_c"].status == "fail" and got["temperature_c"].structure == 35.0 and got["temperature_c"].repeated
    assert got["elsewhere"].status == "invalid_target" and len(got) == 3
    empty = frames(spark)
    assert evaluation.evaluate(empty[0].limit(0), empty[1].limit(0), empty[2].limit(0)).count() == 0
    assert evaluation.evaluate(empty[0], empty[1].limit(0), empty[2]).where("candidate_count > 0").count() == 0


def test_rule_checks(spark):
    rows = [
        ("a", "mapping", "0=OFF, 1=ON", "enum", None, True, None), ("b", "mapping", "0-5=LOW; 5-9=HIGH", None, None, False, None), ("c", "mapping", "nothing", None, None, True, None), ("d", "transcoding", "signed(raw, bits) * 0.5", "deg", 8, True, 200.0),
        ("e", "transcoding", "x *", None, None, True, 1.0), ("f", "transcoding", "x / 0", None, None, True, 1.0), ("g", "transcoding", "bits + 1", "label", None, True, None), ("h", "other", "x", None, None, None, None), ("i", None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "rule_id string, mode string, formula string, unit string, bit_length int, known boolean, sample double")
    checks = rulechecks.rule_checks(df)
    bad = {}
    for r in checks.where("not passed").collect():
        bad.setdefault(r.rule_id, set()).add(r.check_name)
    assert bad == {
        "a": {"MappingUnitConvention"}, "b": {"KnowledgeBaseAnchor", "MappingRangeOverlap"}, "c": {"MappingSyntax"}, "e": {"ExpressionSyntax"}, "f": {"ExecutionPreview"}, "g": {"BitLengthResolved", "DimensionAnalysis"},
        "h": {"ModeSupported", "KnowledgeBaseAnchor"}, "i": {"ModeSupported", "KnowledgeBaseAnchor", "ExpressionSyntax"},
    }
    assert tuple(rulechecks.summary(rulechecks.rule_verdicts(checks)).first()) == (9, 2, 7, 5)
    assert rulechecks.rule_checks(df.limit(0)).count() == 0


def test_package_verdicts(spark):
    packages = spark.createDataFrame(
        [("good", "1", "x", "n", "simple", "T", [("s", "S")]), ("where", "1", "x", "n", "simple", "T", [("s", "S")]), ("logic", "1", "x", "n", "joint", "T", [("s", "S")]), ("bare", None, "x", "n", "simple", "T", [("s", "S"), ("s", "S")]), ("empty", "1", "x", "n", "simple", "T", [("s", "S")])],
        "package string, version string, project_name string, name string, mode string, target_protocol string, sources array<struct<alias:string,protocol:string>>",
    )
    rules = spark.createDataFrame([("good", 1, "a", "s.u", "direct", ["s.u"]), ("where", 1, "lost", "s.v", "direct", ["s.v"]), ("logic", 1, "a", "result + 1", "expression", ["u"]), ("bare", 1, "a", "1", "const", []), ("bare", 2, "a", "2", "const", [])], "package string, pos int, target_field string, formula string, rule_type string, source_fields array<string>")
    specs = spark.createDataFrame([("T", "a", None, None, "N/a", 4), ("S", "u", "U1", "label", "N/u", 4), ("S", "v", None, None, "N/v", None)], "protocol string, field_name string, actual_field string, label string, path string, bit_length int")
    got = {r.package: tuple(r)[1:] for r in rulechecks.package_verdicts(packages, rules, specs).collect()}
    assert got == {"good": (True, True, True, True), "where": (False, False, True, True), "logic": (True, True, False, True), "bare": (True, True, True, False), "empty": (True, True, True, True)}


def test_groups_shapes_and_validity(spark):
    df = spark.createDataFrame([("Mean_Longitude",), ("威胁 类型",), ("heading time",), (None,), ("abc",)], "n string")
    got = [tuple(r) for r in df.select(similarity.group_of(F.col("n")), similarity.groups_of(F.col("n"))).collect()]
    assert got == [("longitude", ["longitude"]), ("threat_type", ["threat_type"]), ("yaw", ["yaw", "time"]), (None, []), (None, [])]
    f = spark.createDataFrame([("1.5", "const"), ("x", "const"), ("(x", "direct"), ("x", "expression"), ("x+1", "expression"), ("", "direct"), (None, "const")], "f string, t string")
    assert [r[0] for r in f.select(similarity.formula_valid(F.col("f"), F.col("t"))).collect()] == [True, False, False, False, True, False, False]
    s = spark.createDataFrame([("anen", "anae"), ("an", "an"), ("", "")], "a string, b string")
    assert [r[0] for r in s.select(similarity.shape_similarity(F.col("a"), F.col("b"))).collect()] == [0.5, 1.0, 1.0]


def test_missing_inputs_give_no_value(spark):
    df = spark.createDataFrame([(None, 2.0), (9.0, 2.0)], "a double, b double")
    for text, want in (("clip(a, 1, 6)", [None, 6.0]), ("max(a, b)", [None, 9.0]), ("min(a, b, 1)", [None, 1.0]), ("clamp(b, a, 6)", [None, 6.0])):
        assert [r[0] for r in df.select(compile_formula(text, {"a": F.col("a"), "b": F.col("b")})).collect()] == want, text


@pytest.mark.parametrize(
    "text, want",
    [("x * 2 + 1", 7), ("sum([x, 1, 2]) / len([1, 2])", 3), ("x > 2 ? 1 : 0", 1), ("result = 0\nfor i, v in enumerate([1, 2, 3]):\n    result += i * v", 8), ("if x > 2:\n    result = 'hi'\nelse:\n    result = 'lo'", "hi"), ("signed(255, 8)", -1), ("{'a': 1}['a']", 1), ("list(range(3))[x - 1]", 2)],
)
def test_interpreter(text, want):
    assert interpret.evaluate(text, {"x": 3}) == want


@pytest.mark.parametrize("text", ["__import__('os')", "x.real", "y", "1 / 0", "result2 = 1", "while True:\n    pass", "for i in range(10**9):\n    result = i", "9 ** 999", "", "lambda: 1", "open('x')", "import os", "none"])
def test_interpreter_refuses(text):
    with pytest.raises(FormulaError):
        interpret.evaluate(text, {"x": 3, "none": None})
    assert interpret.rename("a.b + ab", {"a.b": "c"}) == "c + ab"


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab \n.。", max_size=300), st.integers(5, 40))
def test_pieces_keep_the_text_within_the_size(text, size):
    got = splitter.pieces(text, size, size // 4)
    assert all(len(p) <= size for p in got)
    assert set("".join(text.split())) == set("".join("".join(got).split()))
    whole = splitter.pieces(text, size, 0)
    assert "".join("".join(whole).split()) == "".join(text.split())


def test_blocks_over_the_limit_are_split_by_type(spark):
    df = spark.createDataFrame([(1, "a.py", "x = 1\n" * 300), (2, "b.md", "word " * 400), (3, "c", "short"), (4, "d.pdf", None), (5, "e.java", "y" * 1500)], "block_id bigint, file_name string, content string")
    got = {}
    for r in splitter.split_blocks(df).collect():
        got.setdefault(r.block_id, []).append((r.chunk_index, r.total_chunks, len(r.content)))
    assert max(n for *_, n in got[1]) <= 400 and max(n for *_, n in got[2]) <= 800 and got[3] == [(0, 1, 5)] and 4 not in got and got[5] == [(0, 1, 1500)]
    p = splitter.paragraphs(spark.createDataFrame([(1, "a\r\n\r\nb\n \nc " + "d " * 500), (2, None), (3, "  ")], "k int, text string"), "k").collect()
    assert [r.paragraph[:1] for r in p] == ["a", "b", "c", "d"] and max(len(r.paragraph) for r in p) <= 800


def test_tables_over_pages(spark):
    head, row = "Field | Bits | Meaning", "AB_1 | 12 | speed"
    b = [
        (1, "p", "f", 1, "text", "x"), (2, "p", "f", 1, "table", f"{head}\n{row}"), (3, "p", "f", 2, "table", f"{row}\n{row}"), (4, "p", "f", 3, "table", f"{head}\n{row}"), (5, "p", "f", 4, "text", "x"), (6, "p", "f", 4, "table", f"{head}\n{row}"),
        (7, "q", "f", 2, "table", f"{row}\n{row}"), (8, "p", "f", 5, "table", "Name | Unit\nx | y"), (9, "p", "f", None, "table", row), (10, "p", "f", 6, "table", None),
    ]
    df = spark.createDataFrame(b, "block_id bigint, project_id string, file_name string, page_num int, block_type string, content string")
    got = {r.block_id: (r.project_id, r.table_no) for r in splitter.stitch_tables(df).collect()}
    assert got[2] == got[3] == got[4] == ("p", 1) and got[6] == ("p", 2) and got[8] == ("p", 3) and got[7] == ("q", 1) and 9 not in got and got[10] == ("p", 4)


def test_groups_of_blocks(spark):
    base = dict(anchor="AB1.2", names=["X_1"], semantic="s", formulas=1, evidence=20.0, noise=0.0, block_type="text")
    rows = [dict(base, project_id="p", file_name="f", block_id=i, page_num=1, tokens=t) for i, t in ((1, 100), (2, 100), (3, 2000), (4, 10))] + [dict(base, project_id="q", file_name="f", block_id=5, page_num=1, tokens=5)]
    rows += [dict(base, project_id="p", file_name="f", block_id=6, page_num=9, tokens=5, anchor="ZZ9.9", names=[], semantic="t", block_type="table", formulas=0, evidence=0.0, noise=9.0)]
    df = spark.createDataFrame(rows, "project_id string, file_name string, block_id bigint, page_num int, tokens int, anchor string, names array<string>, semantic string, formulas int, evidence double, noise double, block_type string")
    got = {r.block_id: (r.project_id, r.group_no) for r in blocks.group_blocks(df).collect()}
    assert got == {1: ("p", 0), 2: ("p", 0), 3: ("p", 1), 4: ("p", 2), 6: ("p", 3), 5: ("q", 0)}
    assert {r.block_id: r.group_no for r in blocks.budget_split(df).where("project_id = 'p'").collect()} == {1: 0, 2: 0, 3: 1, 4: 2, 6: 2}
    assert {r.block_id: r.group_no for r in blocks.group_blocks(df, scored=False).where("project_id = 'p'").collect()} == {1: 0, 2: 0, 3: 1, 4: 2, 6: 3}
    assert blocks.group_blocks(df.limit(0)).count() == 0


def test_gate_of_odd_files(spark, tmp_path):
    (tmp_path / "latin.txt").write_bytes("Grüße aus dem Hafen, viele schöne Grüße".encode("latin-1"))
    (tmp_path / "nul.txt").write_bytes(b"a text that is long enough \x00 but holds a nul")
    (tmp_path / "noise.txt").write_bytes(bytes([1, 2, 3, 4, 5, 6]) * 50 + b"some words of text here to be long")
    (tmp_path / "blank.txt").write_bytes(b"  \n ")
    (tmp_path / "zip.docx").write_bytes(bytes.fromhex("504B0304") + b"word/other.xml")
    got = {r.path.rsplit("/", 1)[-1]: r.issues for r in files.file_gate(spark, str(tmp_path)).collect()}
    assert got["latin.txt"] == "" and got["nul.txt"] == "authenticity" and got["noise.txt"] == "authenticity"
    assert got["blank.txt"] == "authenticity,readability" and got["zip.docx"] == "authenticity,readability"
    direct = spark.createDataFrame([("e.txt", 0, b""), ("n.txt", 1, None), ("big.pdf", 10**9, b"%PDF-1")], "path string, length bigint, content binary")
    assert [r.issues for r in files.gate(direct).collect()] == ["authenticity,completeness,readability", "authenticity,readability", "size"]


def test_extraction(spark):
    rows = [("公式: x*0.5; range: -5 to 10, bits 3-7",), ("a 12 bit field, min 0 and max 9",), ("1=ON and 2=OFF",), ("nothing",), (None,), ("99999999999999999999 bits",)]
    c = F.col("t")
    (low, high), (start, width) = extract.value_range(c), extract.bits(c)
    got = [tuple(r) for r in spark.createDataFrame(rows, "t string").select(extract.formula(c), low, high, start, width).collect()]
    assert got[0] == ("x*0.5", -5.0, 10.0, 3, 5) and got[1][1:] == (0.0, 9.0, None, 12) and got[3] == got[4] == (None,) * 5 and got[5][4] is None
    assert got[2][0] == "ON, 2=OFF"  # the assignment pattern comes before the mapping pattern
    q = spark.createDataFrame([("What of AB_CD?", "字段名称: ab_cd，起始位 4，位宽: 8 位，分辨率 0.5 deg，范围 -10 deg 到 20 deg。表示航向。"), (None, None), ("q", "位段为 3-9"), ("q", "x * 2 + 1;")], "q string, a string")
    p = [r.asDict() for r in q.select(*[v.alias(k) for k, v in extract.qa_parameters(F.col("q"), F.col("a")).items()]).collect()]
    assert p[0] == {"field_name": "AB_CD", "bit_start": 4, "bit_width": 8, "resolution": 0.5, "range_min": -10.0, "range_max": 20.0, "unit": "deg", "meaning": "航向", "conversion_formula": None}
    assert set(p[1].values()) == {None} and (p[2]["bit_start"], p[2]["bit_width"]) == (3, 7) and p[3]["conversion_formula"] == "x * 2 + 1"
