import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparloom.functions.codec import decode, encode
from sparloom.functions.formula import FormulaError, compile_formula, compile_mapping, names, to_python
from sparloom.operators import rules
from sparloom.operators.rules import Rule


def value(spark, text, **fields):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in fields.items()] or [F.lit(0).alias("_")])
    return df.select(compile_formula(text, {k: F.col(k) for k in fields})).first()[0]


@pytest.mark.parametrize(
    "text, want",
    [("a / b", 3.5), ("a // b", 3), ("-a // b", -4), ("-a % b", 1), ("round(2.5)", 2), ("round(3.5)", 4), ("a > 3 ? 10 : 20", 10), ("a > 3 && b > 3 ? 10 : (b == 2 ? 5 : 6)", 5), ("1 if a < b else 2", 2), ("clip(a, 0, 5)", 5), ("signed(63, 6)", -1), ("int(-2.7)", -2), ("2 ** 3 + abs(-1)", 9), ("7 & 3", 3), ("1 << 4", 16), ("0 < b < 3", True), ("a / 0", None)],
)
def test_formulas_mean_what_python_means(spark, text, want):
    assert value(spark, text, a=7.0, b=2.0) == want


@pytest.mark.parametrize("text", ["__import__('os')", "a.b", "[1]", "lambda: 1", "open('x')", "unknown + 1", "a ? 1", "x = 1", ""])
def test_everything_else_is_refused(text):
    with pytest.raises(FormulaError):
        compile_formula(text, {"a": F.lit(1.0)})


def test_names_and_ternary():
    assert names("max(a, B) ? c : 1") == {"a", "B", "c"}
    assert eval(to_python("1 > 2 ? 3 : 4 > 3 ? 5 : 6")) == 5  # noqa: S307


def test_mapping_exact_before_range(spark):
    df = spark.createDataFrame([(3,), (0,), (9,), (None,)], "x int")
    assert [r[0] for r in df.select(compile_mapping("3=THREE; 0-5=LOW", F.col("x"))).collect()] == ["THREE", "LOW", None, None]


def test_conversion_records_and_defaults(spark):
    m = spark.createDataFrame([(1, 4.0, None), (2, None, 1.0)], "id int, a double, b double")
    rs = [Rule("X", "a * 2", ("a",)), Rule("Y", "a + 1", ("a",), when="b > 0", default="0"), Rule("Z", "nope", ("nope",))]
    got = {(r.id, r.target): (r.value, r.ok, r.error) for r in rules.conversion_records(m, rs, "id").collect()}
    assert got[(1, "X")] == ("8.0", True, None) and got[(2, "X")] == (None, False, "missing input")
    assert got[(1, "Y")][0] == "0.0" and got[(1, "Z")][1] is False
    assert [r.target for r in rules.completed(rs, ["x", "q"])] == ["X", "Y", "Z", "Q"]
    assert rules.parse_rules("A: x + 1\n# c\nA: 2\nB: 1=ON")[0].formula == "x + 1"


def test_rule_diff(spark):
    o = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "k string, v int")
    n = spark.createDataFrame([("b", 3), ("c", None), ("d", 4)], "k string, v int")
    assert {(r.k, r.change, r.columns) for r in rules.rule_diff(o, n, ["k"]).collect()} == {("a", "removed", ""), ("b", "modified", "v"), ("c", "unchanged", ""), ("d", "added", "")}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 33), st.integers(0, 2**33)), min_size=1, max_size=9), st.booleans())
def test_codec_round_trip(pairs, msb):
    widths = [w for w, _ in pairs]
    values = [v % (1 << w) for w, v in pairs]
    assert decode(encode(values, widths, msb), widths, msb) == values


def test_codec_short_buffers():
    assert decode(b"\xff", [4, 8]) == [15, None] and decode(None, [1]) == [None]
