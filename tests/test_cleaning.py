import re

from pyspark.sql import functions as F

from sparloom.functions import text as T

CASES = ["a\na\nb", "a\n\na\nb", "x\n\nx\n\ny", " a \na\n\nB\n\nB", "", "one", "\n\n\n", "p\nq\n\np\nq\n\nr\nr\nr", "A" * 150 + "\n\n" + "A" * 150 + "b", None, "  \n  \nz\nz"]


def loop(text):
    """Independent statement of the rule: consecutive equal lines, then paragraphs by their first 100 characters."""
    if text is None:
        return None
    lines, kept, changed = text.split("\n"), [], False
    for i, x in enumerate(lines):
        if i and x.strip(" ") and lines[i - 1].strip(" ") == x.strip(" "):
            changed = True
        else:
            kept.append(x)
    seen, out = set(), []
    for p in re.split(r"\n\s*\n", "\n".join(kept)):
        head = p.strip(" ")[:100]
        if head and head in seen:
            changed = True
            continue
        seen.add(head)
        out.append(p)
    return "\n\n".join(out) if changed else text


def test_repeats_equals_loop(spark, small):
    texts = CASES + [r[0] for r in spark.read.parquet(f"{small}/blocks.parquet").select("content").collect()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["r"] for r in df.select("i", T.repeats(F.col("t")).alias("r")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == loop(t), repr(t)[:200]


def test_each_later_table_rule_starts_from_the_line(spark):
    df = spark.createDataFrame([("| a | b\n|---|\n| c ||| d",)], "t string")
    assert df.select(T.table_rows(F.col("t"))).first()[0] == "| a | b |\n|---|\n| c || d"


def test_spacing_order(spark):
    df = spark.createDataFrame([("a\t b  c\n \n \n \nd ",)], "t string")
    assert df.select(T.spacing(F.col("t"))).first()[0] == "a b c\n\n\n\nd"


def test_garbled(spark):
    df = spark.createDataFrame([("x ### y", ), ("plain", ), (None, )], "t string")
    assert [r[0] for r in df.select(T.garbled(F.col("t"))).collect()] == ["x y", "plain", None]
