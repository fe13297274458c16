"""Parameters of fields read out of prose, as Column functions: formula, range, bits, and the fields of a QA answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of formulas, the first that matches wins; their group, or 0 for the whole match.
FORMULAS = [
    (r"(?i)(?:公式|formula|conversion|convert)\s*[:：=]\s*([^\n;，。]+)", 1),
    (r"(?i)([A-Za-z_][A-Za-z0-9_\s]*\s*=\s*[^;\n]+)", 1),
    (r"(?i)(?:value|x|val)\s*(?:\s*[*/+\-]\s*[0-9A-Za-z_().]+)+", 0),
    (r"(?i)((?:-?[0-9]+\s*(?:=|->|→)\s*[A-Za-z_][A-Za-z0-9_./\-]*)(?:\s*(?:,|，|;|；|and)\s*-?[0-9]+\s*(?:=|->|→)\s*[A-Za-z_][A-Za-z0-9_./\-]*)*)", 1),
]
#: Patterns of value ranges and bit positions.
RANGES = [
    r"(?i)(?:range|范围)\s*[:：]?\s*([+\-]?[0-9]+(?:\.[0-9]+)?)\s*(?:to|~|～|—|–|-)\s*([+\-]?[0-9]+(?:\.[0-9]+)?)",
    r"(?i)(?:range|范围)\s*[:：]?\s*\[\s*([+\-]?[0-9]+(?:\.[0-9]+)?)\s*,\s*([+\-]?[0-9]+(?:\.[0-9]+)?)\s*\]",
    r"(?i)(?:min|最小值?)\s*[:：]?\s*([+\-]?[0-9]+(?:\.[0-9]+)?)[^0-9]+(?:max|最大值?)\s*[:：]?\s*([+\-]?[0-9]+(?:\.[0-9]+)?)",
]
BIT_RANGE, BIT_WIDTH = r"([0-9]+)\s*[-~～—–]\s*([0-9]+)", r"(?i)([0-9]+)\s*(?:bits?|位)"
#: Wordings of QA answers.
QA_NAMES = [r"字段名称\s*[:：]?\s*([A-Za-z][A-Za-z0-9_./\-]*)", r"协议中\s*([A-Za-z][A-Za-z0-9_./\-]*)\s*字段", r"(?:^|[^A-Za-z0-9_])([A-Z][A-Z0-9_./\-]{2,})(?:$|[^A-Za-z0-9_])"]
QA_BIT_RANGE, QA_BIT_AT = r"位段(?:为|是)?\s*([0-9]+)\s*[-~～]\s*([0-9]+)", r"位段(?:为|是)?\s*([0-9]+)"
QA_STARTS = [r"(?i)起始位\s*[:：]?\s*([0-9]+)", r"(?i)start(?:_bit)?\s*[:=]?\s*([0-9]+)", QA_BIT_AT]
QA_WIDTHS = [r"(?i)位宽\s*[:：]?\s*([0-9]+)\s*位", r"(?i)占用\s*([0-9]+)\s*位", r"(?i)bit[_\s-]*width\s*[:=]?\s*([0-9]+)"]
QA_RESOLUTION = r"(?i)(?:分辨率|resolution)\s*[:：]?\s*([+\-]?[0-9]+(?:\.[0-9]+)?)\s*([A-Za-z%°/]+)?"
QA_RANGE = r"(?i)(?:范围|range)\s*[:：]?\s*([+\-]?[0-9]+(?:\.[0-9]+)?)\s*([A-Za-z%°/]+)?\s*(?:到|to|~|～|—|–|-)\s*([+\-]?[0-9]+(?:\.[0-9]+)?)\s*([A-Za-z%°/]+)?"
QA_MEANING = r"(?:表示|用于|含义是)\s*([^。；;]+)"


def first_of(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null where there is none or it is empty."""
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), pattern, group), F.lit(""))


def any_of(c: Column, patterns: list[str], group: int = 1) -> Column:
    return F.coalesce(*[first_of(c, p, group) for p in patterns])


def formula(c: Column) -> Column:
    """The first formula a text holds; joined mapping pairs are separated by commas."""
    found = F.coalesce(*[first_of(c, p, g) for p, g in FORMULAS])
    return F.regexp_replace(F.trim(found), r"\s+(?:and|AND)\s+", ", ")


def value_range(c: Column) -> tuple[Column, Column]:
    """The bounds of the first range; both come from the pattern that matches first."""
    low = F.coalesce(*[first_of(c, p, 1) for p in RANGES]).cast("double")
    high = F.coalesce(*[F.when(first_of(c, p, 1).isNotNull(), first_of(c, p, 2)) for p in RANGES]).cast("double")
    return low, high


def bits(c: Column) -> tuple[Column, Column]:
    """(first bit, number of bits): of a bit range, else the width alone."""
    a, z = first_of(c, BIT_RANGE, 1).cast("decimal(38,0)"), first_of(c, BIT_RANGE, 2).cast("decimal(38,0)")
    small = lambda x: x.try_cast("int")
    return small(F.least(a, z)), F.coalesce(small(F.abs(a - z) + 1), F.when(a.isNull(), first_of(c, BIT_WIDTH, 1).try_cast("int")))


def looks_like_formula(c: Column) -> Column:
    t = F.trim(F.coalesce(c, F.lit("")))
    return (t != "") & (
        t.rlike(r"(?i)(?:^|[^A-Za-z0-9_])result\s*=") | t.rlike(r"[0-9]+\s*(?:=|->|→)\s*[A-Za-z_]") | (~t.rlike(r"[一-鿿]") & t.rlike(r"[A-Za-z_][A-Za-z0-9_]*\s*[*+/%-]\s*[0-9A-Za-z_(]"))
    )


def qa_parameters(question: Column, answer: Column) -> dict[str, Column]:
    """Field name, bits, resolution, range, unit, meaning and formula a QA pair states."""
    name = F.coalesce(any_of(answer, QA_NAMES), any_of(question, QA_NAMES))
    a, z = first_of(answer, QA_BIT_RANGE, 1).try_cast("int"), first_of(answer, QA_BIT_RANGE, 2).try_cast("int")
    start, width = any_of(answer, QA_STARTS).try_cast("int"), any_of(answer, QA_WIDTHS).try_cast("int")
    alone = F.when(start.isNotNull() & first_of(answer, QA_BIT_AT, 1).isNotNull(), F.lit(1))
    bare = F.nullif(F.regexp_replace(F.regexp_replace(F.trim(answer), r"^`+|`+$", ""), r"[。；;]+$", ""), F.lit(""))
    return {
        "field_name": F.upper(F.regexp_replace(name, r"^[，。,:：]+|[，。,:：]+$", "")),
        "bit_start": F.coalesce(a, start),
        "bit_width": F.when(a.isNotNull(), F.greatest(F.lit(1), z - a + 1)).otherwise(F.coalesce(width, alone)),
        "resolution": first_of(answer, QA_RESOLUTION, 1).cast("double"),
        "range_min": first_of(answer, QA_RANGE, 1).cast("double"),
        "range_max": first_of(answer, QA_RANGE, 3).cast("double"),
        "unit": F.coalesce(first_of(answer, QA_RANGE, 2), first_of(answer, QA_RANGE, 4), first_of(answer, QA_RESOLUTION, 2)),
        "meaning": F.nullif(F.trim(first_of(answer, QA_MEANING)), F.lit("")),
        "conversion_formula": F.when(looks_like_formula(answer), bare),
    }
