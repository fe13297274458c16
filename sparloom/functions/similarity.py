"""Text similarity and keyword groups."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Quantities by keyword, first match wins.
GROUPS = [
    ("longitude", ["经度", "longitude", "lon"]), ("latitude", ["纬度", "latitude", "lat"]), ("altitude", ["高度", "高程", "海拔", "altitude", "height", "elevation"]), ("pitch", ["俯仰", "pitch"]), ("roll", ["翻滚", "横滚", "roll"]),
    ("yaw", ["偏航", "航向", "yaw", "heading"]), ("speed", ["速度", "speed", "velocity"]), ("direction", ["方向", "bearing", "course"]), ("time", ["时间", "时刻", "飞临时间", "time"]), ("day", ["日", "day"]), ("hour", ["小时", "hour"]), ("minute", ["分钟", "minute", "min"]),
    ("second", ["秒", "second", "sec"]), ("threat_type", ["威胁类型"]), ("threat_form", ["威胁形式"]), ("target_id", ["目标编号", "targetid"]), ("unit_id", ["作战单元编号", "unitid"]), ("quantity", ["数量", "目标数量", "quantity", "count"]), ("name", ["名称", "name"]), ("info", ["信息", "info"]),
    ("fpi", ["fpi"]), ("gpi", ["gpi"]),
]
DIRECTIONAL = ["longitude", "latitude", "altitude", "pitch", "roll", "yaw", "speed", "direction"]
THREAT = ["threat_type", "threat_form"]
#: Rule types.
DIRECT, EXPRESSION, CONST = ["direct", "transcoding", "mapping"], ["expression", "python_expr", "python_block", "formula"], ["const", "constant"]
#: Families of units.
UNIT_FAMILIES = {
    "degree": "angle", "deg": "angle", "min": "angle", "minute": "angle", "rad": "angle", "radian": "angle", "ft": "length", "feet": "length", "m": "length", "meter": "length", "km": "length", "nm": "length",
    "knot": "speed", "kt": "speed", "m/s": "speed", "fps": "speed", "s": "time", "sec": "time", "ms": "time", "label": "categorical", "enum": "categorical",
}


def squashed(c: Column) -> Column:
    """A name in lower case without separators, for lookups."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"[\s_\-./:：，,()\[\]{}]+", "")


def _hits(c: Column) -> list[tuple[str, Column]]:
    low = squashed(c)
    out = []
    for name, words in GROUPS:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out.append((name, hit))
    return out


def group_of(c: Column) -> Column:
    """The first quantity whose keyword a name contains, else null."""
    return F.coalesce(*[F.when(hit, name) for name, hit in _hits(c)])


def groups_of(c: Column) -> Column:
    """All quantities whose keywords a name contains, in their fixed order."""
    return F.filter(F.array(*[F.when(hit, name) for name, hit in _hits(c)]), lambda x: x.isNotNull())


def conflict(a: Column, b: Column) -> Column:
    """Two different directional quantities, or threat type against threat form."""
    both = lambda kinds: a.isin(kinds) & b.isin(kinds)
    return F.coalesce((both(DIRECTIONAL) | both(THREAT)) & (a != b), F.lit(False))


def dimension_score(rule_type: Column, target: Column, target_bits: Column, sources: Column) -> Column:
    """How well the dimension of a target fits those of its sources (array of structs ``grp``, ``bits``): 0 for constants,
    without sources and in conflict; 100 same quantity, 80 same width, 70 an expression over several sources, 60 no quantity
    known, 35 else."""
    any_ = lambda f: F.exists(sources, f)
    return (
        F.when(rule_type.isin(CONST) | (F.size(sources) <= 0), 0.0)
        .when(any_(lambda x: conflict(target, x["grp"])), 0.0)
        .when(any_(lambda x: F.coalesce(x["grp"] == target, F.lit(False))), 100.0)
        .when(any_(lambda x: F.coalesce((x["bits"] == target_bits) & (x["bits"] != 0), F.lit(False))), 80.0)
        .when(rule_type.isin(EXPRESSION) & (F.size(sources) > 1), 70.0)
        .when(target.isNull() & ~any_(lambda x: x["grp"].isNotNull()), 60.0)
        .otherwise(35.0)
    )


def unit_family(c: Column) -> Column:
    """The family of a unit, an unknown unit as itself, a blank one null."""
    u = F.nullif(F.lower(F.trim(c)), F.lit(""))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in UNIT_FAMILIES.items() for x in kv])[u], u)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two texts; null as empty."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype="float64")


#: The same, evaluated once where a filter and a column use it: the planner would copy it into both.
ratio_once = sequence_ratio.asNondeterministic()


def formula_kind(c: Column) -> Column:
    """mapping, conditional, constant or expression, by what the formula holds."""
    t = F.trim(c)
    return (
        F.when(t.rlike(r"-?\d+\s*(?:->|→|=(?!=))\s*[A-Za-z_]"), "mapping").when(t.rlike(r"\?|\bif\b|\bwhen\b"), "conditional").when(t.rlike(r"^[-+]?\d+(?:\.\d+)?$"), "const").when(t.rlike(r"^[A-Za-z_]\w*$"), "direct").when(t.rlike(r"[-+*/%]|\w\("), "expression").otherwise("none")
    )


NUMBER = r"^[+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)$"


def formula_valid(c: Column, rule_type: Column) -> Column:
    """By rule type: a number for constants; else brackets in balance and a number, for direct rules a name or value, for the
    others at least two characters."""
    t = F.trim(F.coalesce(c, F.lit("")))
    n = lambda x: F.char_length(t) - F.char_length(F.replace(t, F.lit(x), F.lit("")))
    number = t.rlike(NUMBER)
    other = F.when(n("(") != n(")"), False).when(number, True).when(rule_type.isin(DIRECT), t.rlike(r"[A-Za-z0-9_\u4e00-\u9fff]")).otherwise(F.char_length(t) >= 2)
    return F.when(t == "", False).when(rule_type.isin(CONST), number).otherwise(other)


def cell_shape(c: Column) -> Column:
    """e empty, m letters and digits, n digits, a letters, o other."""
    t = F.trim(F.coalesce(c, F.lit("")))
    digit, letter = t.rlike(r"[0-9]"), t.rlike(r"[A-Za-z\u4e00-\u9fff]")
    return F.when(t == "", "e").when(digit & letter, "m").when(digit, "n").when(letter, "a").otherwise("o")


def row_shape(cells: Column) -> Column:
    """The shapes of the cells of a row, one letter each."""
    return F.array_join(F.transform(cells, cell_shape), "")


def shape_similarity(a: Column, b: Column) -> Column:
    """Share of cells of equal shape of two rows given by ``row_shape``; missing cells are empty ones."""
    size = F.greatest(F.char_length(a), F.char_length(b), F.lit(1))
    at = lambda s, i: F.when(i <= F.char_length(s), F.substring(s, i, F.lit(1))).otherwise("e")
    return F.size(F.filter(F.sequence(F.lit(1), size), lambda i: at(a, i) == at(b, i))) / size


def blank_ratio(cells: Column) -> Column:
    return F.when(F.size(cells) <= 0, 1.0).otherwise(F.size(F.filter(cells, lambda x: F.trim(x) == "")) / F.size(cells))


def header_row(cells: Column) -> Column:
    """Whether a row looks like a header: two cells with text and a header word, or letters nearly throughout."""
    full = F.filter(F.transform(cells, lambda x: F.lower(F.trim(x))), lambda x: x != "")
    word = F.array_join(full, " ").rlike("field|字段|name|名称|bit|位|desc|描述|length|len|type|unit")
    letters, digits = F.size(F.filter(full, lambda x: x.rlike(r"[a-z\u4e00-\u9fff]"))), F.size(F.filter(full, lambda x: x.rlike(r"[0-9]")))
    return (F.size(full) >= 2) & (word | ((letters >= F.greatest(F.lit(1), F.size(full) - 1)) & (digits <= F.floor(F.size(full) / 2))))
