"""Features of blocks as Column functions: anchors, field names, mapping pairs, noise, evidence, semantic type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the features look for. Message anchors are one or two capitals, a number, a dot and a number.
ANCHOR = r"(?i)\b([A-Z]{1,2}\d+\.\d+[A-Z]?\d*)\b"
FIELD_NAME = r"\b([A-Z][A-Z0-9_./\-]{2,})\b"
MAPPING_PAIR = r"-?\d+\s*(?:=|->|→)\s*[A-Za-z_][A-Za-z0-9_./\-]*"
FORMULA_HINT = r"(?i)(?:formula|公式|convert|转换|resolution|分辨率|value\s*[\*/+\-])"
RULE_EVIDENCE = r"(?i)(?:formula|公式|mapping|映射|range|范围|resolution|分辨率|bit|位|value\s*[\*/+\-]|->|→|=)"
FURNITURE = r"(?i)(?:^table\s+\d|^figure\s+\d|^note\b|^附注|continued|page\s+\d+|保密|密级|页眉|页脚)"
SEPARATOR = r"^[=\-_.|/\\\s]{4,}$"
NOT_A_NAME = ["FIELD", "FIELDS", "VALUE", "VALUES", "TABLE", "TABLES"]
SEMANTIC = [
    ("field_definition", ["字段", "field", "位宽", "bit", "范围", "range", "单位", "unit"]),
    ("conversion_rule", ["公式", "formula", "计算", "calculate", "转换", "convert", "映射", "map"]),
    ("protocol_description", ["协议", "protocol", "概述", "overview", "用途", "purpose", "介绍", "introduction"]),
]


def anchor(c: Column, *first: Column) -> Column:
    """The first message anchor in upper case, of the columns ``first`` before the text; else empty."""
    return F.upper(F.coalesce(*[F.nullif(F.regexp_extract(x, ANCHOR, 1), F.lit("")) for x in (*first, c)], F.lit("")))


def plausible_name(t: Column) -> Column:
    return (F.char_length(t) >= 3) & ~t.isin(NOT_A_NAME) & (t.contains("_") | t.rlike(r"^[A-Z]{1,2}\d+\.\d+[A-Z]?\d*$") | t.rlike(r"^[A-Z0-9./\-]{4,}$"))


def field_names(text: Column, fields: Column) -> Column:
    """Distinct plausible names of the extracted fields and of the text read in upper case, sorted."""
    own = F.transform(F.coalesce(fields, F.array().cast("array<struct<field_name:string>>")) if fields is None else F.coalesce(fields.getField("field_name"), F.array().cast("array<string>")), lambda x: F.upper(F.trim(F.coalesce(x, F.lit("")))))
    seen = F.regexp_extract_all(F.upper(F.coalesce(text, F.lit(""))), F.lit(FIELD_NAME), 1)
    return F.array_sort(F.array_distinct(F.filter(F.concat(own, seen), plausible_name)))


def mapping_pairs(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(MAPPING_PAIR))


def noise_penalty(text: Column, kind: Column, has_fields: Column) -> Column:
    """How noisy a block looks; a blank one is 18."""
    t = F.trim(F.coalesce(text, F.lit("")))
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    n = F.greatest(F.size(lines), F.lit(1))
    share = lambda f: F.size(F.filter(lines, f))
    chars = F.greatest(F.char_length(t), F.lit(1))
    marks = F.char_length(F.regexp_replace(t, r"[\p{L}\p{N}\s]", ""))
    alnum = F.char_length(F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))
    separators, furniture = share(lambda x: x.rlike(SEPARATOR)), share(lambda x: x.rlike(FURNITURE))
    terms = [
        F.when(kind.isin("image", "figure"), 6.0),
        F.when((n >= 4) & (share(lambda x: F.char_length(x) <= 6) / n >= 0.55), 5.0),
        F.least(F.lit(4.0), separators * 1.5),
        F.least(F.lit(6.0), furniture * 2.0),
        F.when(marks / chars >= 0.32, 3.0),
        F.when(alnum / chars <= 0.38, 2.0),
        F.when((F.char_length(t) < 36) & ~t.rlike(RULE_EVIDENCE), 4.0),
        F.when(~has_fields & (mapping_pairs(t) == 0) & ~t.rlike(FORMULA_HINT), 2.0),
    ]
    total = F.lit(0.0)
    for x in terms:
        total = total + F.coalesce(x, F.lit(0.0))
    return F.when(t == "", F.lit(18.0)).otherwise(F.round(total, 4))


def evidence_score(text, kind, anchored, names, formulas, pairs, covered) -> Column:
    """How much evidence for conversion rules a block holds."""
    total = (
        F.when(anchored, 12.0).otherwise(0.0) + F.least(F.lit(18.0), names * 1.8) + F.least(F.lit(16.0), formulas * 3.0) + F.least(F.lit(16.0), pairs * 2.0) + F.least(F.lit(10.0), covered * 1.5)
        + F.when(F.coalesce(text, F.lit("")).rlike(RULE_EVIDENCE), 6.0).otherwise(0.0) + F.when((kind == "table") & ((pairs > 0) | (formulas > 0)), 4.0).otherwise(0.0)
    )
    return F.round(total, 4)


def semantic_type(text: Column, kind: Column) -> Column:
    """By block type, else by the first group of words the text contains."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.when(kind == "table", "table_data").when(kind == "code", "code_example")
    for name, words in SEMANTIC:
        any_of = F.lit(False)
        for w in words:
            any_of = any_of | low.contains(w)
        out = out.when(any_of, name)
    return out.otherwise("general_content")


def field_counts(fields: Column) -> dict[str, Column]:
    """Counts over the extracted fields of a block: formulas, fields with bits, fields with a range, mapping pairs."""
    f = F.coalesce(fields, F.expr("cast(array() as array<struct<field_name:string,bit_start:int,bit_length:int,meaning:string,formula:string,range_min:double,range_max:double>>)"))
    n = lambda cond: F.size(F.filter(f, cond))
    return {
        "formulas": n(lambda x: F.trim(F.coalesce(x["formula"], F.lit(""))) != ""),
        "bits": n(lambda x: x["bit_start"].isNotNull() | x["bit_length"].isNotNull()),
        "ranges": n(lambda x: x["range_min"].isNotNull() | x["range_max"].isNotNull()),
        "pairs": F.aggregate(f, F.lit(0), lambda acc, x: acc + mapping_pairs(x["formula"]) + mapping_pairs(x["meaning"])),
    }
