"""Checks on conversion rules: the nine checks of a rule with their severity, a summary, and the four verdicts of a package.

Rules: rule_id, package, mode, formula, unit, bit_length, target_field, source_fields, rule_type, known (a rule of that
field is in the rule base), sample (a value for a trial run).

Defined results
    * a check that does not apply to a rule's mode gives no row; a blank formula fails its syntax check.
    * only failed checks of severity error fail a rule; a trial run without a sample passes with severity info.
    * nulls count as missing; an empty table gives no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sparloom.functions import interpret
from sparloom.functions import similarity as Y
from sparloom.functions.formula import FormulaError

RANGE = r"(-?[0-9]+(?:\.[0-9]+)?)\s*(?:-|~|to)\s*(-?[0-9]+(?:\.[0-9]+)?)\s*(?:=|->|→)\s*[A-Za-z_]"
EXACT = r"-?[0-9]+\s*(?:=|->|→)\s*[A-Za-z_][A-Za-z0-9_./\-]*"


@F.pandas_udf(StringType())
def syntax_error(formula: pd.Series) -> pd.Series:
    """Why a formula is not one expression of the language, else null; each distinct formula is read once per batch."""
    return formula.map({f: interpret.check(f) for f in formula.unique()})


@F.pandas_udf(StringType())
def trial(formula: pd.Series, sample: pd.Series, bits: pd.Series) -> pd.Series:
    """The error of a trial run of a formula with the sample as value, raw and x, else null."""
    out = []
    for f, v, b in zip(formula, sample, bits):
        try:
            width = None if pd.isna(b) else int(b)
            interpret.evaluate(f or "", {"value": v, "raw": v, "x": v, "bits": width})
            out.append(None)
        except FormulaError as e:
            out.append(str(e))
    return pd.Series(out, dtype="object")


def ranges(formula: Column) -> Column:
    """The numeric ranges of a mapping formula, in order."""
    text = F.coalesce(formula, F.lit(""))
    low, high = F.regexp_extract_all(text, F.lit(RANGE), 1), F.regexp_extract_all(text, F.lit(RANGE), 2)
    return F.array_sort(F.transform(F.arrays_zip(low.alias("a"), high.alias("z")), lambda x: F.struct(x["a"].cast("double").alias("a"), x["z"].cast("double").alias("z"))))


def overlapping(sorted_ranges: Column) -> Column:
    """Whether a range ends at or after the start of the next."""
    pairs = F.zip_with(sorted_ranges, F.slice(sorted_ranges, 2, F.greatest(F.size(sorted_ranges), F.lit(1))), lambda x, y: x["z"] >= y["a"])
    return F.exists(pairs, lambda x: F.coalesce(x, F.lit(False)))


def rule_checks(rules: DataFrame) -> DataFrame:
    """(rule_id, check_name, severity, passed): every check that applies to a rule."""
    mapping = F.col("mode") == "mapping"
    r = rules.select("rule_id", "mode", "formula", "unit", "bit_length", "known", "sample", syntax_error("formula").alias("bad"), F.when(~F.coalesce(mapping, F.lit(False)) & F.col("sample").isNotNull(), trial("formula", F.col("sample").cast("double"), F.col("bit_length").cast("double"))).alias("failed"), ranges(F.col("formula")).alias("ranges"))
    text = F.coalesce("formula", F.lit(""))
    needs_bits = text.rlike(r"\b(?:signed|unsigned)\s*\(|\bbits\b")
    row = lambda name, severity, passed: F.struct(F.lit(name).alias("check_name"), (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"), F.coalesce(passed, F.lit(False)).alias("passed"))
    always = [row("ModeSupported", "error", F.col("mode").isin("transcoding", "mapping")), row("KnowledgeBaseAnchor", "warning", F.col("known"))]
    of_mapping = [
        row("MappingSyntax", "error", (F.size("ranges") > 0) | text.rlike(EXACT)),
        row("MappingRangeOverlap", "error", ~overlapping(F.col("ranges"))),
        row("MappingUnitConvention", "warning", F.trim(F.coalesce("unit", F.lit(""))) == ""),
    ]
    syntax = [row("ExpressionSyntax", "error", F.col("bad").isNull())]
    of_expression = [
        row("BitLengthResolved", "error", ~needs_bits | (F.coalesce("bit_length", F.lit(0)) > 0)),
        row("DimensionAnalysis", "warning", F.coalesce(Y.unit_family(F.col("unit")), F.lit("")) != "categorical"),
        row("ExecutionPreview", F.when(F.col("sample").isNull(), "info").otherwise("error"), F.col("failed").isNull()),
    ]
    checks = F.when(mapping, F.array(*always, *of_mapping)).when(F.col("bad").isNotNull(), F.array(*always, *syntax)).otherwise(F.array(*always, *syntax, *of_expression))
    return r.select("rule_id", F.explode(checks).alias("c")).select("rule_id", "c.*")


def rule_verdicts(checks: DataFrame) -> DataFrame:
    """(rule_id, passed, errors, warnings) per rule."""
    bad = lambda s: F.count_if((F.col("severity") == s) & ~F.col("passed"))
    return checks.groupBy("rule_id").agg(bad("error").alias("errors"), bad("warning").alias("warnings")).withColumn("passed", F.col("errors") == 0)


def summary(verdicts: DataFrame) -> DataFrame:
    """Rules in all, passed, failed, and passed with warnings."""
    return verdicts.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.count_if(F.col("warnings") > 0).alias("warning"))


def field_matches(asked: DataFrame, specs: DataFrame) -> DataFrame:
    """``asked`` (ask, protocol, field_name, path) with ``n``, how many fields of the definitions it stands for, and ``placed``,
    whether a single one has a path and a width: by path, else by any of the field's names. ``specs``: protocol, field_name,
    actual_field, label, path, bit_length."""
    up = lambda c: F.upper(F.trim(F.coalesce(c, F.lit(""))))
    last = F.element_at(F.split("path", "/"), -1)
    s = specs.select("protocol", up(F.col("path")).alias("k_path"), F.array_distinct(F.filter(F.array(*[up(F.col(c)) for c in ("actual_field", "field_name", "label")], up(last)), lambda x: x != "")).alias("k_names"), (F.col("path").isNotNull() & F.col("bit_length").isNotNull()).cast("int").alias("fit"))
    name = F.when(F.contains("field_name", F.lit(".")), F.expr("substring(field_name, instr(field_name, '.') + 1)")).otherwise(F.col("field_name"))
    a = asked.select("ask", "protocol", up(name).alias("q_name"), up(F.col("path")).alias("q_path"))
    by_path = a.where("q_path <> ''").join(s.where("k_path <> ''").select("protocol", F.col("k_path").alias("q_path"), "fit"), ["protocol", "q_path"]).groupBy("ask").agg(F.count("*").alias("n_path"), F.max("fit").alias("f_path"))
    by_name = a.where("q_name <> ''").join(s.select("protocol", F.explode("k_names").alias("q_name"), "fit"), ["protocol", "q_name"]).groupBy("ask").agg(F.count("*").alias("n_name"), F.max("fit").alias("f_name"))
    j = asked.join(by_path, "ask", "left").join(by_name, "ask", "left")
    n = F.coalesce("n_path", "n_name", F.lit(0))
    return j.select(*asked.columns, n.alias("n"), ((n == 1) & (F.coalesce("f_path", "f_name", F.lit(0)) == 1)).alias("placed"))


def package_verdicts(packages: DataFrame, rules: DataFrame, specs: DataFrame) -> DataFrame:
    """(package, field_legality, position_accuracy, conversion_logic, protocol_compliance) per package.

    ``packages``: package, version, project_name, name, mode, target_protocol, sources ARRAY<STRUCT<alias, protocol>>;
    ``rules``: package, pos, target_field, formula, rule_type, source_fields ARRAY<STRING> (``alias.field`` or a bare field of
    the only source); ``specs``: see ``field_matches``. A package without rules is legal, placed and logical."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    p = packages.select("package", "target_protocol", F.coalesce("sources", F.array().cast("array<struct<alias:string,protocol:string>>")).alias("sources"), "version", "project_name", "name", "mode")
    aliases = F.transform("sources", lambda x: F.trim(x["alias"]))
    sound = (
        F.col("version").isNotNull() & ~blank("project_name") & ~blank("name") & F.coalesce(F.col("mode").isin("simple", "joint"), F.lit(False)) & ~blank("target_protocol") & (F.size("sources") > 0)
        & (F.size(F.array_distinct(aliases)) == F.size("sources")) & ~F.exists("sources", lambda x: blank(x["alias"]) | blank(x["protocol"]))
    )
    r = rules.withColumn("rule_type", F.lower(F.trim("rule_type"))).join(p.select("package", "target_protocol", "sources"), "package")
    target = r.select("package", F.struct("package", "pos", F.lit(-1).alias("i")).alias("ask"), F.col("target_protocol").alias("protocol"), F.trim("target_field").alias("field_name"), F.lit(None).cast("string").alias("path"))
    each = r.select("package", "pos", "sources", F.posexplode("source_fields").alias("i", "ref")).where(~blank("ref"))
    dot = F.instr("ref", ".")
    alias = F.when(dot > 0, F.trim(F.expr("substring(ref, 1, instr(ref, '.') - 1)")))
    proto = F.when(dot > 0, F.filter("sources", lambda x: F.trim(x["alias"]) == alias)[0]["protocol"]).when(F.size("sources") == 1, F.col("sources")[0]["protocol"])
    source = each.select("package", F.struct("package", "pos", "i").alias("ask"), proto.alias("protocol"), F.when(dot > 0, F.trim(F.expr("substring(ref, instr(ref, '.') + 1)"))).otherwise(F.trim("ref")).alias("field_name"), F.lit(None).cast("string").alias("path"))
    met = field_matches(target.unionByName(source), specs).groupBy("package").agg(F.min((F.col("n") == 1).cast("int")).alias("legal"), F.min(F.col("placed").cast("int")).alias("placed"))
    number, formula, n = F.trim("formula").rlike(Y.NUMBER), F.trim("formula"), F.size(F.filter("source_fields", lambda x: ~blank(x)))
    logic = (
        F.coalesce(F.col("rule_type").isin("const", "direct", "expression"), F.lit(False)) & ~F.coalesce(formula.rlike(r"(?i)\bresult\b"), F.lit(False))
        & F.when(F.col("rule_type") == "const", number).when(F.col("rule_type") == "direct", (n == 1) & (formula == F.trim(F.col("source_fields")[0]))).otherwise((n > 0) | number)
    )
    full = ~(blank("target_field") | blank("formula") | blank("rule_type"))
    per = r.groupBy("package").agg(F.min(F.coalesce(logic, F.lit(False)).cast("int")).alias("logic"), F.min(full.cast("int")).alias("full"), F.count("*").alias("n"), F.count_distinct(F.trim("target_field")).alias("d"))
    j = p.select("package", sound.alias("sound")).join(met, "package", "left").join(per, "package", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(1)) == 1
    return j.select("package", yes("legal").alias("field_legality"), yes("placed").alias("position_accuracy"), yes("logic").alias("conversion_logic"), (F.col("sound") & yes("full") & (F.coalesce("n", F.lit(0)) == F.coalesce("d", F.lit(0)))).alias("protocol_compliance"))
