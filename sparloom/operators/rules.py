"""Conversion rules over messages: conversion, missing targets, candidate joins, rule diffs and scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparloom.functions.formula import FormulaError, compile_formula, compile_mapping, is_mapping, names


@dataclass(frozen=True)
class Rule:
    """A rule for one target field. ``when``: a condition; ``default``: the value where it does not hold (else the field is absent)."""

    target: str
    formula: str
    sources: tuple[str, ...] = ()
    when: str | None = None
    default: str | None = None


def parse_rules(text: str) -> list[Rule]:
    """Rules from lines ``FIELD: formula``; blank lines and lines with # are skipped; the first rule of a target wins."""
    out: dict[str, Rule] = {}
    for line in text.splitlines():
        if line.strip() and not line.lstrip().startswith("#") and ":" in line:
            target, formula = (x.strip() for x in line.split(":", 1))
            if target.upper() not in out:
                src = () if is_mapping(formula) else tuple(sorted(names(formula)))
                out[target.upper()] = Rule(target.upper(), formula, src)
    return list(out.values())


def rule_column(rule: Rule, fields: dict[str, Column]) -> Column:
    """The value a rule gives, null where an input is missing or can't be evaluated."""
    up = {k.upper(): v for k, v in fields.items()}
    if is_mapping(rule.formula):
        if not rule.sources or rule.sources[0].upper() not in up:
            raise FormulaError(f"mapping of {rule.target} has no source")
        value = compile_mapping(rule.formula, up[rule.sources[0].upper()])
    else:
        value = compile_formula(rule.formula, fields)
    if rule.when:
        value = F.when(compile_formula(rule.when, fields), value)
        if rule.default is not None:
            value = F.coalesce(value, compile_formula(rule.default, fields))
    return value


def convert(messages: DataFrame, rules: list[Rule], key: str) -> DataFrame:
    """Wide conversion: one column per target, one projection over the messages, no shuffle and no Python."""
    fields = {c: F.col(f"`{c}`") for c in messages.columns}
    return messages.select(key, *[rule_column(r, fields).alias(r.target) for r in rules])


def conversion_records(messages: DataFrame, rules: list[Rule], key: str) -> DataFrame:
    """Long conversion: (key, target, value, ok, error) per message and rule."""
    fields = {c: F.col(f"`{c}`") for c in messages.columns}
    parts = []
    for r in rules:
        try:
            v = rule_column(r, fields).cast("string")
            missing = F.lit(False)
            for s in r.sources:
                missing = missing | F.col(f"`{next(c for c in messages.columns if c.upper() == s.upper())}`").isNull()
            parts.append(F.struct(F.lit(r.target).alias("target"), v.alias("value"), v.isNotNull().alias("ok"), F.when(v.isNull(), F.when(missing, "missing input").otherwise("not evaluable")).alias("error")))
        except (FormulaError, StopIteration) as e:
            parts.append(F.struct(F.lit(r.target).alias("target"), F.lit(None).cast("string").alias("value"), F.lit(False).alias("ok"), F.lit(f"rule: {e}").alias("error")))
    return messages.select(key, F.explode(F.array(*parts)).alias("r")).select(key, "r.*")


def completed(rules: list[Rule], required: list[str]) -> list[Rule]:
    """A rule 0 for every required target without one."""
    have = {r.target for r in rules}
    return rules + [Rule(t.upper(), "0") for t in required if t.upper() not in have]


def rule_diff(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """added, removed, modified or unchanged per key, with the names of the changed columns."""
    values = [c for c in old.columns if c not in key]
    o = old.select(*key, F.lit(True).alias("in_old"), *[F.col(c).alias(f"o_{c}") for c in values])
    n = new.select(*key, F.lit(True).alias("in_new"), *[F.col(c).alias(f"n_{c}") for c in values])
    changed = F.concat_ws(",", *[F.when(~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}")), c) for c in values])
    j = o.join(n, key, "full_outer")
    both = F.col("in_old").isNotNull() & F.col("in_new").isNotNull()
    kind = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(changed != "", "modified").otherwise("unchanged")
    return j.select(*key, kind.alias("change"), F.when(both, changed).otherwise("").alias("columns"))


def numeric_similarity(a: Column, b: Column) -> Column:
    """1 minus the relative difference, at least 0."""
    return F.greatest(F.lit(0.0), 1 - F.least(F.abs(a - b) / F.greatest(F.abs(b), F.lit(1.0)), F.lit(1.0)))


def weighted(value: Column, weight: Column) -> Column:
    """Weighted mean in percent; the weights count as at least 1."""
    return F.sum(value * weight) / F.greatest(F.sum(weight), F.lit(1.0)) * 100


def conversion_metrics(scores: DataFrame, *by: str) -> DataFrame:
    """Coverage, exact, confident, low-loss and rule-hit rates and their weighted sum. ``scores``: present, exact, correctness, loss, hit."""
    n = F.greatest(F.count("*"), F.lit(1))
    rate = lambda c: F.count_if(c) / n * 100.0
    g = scores.groupBy(*by).agg(rate(F.col("present")).alias("coverage"), rate(F.col("exact")).alias("exact_rate"), rate(F.col("correctness") >= 80).alias("confident"), rate(F.col("loss") <= 20).alias("low_loss"), rate(F.col("hit")).alias("hits"))
    total = F.col("coverage") * 0.35 + F.col("exact_rate") * 0.25 + F.col("confident") * 0.20 + F.col("low_loss") * 0.10 + F.col("hits") * 0.10
    return g.withColumn("conversion_rate", F.round(total, 4))


def aggregate_cases(cases: DataFrame, *by: str) -> DataFrame:
    """Counters, means and rates over case results: correctness, rate, fragments (doubles), exact, incomplete, failed,
    executable, verbose, heuristic (booleans; null is false). A case is perfect at a rate of 100 and a correctness of 99;
    means over complete cases leave those with an incomplete source out; without cases they are 0."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    num = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    complete, perfect = ~yes("incomplete"), (num("rate") >= 100) & (num("correctness") >= 99)
    n, m = F.greatest(F.count("*"), F.lit(1)), F.greatest(F.count_if(complete), F.lit(1))
    mean = lambda c: F.round(F.sum(num(c)) / n, 4)
    mean_of = lambda c: F.round(F.coalesce(F.sum(F.when(complete, num(c))), F.lit(0.0)) / m, 4)
    share = lambda c: F.round(F.count_if(yes(c)) / n * 100.0, 4)
    return cases.groupBy(*by).agg(
        F.count("*").alias("cases"), F.count_if(perfect).alias("perfect"), F.count_if(perfect & complete).alias("perfect_complete"), mean("correctness").alias("avg_correctness"), mean("rate").alias("avg_rate"),
        mean_of("correctness").alias("avg_correctness_complete"), mean_of("rate").alias("avg_rate_complete"), mean("fragments").alias("avg_fragments"), F.count_if(yes("exact")).alias("exact"),
        F.count_if(~complete).alias("incomplete"), F.count_if(complete).alias("complete"), F.count_if(complete & (num("rate") < 100)).alias("model_failures"), F.count_if(complete & yes("failed")).alias("extraction_failures"),
        F.count_if(yes("executable")).alias("executable"), share("executable").alias("executable_rate"), F.count_if(yes("verbose")).alias("verbose"), share("verbose").alias("verbose_rate"), F.count_if(yes("heuristic")).alias("heuristic"), share("heuristic").alias("heuristic_rate"),
    )


#: Points of a rule for a message.
RULE_POINTS = {"code": 30, "any_code": 8, "name": 12, "protocol": 16, "confidence": 5}


def rule_score(rule_code: Column, code: Column, same_name: Column, same_protocol: Column, confidence: Column) -> Column:
    """How well a rule fits a message: its code or none, the field's own name, the target's protocol, its confidence."""
    p = RULE_POINTS
    base = F.when(rule_code == code, p["code"]).when(rule_code.isNull(), p["any_code"]).otherwise(0)
    return base + F.when(same_name, p["name"]).otherwise(0) + F.when(same_protocol, p["protocol"]).otherwise(0) + F.floor(F.coalesce(confidence, F.lit(0.0)) * p["confidence"]).cast("int")
