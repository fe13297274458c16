"""Conversion rules judged against the fields of their source and target definitions, for many packages at once.

Inputs, one row each:
    * fields: package, ordinal, protocol, file_name, field_name, path, bit_length, default_value
    * rules: package, pos, target_field, formula, source_fields ARRAY<STRING>, rule_type (null: inferred)

Defined results
    * names are compared in lower case without separators; fields with an empty name and rules without a target are left out.
    * of several rules for one target the first by ``pos`` counts and is marked; rules for unknown targets are rows of their own.
    * ties among candidates keep the order of the fields; a package without rules or fields gives what the other side has.
    * the pairs of a package's targets and sources are compared in blocks of the sources, so that a large package is spread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparloom.functions import similarity as Y

BLOCKS = 8
#: Shares of the four accuracies in the overall score.
SHARES = {"field_match": 0.30, "semantic": 0.25, "structure": 0.20, "dimension": 0.25}
#: The layout of the text by which two fields are compared.
LABELS = {"field_name": "字段名", "path": "路径", "protocol": "协议", "file_name": "文件", "bit_length": "位宽", "default_value": "默认值", "grp": "语义组"}


def field_specs(fields: DataFrame) -> DataFrame:
    """Fields with their lookup name ``key``, quantity ``grp`` and comparison text."""
    f = fields.withColumns({"key": Y.squashed(F.col("field_name")), "grp": Y.group_of(F.col("field_name"))}).where("key <> ''")
    return f.withColumn("text", F.concat_ws(" | ", *[F.concat(F.lit(f"{label}:"), F.col(c).cast("string")) for c, label in LABELS.items()]))


def normal_rules(rules: DataFrame) -> DataFrame:
    """Rules with trimmed formula, lookup name of the target and a rule type, inferred where none of the known ones is given."""
    formula = F.trim(F.coalesce("formula", F.lit("")))
    sources = F.filter(F.transform(F.coalesce("source_fields", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    given = F.lower(F.trim(F.coalesce("rule_type", F.lit(""))))
    last = F.trim(F.element_at(F.split(F.col("sources")[0], r"\."), -1))
    kind = (
        F.when(F.col("given").isin(*Y.DIRECT, *Y.EXPRESSION, *Y.CONST), F.col("given"))
        .when((F.size("sources") == 0) & F.col("formula").rlike(Y.NUMBER), "const").when(F.col("formula") == "0", "const")
        .when((F.size("sources") == 1) & (last != "") & F.contains(F.col("formula"), last), "direct")
        .otherwise("expression")
    )
    r = rules.select("package", "pos", F.trim("target_field").alias("target_field"), formula.alias("formula"), sources.alias("sources"), given.alias("given"))
    return r.where("target_field <> ''").withColumns({"rule_type": kind, "key": Y.squashed(F.col("target_field"))}).drop("given")


def first_rules(rules: DataFrame) -> DataFrame:
    """The first rule of each target, and whether there are more (duplicate targets)."""
    w = Window.partitionBy("package", "key")
    return rules.withColumns({"rn": F.row_number().over(w.orderBy("pos")), "repeated": F.count("*").over(w) > 1}).where("rn = 1").drop("rn")


def resolved_sources(rules: DataFrame, sources: DataFrame) -> DataFrame:
    """(package, key, found): the source fields each rule's names stand for, each field once, in the order of the names."""
    named = rules.select("package", F.col("key").alias("target"), F.posexplode("sources").alias("at", "name")).withColumn("key", Y.squashed(F.element_at(F.split("name", r"\."), -1))).where("key <> ''")
    met = named.join(sources.select("package", "key", "ordinal", "protocol", "path", "field_name", "grp", "bit_length"), ["package", "key"])
    once = met.groupBy("package", "target", "key", "protocol", "path").agg(F.min(F.struct("at", "ordinal", "field_name", "grp", F.col("bit_length").alias("bits"))).alias("s"))
    got = F.array_sort(F.collect_list(F.struct("s.at", "s.ordinal", "s.field_name", "key", "s.grp", "s.bits")))
    return once.groupBy("package", F.col("target")).agg(got.alias("found")).withColumnRenamed("target", "key")


def candidates(targets: DataFrame, sources: DataFrame, k: int, threshold: float) -> DataFrame:
    """(package, key, path, near): the ``k`` sources most like each target, from ``threshold`` on, best first."""
    spread = sources.select("package", F.col("ordinal").alias("s_ordinal"), F.col("key").alias("s_key"), F.col("field_name").alias("s_name"), F.col("text").alias("s_text"), F.pmod(F.xxhash64("path", "field_name"), F.lit(BLOCKS)).cast("int").alias("block"))
    asked = targets.select("package", "key", "path", "ordinal", "text").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
    # A pair costs far more than its two texts weigh: pairs go evenly over all cores, however small they are.
    cores = targets.sparkSession.sparkContext.defaultParallelism
    pairs = asked.join(spread, ["package", "block"]).repartition(2 * cores, "path", "s_ordinal", "package")
    scored = pairs.withColumn("raw", Y.ratio_once("text", "s_text")).where(F.col("raw") >= threshold).withColumn("score", F.round("raw", 4))
    w = Window.partitionBy("package", "key", "path", "ordinal").orderBy(F.desc("score"), "s_ordinal")
    best = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(1, k))
    return best.groupBy("package", "key", "path", "ordinal").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "s_key", "s_name"))).alias("near"))


def evaluate(targets: DataFrame, sources: DataFrame, rules: DataFrame, k: int = 10, coarse: float = 0.55, fine: float = 0.75) -> DataFrame:
    """One row per target field, and per rule with an unknown target: status, four scores, candidates."""
    t, s, r = field_specs(targets), field_specs(sources), first_rules(normal_rules(rules))
    j = t.join(r.drop("target_field").withColumn("has_rule", F.lit(True)), ["package", "key"], "left").join(resolved_sources(r, s), ["package", "key"], "left").join(candidates(t, s, k, coarse), ["package", "key", "path", "ordinal"], "left")
    none = F.array().cast("array<struct<at:int,ordinal:int,field_name:string,key:string,grp:string,bits:int>>")
    far = F.array().cast("array<struct<rank:int,score:double,s_key:string,s_name:string>>")
    j = j.withColumns({"found": F.coalesce("found", none), "near": F.coalesce("near", far), "ruled": F.coalesce("has_rule", F.lit(False))})
    const = F.col("rule_type").isin(Y.CONST)
    valid = Y.formula_valid(F.col("formula"), F.col("rule_type"))
    declared = F.array_distinct(F.transform("found", lambda x: x["key"]))
    matched = F.filter("near", lambda x: (x["score"] >= fine) & F.array_contains(F.col("declared"), x["s_key"]))
    j = j.withColumns({"valid": F.coalesce(valid, F.lit(False)), "declared": declared}).withColumn("matched", matched)
    n, m = F.size("declared"), F.size("matched")
    known_type = F.col("rule_type").isin(*Y.DIRECT, *Y.EXPRESSION, *Y.CONST)
    structure = 100.0 - F.when(F.col("repeated"), 25.0).otherwise(0.0) - F.when(F.col("valid"), 0.0).otherwise(20.0) - F.when(~const & (F.size("found") == 0), 20.0).otherwise(0.0) - F.when(known_type, 0.0).otherwise(15.0)
    total = F.aggregate("matched", F.lit(0.0), lambda acc, x: acc + x["score"])
    scored = F.col("ruled") & ~const
    j = j.withColumns({
        "structure": F.when(F.col("ruled"), F.greatest(F.lit(0.0), structure)).otherwise(100.0),
        "semantic": F.when(scored, F.round(total / F.greatest(m, F.lit(1)) * 100, 4)).otherwise(0.0),
        "match_pass": scored & (n > 0) & (n == m) & F.col("valid"),
        "dimension": F.when(F.col("ruled"), Y.dimension_score(F.col("rule_type"), F.col("grp"), F.col("bit_length"), F.transform("found", lambda x: F.struct(x["grp"].alias("grp"), x["bits"].alias("bits"))))).otherwise(0.0),
    })
    j = j.withColumn("field_match", F.when(F.col("match_pass"), 100.0).when(scored, F.round(m / F.greatest(n, F.lit(1)) * 100, 4)).otherwise(0.0))
    passed = F.col("match_pass") & (F.col("semantic") >= fine * 100) & (F.col("dimension") >= 60) & (F.col("structure") >= 80)
    status = F.when(~F.col("ruled"), "missing_rule").when(passed, "pass").when(const & (F.col("formula") == "0"), "fallback_zero").otherwise("fail")
    status = F.when(F.col("ruled") & const & ~(F.col("formula") == "0"), "fail").otherwise(status)
    names = lambda c, f: F.transform(c, lambda x: x[f])
    rows = j.select(
        "package", "field_name", F.col("protocol").alias("target_protocol"), "rule_type", "formula", status.alias("status"), F.size("near").alias("candidate_count"), names("near", "s_name").alias("candidates"), names("near", "score").alias("similarities"),
        names("found", "field_name").alias("resolved"), "field_match", "semantic", "structure", "dimension", F.coalesce("repeated", F.lit(False)).alias("repeated"), F.col("valid").alias("formula_valid"), "ruled",
    )
    return rows.unionByName(unknown_targets(r, t), allowMissingColumns=True)


def unknown_targets(rules: DataFrame, targets: DataFrame) -> DataFrame:
    """Rules whose target is no field of the target definitions, with zero scores."""
    zero = {c: F.lit(0.0) for c in ("field_match", "semantic", "structure", "dimension")}
    lost = rules.join(targets.select("package", "key").distinct(), ["package", "key"], "left_anti")
    return lost.select("package", F.col("target_field").alias("field_name"), "rule_type", "formula", F.lit("invalid_target").alias("status"), F.lit(0).alias("candidate_count"), "repeated", F.lit(False).alias("formula_valid"), F.lit(True).alias("ruled"), *[v.alias(c) for c, v in zero.items()])


def scores(results: DataFrame) -> DataFrame:
    """One row per package: four mean scores over all rows, their weighted sum, and rates over the target fields."""
    known = F.col("status") != "invalid_target"
    n = F.greatest(F.count_if(known), F.lit(1))
    mean = lambda c: F.round(F.sum(c) / F.greatest(F.count("*"), F.lit(1)), 4).alias(c)
    rate = lambda c: F.round(F.count_if(c) / n * 100, 4)
    g = results.groupBy("package").agg(
        *[mean(c) for c in SHARES], F.count_if(known).alias("target_fields"), rate(known & F.col("ruled")).alias("coverage_rate"), rate(F.col("status") == "pass").alias("conversion_rate"), rate(known & (F.col("candidate_count") > 0)).alias("recall_rate"),
        F.count_if(known & F.col("ruled") & ~(F.col("rule_type").isin(Y.CONST) & (F.col("formula") == "0"))).alias("non_zero_rules"), F.count_if(F.col("status") == "fallback_zero").alias("zero_rules"),
        F.count_if(F.col("repeated")).alias("repeated_targets"), F.count_if((F.col("status") == "invalid_target") | ((F.col("status") == "fail") & ~F.col("formula_valid"))).alias("invalid_rules"),
    )
    overall = F.lit(0.0)
    for c, share in SHARES.items():
        overall = overall + F.col(c) * share
    return g.withColumn("overall", F.round(overall, 4))
