"""Fields resolved, matched and scored against the fields of other messages; every join is on equal keys.

Defined results: null names resolve to nothing; names given twice are answered twice; an empty side gives what the other
side has (``unknown``, ``none``, no candidates)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparloom.functions import similarity as Y

#: Points of a candidate source for a target, and the least it needs.
POINTS = {"ratio": 56.0, "token": 8.0, "family": 12.0, "number": -14.0, "quantity": 32.0, "starts": 10.0, "ends": 6.0}
LEAST, SURE, GAP, FAMILY_GAP = 30.0, 90.0, 12.0, 15.0


def _family(c: Column) -> Column:
    return F.regexp_replace(c, r"_?[0-9]+$", "")


def source_candidates(targets: DataFrame, sources: DataFrame, k: int = 5) -> DataFrame:
    """(package, ordinal, field_name, source, score, rank): candidates of each target field within its package, best first.

    An equal name alone is enough and then the only one; a first candidate far ahead of the second stays alone; else up to
    ``k`` from LEAST points on. ``targets``: package, ordinal, field_name; ``sources``: package, field_name."""
    cores = targets.sparkSession.sparkContext.defaultParallelism
    j = targets.join(sources.select("package", F.col("field_name").alias("source")), "package").repartition(2 * cores, "package", "field_name", "source")
    t, s = F.upper(F.trim("field_name")), F.upper(F.trim(F.element_at(F.split("source", r"\."), -1)))
    j = j.withColumns({"t": t, "s": s}).where("t <> '' and s <> ''").withColumns({"tg": Y.groups_of(F.col("t")), "sg": Y.groups_of(F.col("s")), "tf": _family(F.col("t")), "sf": _family(F.col("s"))})
    tokens = lambda c: F.filter(F.split(c, r"[^A-Z0-9]+"), lambda x: x != "")
    number = lambda c: F.regexp_extract(c, r"([0-9]+)$", 1)
    same = F.col("tf") == F.col("sf")
    points = (
        Y.ratio_once("t", "s") * POINTS["ratio"] + F.size(F.array_intersect(tokens(F.col("t")), tokens(F.col("s")))) * POINTS["token"] + F.when(same, POINTS["family"]).otherwise(0.0)
        + F.when(same & (number(F.col("t")) != "") & (number(F.col("s")) != "") & (number(F.col("t")) != number(F.col("s"))), POINTS["number"]).otherwise(0.0) + F.when(F.arrays_overlap("tg", "sg"), POINTS["quantity"]).otherwise(0.0)
        + F.when(F.startswith(F.col("t"), F.col("s")) | F.startswith(F.col("s"), F.col("t")), POINTS["starts"]).otherwise(0.0) + F.when(F.endswith(F.col("t"), F.col("s")) | F.endswith(F.col("s"), F.col("t")), POINTS["ends"]).otherwise(0.0)
    )
    apart = (F.size("tg") > 0) & (F.size("sg") > 0) & ~F.arrays_overlap("tg", "sg") & (F.arrays_overlap("tg", F.array(*map(F.lit, Y.DIRECTIONAL))) | F.arrays_overlap("sg", F.array(*map(F.lit, Y.DIRECTIONAL))))
    j = j.withColumn("score", F.when(apart, 0.0).when(F.col("t") == F.col("s"), 100.0).otherwise(F.round(points, 4))).where(F.col("score") >= LEAST)
    w = Window.partitionBy("package", "ordinal", "field_name").orderBy(F.desc("score"), "source")
    j = j.withColumns({"rank": F.row_number().over(w), "next": F.lead("score").over(w)})
    all_ = Window.partitionBy("package", "ordinal", "field_name")
    alone = (F.col("rank") == 1) & ((F.col("t") == F.col("s")) | ((F.col("score") >= SURE) & (F.col("score") - F.col("next") >= GAP)) | ((F.col("tf") == F.col("sf")) & (F.col("score") - F.col("next") >= FAMILY_GAP)))
    j = j.withColumn("one", F.max(F.coalesce(alone, F.lit(False))).over(all_))
    return j.where((F.col("rank") == 1) | (~F.col("one") & (F.col("rank") <= k))).select("package", "ordinal", "field_name", "source", "score", "rank")


def schema_fallback(asked: DataFrame, schema: DataFrame, family: str) -> DataFrame:
    """(package, ordinal, field_name, bit_length, level): the schema row of a name of the same package (``message``), else of
    a package of the same family (the first group of the pattern ``family``), else the first of all (``default``), else
    ``none``. Every level is aggregated by its own key before it is joined, so no name is paired with all its rows."""
    key = F.upper(F.trim("field_name"))
    kin = F.regexp_extract("package", family, 1)
    s = schema.select("package", kin.alias("family"), key.alias("key"), F.struct("package", "block_id", "pos", "bit_length").alias("row"))
    best = lambda *by: s.groupBy(*by, "key").agg(F.min("row").alias("row"))
    a = asked.withColumns({"key": key, "family": kin})
    j = a.join(best("package").withColumnRenamed("row", "own"), ["package", "key"], "left").join(best("family").withColumnRenamed("row", "kin"), ["family", "key"], "left").join(best().withColumnRenamed("row", "any"), "key", "left")
    level = F.when(F.col("own").isNotNull(), "message").when(F.col("kin").isNotNull(), "family").when(F.col("any").isNotNull(), "default").otherwise("none")
    return j.select("package", "ordinal", "field_name", F.coalesce("own.bit_length", "kin.bit_length", "any.bit_length").alias("bit_length"), level.alias("level"))


TIERS = ["exact", "name", "normalised", "suffix"]


def resolve(asked: DataFrame, fields: DataFrame) -> DataFrame:
    """(package, ordinal, asked, resolved, how): the field of the package a name stands for. Tiers: the name itself, without
    regard to case, without separators, the end of a name after an underscore; the first tier with a match decides, and
    several matches in it are ``ambiguous``."""
    up = lambda c: F.upper(F.trim(c))
    parts = F.split(up("field_name"), "_")
    ends = F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(parts))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "_"))
    keys = F.array(
        F.struct(F.lit(1).alias("tier"), F.col("field_name").alias("key")), F.struct(F.lit(2).alias("tier"), up("field_name").alias("key")), F.struct(F.lit(3).alias("tier"), Y.squashed(F.col("field_name")).alias("key")),
    )
    more = F.when(F.size(parts) > 1, F.transform(ends, lambda x: F.struct(F.lit(4).alias("tier"), x.alias("key")))).otherwise(F.array().cast("array<struct<tier:int,key:string>>"))
    f = fields.where("field_name is not null").select("package", "field_name", F.explode(F.concat(keys, more)).alias("k")).select("package", "field_name", "k.*").where("key <> ''").distinct()
    q = asked.select("package", "ordinal", "asked", F.explode(F.array(*[F.struct(F.lit(i + 1).alias("tier"), c.alias("key")) for i, c in enumerate((F.col("asked"), up("asked"), Y.squashed(F.col("asked")), up("asked")))])).alias("k")).select("package", "ordinal", "asked", "k.*")
    met = q.join(f, ["package", "tier", "key"]).groupBy("package", "ordinal", "asked", "tier").agg(F.count("*").alias("n"), F.min("field_name").alias("found"))
    best = met.groupBy("package", "ordinal", "asked").agg(F.min(F.struct("tier", "n", "found")).alias("b"))
    how = F.when(F.col("b").isNull(), "unknown").when(F.col("b.n") > 1, "ambiguous").otherwise(F.element_at(F.array(*map(F.lit, TIERS)), F.coalesce("b.tier", F.lit(1))))
    return asked.join(best, ["package", "ordinal", "asked"], "left").select("package", "ordinal", "asked", F.when(F.col("b.n") == 1, F.col("b.found")).alias("resolved"), how.alias("how"))


def block_filter(blocks: DataFrame, names: Column | None, ids: list[int] | None) -> DataFrame:
    """Blocks of the named files and of the given ids; a filter that is not given keeps all."""
    out = blocks if names is None else blocks.where(names)
    return out.where(F.col("block_id").isin(ids)) if ids else out


#: Names a formula may use besides its sources.
LANGUAGE = "x value raw bits abs round int float min max len sum range enumerate list dict signed unsigned clip scale".split()


def filtered_rules(rules: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(package, pos, key, formula, reason): the first reason against each rule, empty where there is none: a source the
    package does not have, no formula, a name that is neither a source nor of the language, an unknown target. ``rules`` as
    ``normal_rules`` gives them; ``sources``, ``targets``: package, key."""
    named = rules.select("package", "pos", F.explode("sources").alias("s")).withColumn("key", Y.squashed(F.element_at(F.split("s", r"\."), -1)))
    lost = named.join(sources.select("package", "key").distinct(), ["package", "key"], "left_anti").select("package", "pos").distinct().withColumn("lost", F.lit(True))
    known = targets.select("package", "key").distinct().withColumn("target_known", F.lit(True))
    words = F.regexp_extract_all("formula", F.lit("([A-Za-z_][A-Za-z0-9_]*)"), 1)
    foreign = F.size(F.filter(words, lambda x: ~x.isin(LANGUAGE) & ~F.array_contains(F.col("sources"), x))) > 0
    reason = F.when(F.col("lost"), "unknown source").when(F.col("formula") == "", "no formula").when(foreign, "undeclared name").when(F.col("target_known").isNull(), "unknown target").otherwise("")
    return rules.join(lost, ["package", "pos"], "left").join(known, ["package", "key"], "left").select("package", "pos", "key", "formula", reason.alias("reason"))


def assembled(rules: DataFrame, targets: DataFrame, alias: str) -> DataFrame:
    """(package, target_field, formula, rule_type, origin): the rules of each package made executable and complete.

    ``rules``: first rules in normal form; ``targets``: package, key, field_name. A rule for an unknown target is left out; ``x``
    stands for the rule's source, which is written with its alias; a rule without a source or with ``result`` in its formula
    becomes 0, and so does every target without a rule."""
    t = targets.groupBy("package", "key").agg(F.min("field_name").alias("target"))
    source = F.get("sources", F.lit(0))
    named = F.regexp_replace("formula", F.lit(r"(^|[^A-Za-z0-9_.])x($|[^A-Za-z0-9_.])"), F.concat(F.lit(f"$1{alias}."), source, F.lit("$2")))
    zero = source.isNull() | F.col("formula").rlike(r"(?i)(?:^|[^A-Za-z0-9_])result(?:$|[^A-Za-z0-9_])")
    j = t.join(rules.select("package", "key", "formula", "sources", F.lit(True).alias("ruled")), ["package", "key"], "left")
    formula = F.when(F.col("ruled").isNull() | zero, "0").otherwise(named)
    return j.select("package", F.col("target").alias("target_field"), formula.alias("formula"), F.when(formula == "0", "const").otherwise("expression").alias("rule_type"), F.when(F.col("ruled"), "rule").otherwise("default").alias("origin"))
