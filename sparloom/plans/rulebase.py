"""Queries on fields and rules taken from the blocks' extracted fields: resolution, checks, evaluation, extraction
(JOIN-09..12, VAL-08..10, MSG-13, AGG-08/09/16, FN-17..20, FN-23, SPL-07/12/14, WIN-08).

A file is a package: fields of its tables are targets, all other fields are sources. Every field with a formula is a rule
for its own name; the source of a target is the source field of the same place in the file.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparloom.functions import extract as X
from sparloom.functions import similarity as Y
from sparloom.operators import evaluation, rulechecks, splitter
from sparloom.operators.cleaning import once
from sparloom.session import cut
from sparloom.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _fields(s, d):
    """(package, ordinal, target, place, block_id, pos, f.*): the fields of each file in order; place among its kind."""
    f = once(table(s, d, "blocks")).select("file_name", "block_id", "block_type", "protocol_fields").select("file_name", "block_id", (F.col("block_type") == "table").alias("target"), F.posexplode("protocol_fields").alias("pos", "f")).select("*", "f.*").where("field_name is not null").drop("f")
    order = W.partitionBy("file_name").orderBy("block_id", "pos")
    place = W.partitionBy("file_name", "target").orderBy("block_id", "pos")
    return f.withColumns({"ordinal": F.row_number().over(order), "place": F.row_number().over(place)}).withColumnRenamed("file_name", "package")


def _specs(f):
    return f.select("package", "ordinal", F.col("package").alias("protocol"), F.col("package").alias("file_name"), "field_name", F.concat_ws("/", "package", "field_name").alias("path"), "bit_length", F.lit(None).cast("string").alias("default_value"), "target", "place")


def _rules(f):
    source = f.where("not target").select("package", "place", F.col("field_name").alias("s_name"))
    r = f.where("formula is not null").join(source, ["package", "place"], "left")
    name = F.when(F.col("target"), F.col("s_name")).otherwise(F.col("field_name"))
    return r.select("package", F.col("ordinal").alias("pos"), F.col("field_name").alias("target_field"), "formula", F.when(name.isNull(), F.array().cast("array<string>")).otherwise(F.array(name)).alias("source_fields"), F.lit(None).cast("string").alias("rule_type"))


_SQ = r"regexp_replace(lower(trim({})), '[\s_\-./:：，,()\[\]{{}}]+', '', 'g')"
_GRP = lambda t: "case " + " ".join("when " + " or ".join(f"contains({t}, '{w}')" for w in words) + f" then '{g}'" for g, words in Y.GROUPS) + " end"
_F = f"""with b as (select distinct block_id, file_name, block_type from blocks), pf as (select block_id, any_value(protocol_fields) as pf from blocks group by 1),
x as (select block_id, file_name as package, block_type = 'table' as target, generate_subscripts(pf, 1) - 1 as pos, unnest(pf) as f from b join pf using (block_id)),
fld as (select *, row_number() over (partition by package order by block_id, pos)::int as ordinal, row_number() over (partition by package, target order by block_id, pos)::int as place, {_SQ.format("field_name")} as key, {_GRP(_SQ.format("field_name"))} as grp from
  (select block_id, package, target, pos, f.field_name as field_name, f.formula as formula, f.bit_length as bit_length, f.bit_start as bit_start, f.meaning as meaning, f.range_min as range_min from x) where field_name is not null),
r0 as (select a.package, a.ordinal as pos, a.field_name as target_field, trim(a.formula) as formula, a.key, case when a.target then s.field_name else a.field_name end as source, case when a.target then s.key else a.key end as skey from fld a left join fld s on s.package = a.package and s.place = a.place and not s.target where a.formula is not null),
r1 as (select *, case when source is null and regexp_full_match(formula, '[+-]?([0-9]+([.][0-9]+)?|[.][0-9]+)') then 'const' when formula = '0' then 'const' when source is not null and contains(formula, source) then 'direct' else 'expression' end as rule_type, row_number() over (partition by package, key order by pos) as rn, count(*) over (partition by package, key) > 1 as repeated from r0),
ru as (select * from r1 where rn = 1)
"""


@query(_F + "select ru.package, ru.key, string_agg(distinct s.field_name, ',' order by s.field_name) as found from ru join fld s on s.package = ru.package and s.key = ru.skey and not s.target group by 1, 2")
def join_10_resolved_sources(s, d):
    """JOIN-10: the source fields a rule's declared names stand for."""
    f = _fields(s, d)
    r = evaluation.first_rules(evaluation.normal_rules(_rules(f)))
    got = evaluation.resolved_sources(r, evaluation.field_specs(_specs(f.where("not target"))))
    return got.select("package", "key", F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["field_name"]))), ",").alias("found"))


@query(_F + "select package, target_field as field_name, rule_type, formula, 'invalid_target' as status from ru where not exists (select 1 from fld t where t.package = ru.package and t.key = ru.key and t.target)")
def join_11_unknown_targets(s, d):
    """JOIN-11: rules whose target the target definitions don't have."""
    f = _fields(s, d)
    r = evaluation.first_rules(evaluation.normal_rules(_rules(f)))
    return evaluation.unknown_targets(r, evaluation.field_specs(_specs(f.where("target")))).select("package", "field_name", "rule_type", "formula", "status")


@query(_F + "select package, key, count(*)::bigint as rules, min(pos)::int as kept from r1 group by 1, 2 having count(*) > 1")
def agg_09_duplicate_targets(s, d):
    """AGG-09: targets with several rules; the first by position is kept."""
    r = evaluation.normal_rules(_rules(_fields(s, d)))
    return r.groupBy("package", "key").agg(F.count("*").alias("rules"), F.min("pos").alias("kept")).where("rules > 1")


def _evaluated(s, d):
    f = cut(_fields(s, d))
    return evaluation.evaluate(_specs(f.where("target")), _specs(f.where("not target")), _rules(f))


@query()
def join_09_candidates(s, d):
    """JOIN-09: the source fields most like each target field."""
    f = _fields(s, d)
    specs = evaluation.field_specs(_specs(f))
    near = evaluation.candidates(specs.where("target"), specs.where("not target"), 10, 0.55)
    return near.select("package", "path", "ordinal", F.explode("near").alias("n")).select("package", "path", "ordinal", "n.rank", "n.score", F.col("n.s_name").alias("candidate"))


@query()
def msg_13_evaluation(s, d):
    """MSG-13: one row per target field, and per rule with an unknown target."""
    return _evaluated(s, d).select("package", "field_name", "rule_type", "formula", "status", "candidate_count", F.array_join("candidates", ",").alias("candidates"), F.array_join("resolved", ",").alias("resolved"), "field_match", "semantic", "structure", "dimension")


@query()
def agg_08_scores(s, d):
    """AGG-08: mean scores, overall score and rates per package."""
    return evaluation.scores(_evaluated(s, d))


@query(_F + """, j as (select t.package, t.field_name, t.ordinal, t.grp, t.bit_length, coalesce(ru.rule_type, 'expression') as rule_type, list(s.grp) filter (s.key is not null) as gs, list(s.bit_length) filter (s.key is not null) as bs, count(s.key) as n, count(s.grp) as ng,
  coalesce(bool_or(s.grp <> t.grp and ((s.grp in ('longitude','latitude','altitude','pitch','roll','yaw','speed','direction') and t.grp in ('longitude','latitude','altitude','pitch','roll','yaw','speed','direction')) or (s.grp in ('threat_type','threat_form') and t.grp in ('threat_type','threat_form')))), false) as bad
  from fld t left join ru on ru.package = t.package and ru.key = t.key left join (select distinct package, key, field_name, grp, bit_length from (select *, row_number() over (partition by package, key, field_name order by ordinal) as q from fld where not target) where q = 1) s on s.package = t.package and s.key = ru.skey where t.target group by all)
  select package, ordinal, field_name, case when rule_type = 'const' or n = 0 then 0.0 when bad then 0.0 when list_contains(gs, grp) then 100.0 when bit_length <> 0 and list_contains(bs, bit_length) then 80.0 when rule_type = 'expression' and n > 1 then 70.0 when grp is null and ng = 0 then 60.0 else 35.0 end::double as score from j""")
def fn_18_dimension(s, d):
    """FN-18: how well the dimension of a target field fits those of its rule's sources."""
    f = _fields(s, d)
    r = evaluation.first_rules(evaluation.normal_rules(_rules(f)))
    found = evaluation.resolved_sources(r, evaluation.field_specs(_specs(f.where("not target"))))
    t = evaluation.field_specs(_specs(f.where("target"))).join(r.select("package", "key", "rule_type"), ["package", "key"], "left").join(found, ["package", "key"], "left")
    src = F.coalesce(F.transform("found", lambda x: F.struct(x["grp"].alias("grp"), x["bits"].alias("bits"))), F.array().cast("array<struct<grp:string,bits:int>>"))
    return t.select("package", "ordinal", "field_name", Y.dimension_score(F.coalesce("rule_type", F.lit("expression")), F.col("grp"), F.col("bit_length"), src).alias("score"))


@query("with t as (select distinct field_name, meaning, " + _SQ.format("coalesce(meaning, field_name)") + " as t from (select unnest(protocol_fields, recursive := true) from blocks) where field_name is not null) select field_name, meaning, " + _GRP("t") + " as grp, array_to_string(list_filter([" + ", ".join("case when " + " or ".join(f"contains(t, '{w}')" for w in words) + f" then '{g}' end" for g, words in Y.GROUPS) + "], lambda x: x is not null), ',') as every from t")
def fn_17_groups(s, d):
    """FN-17: the first quantity a name or meaning stands for, and all of them."""
    text = F.coalesce("meaning", "field_name")
    return _fields(s, d).select("field_name", "meaning", Y.group_of(text).alias("grp"), F.array_join(Y.groups_of(text), ",").alias("every")).distinct()


@query(_F + r", v as (select package, pos, formula, rule_type, length(replace(formula, '(', '')) = length(replace(formula, ')', '')) as balanced, regexp_full_match(formula, '[+-]?([0-9]+([.][0-9]+)?|[.][0-9]+)') as num from r1) select package, pos, formula, rule_type, case when formula = '' then false when rule_type = 'const' then num when not balanced then false when num then true when rule_type = 'direct' then regexp_matches(formula, '[A-Za-z0-9_\x{4e00}-\x{9fff}]') else length(formula) >= 2 end as valid from v")
def fn_19_formula_valid(s, d):
    """FN-19: validity of a formula by its rule type."""
    r = evaluation.normal_rules(_rules(_fields(s, d)))
    return r.select("package", "pos", "formula", "rule_type", Y.formula_valid(F.col("formula"), F.col("rule_type")).alias("valid"))


_U = "case " + " ".join(f"when u = '{k}' then '{v}'" for k, v in Y.UNIT_FAMILIES.items()) + " else u end"
_CELLS = "with b as (select distinct block_id, content from blocks where block_type = 'table' and content is not null), l as (select block_id, unnest(string_split(content, chr(10))) as line from b), c as (select block_id, line, list_transform(string_split(line, '|'), lambda x: trim(x)) as cells from l where contains(line, '|'))"


def _cells(s, d):
    b = once(table(s, d, "blocks")).where("block_type = 'table' and content is not null").select("block_id", F.explode(F.split("content", "\n")).alias("line"))
    return b.where(F.contains("line", F.lit("|"))).select("block_id", "line", F.transform(F.split("line", r"\|"), lambda x: F.trim(x)).alias("cells"))


@query(_CELLS + f" select unit, family, count(*)::bigint as n from (select u as unit, {_U} as family from (select nullif(lower(trim(cells[-1])), '') as u from c)) group by 1, 2")
def fn_20_unit_family(s, d):
    """FN-20: families of what stands in the last column of tables."""
    unit = F.element_at("cells", -1)
    return _cells(s, d).select(F.nullif(F.lower(F.trim(unit)), F.lit("")).alias("unit"), Y.unit_family(unit).alias("family")).groupBy("unit", "family").agg(F.count("*").alias("n"))


_SHAPE = r"case when x = '' then 'e' when regexp_matches(x, '[0-9]') and regexp_matches(x, '[A-Za-z\x{4e00}-\x{9fff}]') then 'm' when regexp_matches(x, '[0-9]') then 'n' when regexp_matches(x, '[A-Za-z\x{4e00}-\x{9fff}]') then 'a' else 'o' end"


@query(_CELLS + rf""", f as (select *, list_filter(list_transform(cells, lambda x: lower(x)), lambda x: x <> '') as u from c)
  select block_id, line, array_to_string(list_transform(cells, lambda x: {_SHAPE}), '') as shape, len(list_filter(cells, lambda x: x = ''))::double / len(cells) as blank,
  len(u) >= 2 and (regexp_matches(array_to_string(u, ' '), 'field|字段|name|名称|bit|位|desc|描述|length|len|type|unit') or (len(list_filter(u, lambda x: regexp_matches(x, '[a-z\x{{4e00}}-\x{{9fff}}]'))) >= greatest(1, len(u) - 1) and len(list_filter(u, lambda x: regexp_matches(x, '[0-9]'))) <= len(u) // 2)) as header from f""")
def fn_23_row_shapes(s, d):
    """FN-23: shapes of the cells of table rows, share of blank cells, header or not."""
    return _cells(s, d).select("block_id", "line", Y.row_shape(F.col("cells")).alias("shape"), Y.blank_ratio(F.col("cells")).alias("blank"), Y.header_row(F.col("cells")).alias("header"))


# ---- checks


def _checked(s, d):
    f = _fields(s, d)
    many = f.groupBy("field_name").agg((F.count("*") > 1).alias("known"))
    unit = F.element_at(F.split(F.coalesce("meaning", F.lit("")), " "), -1)
    r = f.where("formula is not null").join(many, "field_name")
    return r.select(F.concat_ws("|", "block_id", "pos").alias("rule_id"), F.when(F.col("formula").rlike(rulechecks.EXACT), "mapping").otherwise("transcoding").alias("mode"), "formula", unit.alias("unit"), "bit_length", "known", F.col("range_min").alias("sample"))


_V8 = _F + r""", k as (select block_id || '|' || pos as rule_id, formula, regexp_extract(coalesce(meaning, ''), '[^ ]*$') as unit, bit_length, range_min as sample, count(*) over (partition by field_name) > 1 as known,
  case when regexp_matches(formula, '-?[0-9]+\s*(=|->|→)\s*[A-Za-z_][A-Za-z0-9_./\-]*') then 'mapping' else 'transcoding' end as mode, regexp_full_match(formula, '[xv]\w* *[-+*/] *[0-9.]+( *[-+*/] *[0-9.]+)*') as good from fld),
c as (select rule_id, 'ModeSupported' as check_name, 'error' as severity, true as passed from k where formula is not null union all select rule_id, 'KnowledgeBaseAnchor', 'warning', known from k where formula is not null
  union all select rule_id, 'MappingSyntax', 'error', true from k where formula is not null and mode = 'mapping' union all select rule_id, 'MappingRangeOverlap', 'error', true from k where formula is not null and mode = 'mapping' union all select rule_id, 'MappingUnitConvention', 'warning', trim(unit) = '' from k where formula is not null and mode = 'mapping'
  union all select rule_id, 'ExpressionSyntax', 'error', good from k where formula is not null and mode <> 'mapping' union all select rule_id, 'BitLengthResolved', 'error', not regexp_matches(formula, 'signed|bits') or coalesce(bit_length, 0) > 0 from k where formula is not null and mode <> 'mapping' and good
  union all select rule_id, 'DimensionAnalysis', 'warning', lower(trim(unit)) not in ('label', 'enum') from k where formula is not null and mode <> 'mapping' and good union all select rule_id, 'ExecutionPreview', case when sample is null then 'info' else 'error' end, true from k where formula is not null and mode <> 'mapping' and good)
"""


@query(_V8 + "select * from c")
def val_08_checks(s, d):
    """VAL-08: the checks of every rule with their severity."""
    return rulechecks.rule_checks(_checked(s, d))


@query(_V8 + ", v as (select rule_id, count(*) filter (severity = 'error' and not passed) as e, count(*) filter (severity = 'warning' and not passed) as w from c group by 1) select count(*)::bigint as total, (count(*) filter (e = 0))::bigint as passed, (count(*) filter (e > 0))::bigint as failed, (count(*) filter (w > 0))::bigint as warning from v")
def val_09_summary(s, d):
    """VAL-09: rules passed, failed and with warnings."""
    return rulechecks.summary(rulechecks.rule_verdicts(rulechecks.rule_checks(_checked(s, d))))


@query(_F + r""", n as (select package, upper(trim(field_name)) as u, count(*) as n, max((bit_length is not null)::int) as fit from fld group by 1, 2),
q as (select package, pos, upper(trim(target_field)) as u from r0 union all select package, pos, upper(trim(source)) from r0 where source is not null),
m as (select q.package, bool_and(n.n = 1) as legal, bool_and(n.n = 1 and n.fit = 1) as placed from q join n using (package, u) group by 1),
t as (select package, bool_and(source is not null or regexp_full_match(formula, '[+-]?([0-9]+([.][0-9]+)?|[.][0-9]+)')) as logic, count(*) = count(distinct trim(target_field)) as once from r0 group by 1)
select package, coalesce(legal, true) as field_legality, coalesce(placed, true) as position_accuracy, coalesce(logic, true) as conversion_logic, coalesce(once, true) as protocol_compliance from (select distinct package from fld) left join m using (package) left join t using (package)""")
def val_10_package_verdicts(s, d):
    """VAL-10: field legality, position accuracy, conversion logic and compliance of each file's package."""
    f = _fields(s, d)
    rules = _rules(f).withColumns({"source_fields": F.transform("source_fields", lambda x: F.concat(F.lit("src."), x)), "rule_type": F.lit("expression")})
    packages = f.select("package").distinct().select("package", F.lit("1.0").alias("version"), F.col("package").alias("project_name"), F.col("package").alias("name"), F.lit("simple").alias("mode"), F.col("package").alias("target_protocol"), F.array(F.struct(F.lit("src").alias("alias"), F.col("package").alias("protocol"))).alias("sources"))
    specs = f.select(F.col("package").alias("protocol"), "field_name", F.lit(None).cast("string").alias("actual_field"), F.lit(None).cast("string").alias("label"), F.concat_ws("/", "package", "field_name").alias("path"), "bit_length")
    return rulechecks.package_verdicts(packages, rules, specs)


@query(_F + "select t.package, t.ordinal, t.field_name, (select count(*) from fld s where s.package = t.package and upper(trim(s.field_name)) = upper(trim(t.field_name)))::bigint as n from fld t where t.formula is not null")
def join_12_spec_lookup(s, d):
    """JOIN-12: how many fields of the definition a rule's target stands for; one is right."""
    f = _fields(s, d)
    specs = f.select(F.col("package").alias("protocol"), "field_name", F.lit(None).cast("string").alias("actual_field"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("path"), "bit_length")
    asked = f.where("formula is not null").select(F.struct("package", "ordinal").alias("ask"), F.col("package").alias("protocol"), "field_name", F.lit(None).cast("string").alias("path"))
    return rulechecks.field_matches(asked, specs).select("ask.package", "ask.ordinal", "field_name", F.col("n").cast("bigint").alias("n"))


# ---- extraction


@query()
def spl_12_extracted(s, d):
    """SPL-12: formula, range and bits of every block's text."""
    c = F.col("content")
    (low, high), (start, width) = X.value_range(c), X.bits(c)
    return once(table(s, d, "blocks")).where("content is not null").select("block_id", X.formula(c).alias("formula"), low.alias("range_min"), high.alias("range_max"), start.alias("bit_start"), width.alias("bit_length"))


@query()
def spl_14_qa_parameters(s, d):
    """SPL-14: field parameters stated by every QA pair."""
    q = table(s, d, "qa_pairs").drop("loaded_at").dropDuplicates(["qa_id"])
    return q.select("qa_id", *[v.alias(k) for k, v in X.qa_parameters(F.col("question"), F.col("answer")).items()])


@query()
def spl_07_paragraphs(s, d):
    """SPL-07: paragraphs of the documents, wrapped at 800 characters."""
    return splitter.paragraphs(table(s, d, "documents"), "doc_id").select("doc_id", "pos", F.char_length("paragraph").alias("chars"))


# ---- training


@query("""select base_model, job_id from (select *, row_number() over (partition by base_model order by acc desc nulls last, loss asc nulls last, created_at, job_id) as rn from
  (select distinct base_model, job_id, created_at, progress.percent as acc, config.learning_rate as loss from finetune_jobs)) where rn = 1""")
def agg_16_best_checkpoint(s, d):
    """AGG-16: the best of each model by accuracy, then loss; nulls last, the earlier of equals stays."""
    j = table(s, d, "finetune_jobs").select("base_model", "job_id", "created_at", F.col("progress.percent").alias("acc"), F.col("config.learning_rate").alias("loss")).distinct()
    order = W.partitionBy("base_model").orderBy(F.desc_nulls_last("acc"), F.asc_nulls_last("loss"), "created_at", "job_id")
    return j.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("base_model", "job_id")


@query("""with e as (select user_id, event_id, ts, floor(value / 10)::bigint as step, value from events), r as (select *, lead(step) over (partition by user_id order by ts, event_id) as nxt from e), k as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as back from r where nxt is distinct from step)
  select user_id, event_id, step from k where back <= 2000""")
def win_08_history(s, d):
    """WIN-08: the last point of each run of equal steps, the latest 2000 of a user."""
    e = table(s, d, "events").select("user_id", "event_id", "ts", F.floor(F.col("value") / 10).cast("bigint").alias("step"))
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    last = e.withColumn("nxt", F.lead("step").over(w)).where(~F.col("nxt").eqNullSafe(F.col("step")))
    return last.withColumn("back", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))).where("back <= 2000").select("user_id", "event_id", "step")
