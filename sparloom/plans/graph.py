"""Queries on the graph of fields: nodes are the fields of files, edges the rules between them, concepts names without
suffixes (JOIN-03..07, JOIN-14, JOIN-15, JOIN-17, JOIN-22, RANK-05, RANK-07,
SNK-09, SET-05, AGG-10, AGG-13, AGG-14, VAL-11, VAL-16, FN-26, MSG-12, MSG-15, MSG-16, CLN-11).
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparloom.functions import extract as X
from sparloom.functions import features
from sparloom.functions.jsontext import first_json
from sparloom.operators import evaluation, graph
from sparloom.operators.cleaning import once
from sparloom.operators.rules import aggregate_cases, rule_score
from sparloom.plans.rulebase import _F, _fields, _rules
from sparloom.sources.sinks import upsert
from sparloom.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


_SUFFIX = "_(RAW|MIN|MAX|MEAN|REF|VAL|CNT|IDX|LVL|CODE|TYPE|FLAG|STAT|UNIT|RATE|MSB|LSB)(_[0-9]+)?$"
_Q = "(select distinct qa_id, dataset_id, question, answer, qa_task_type, is_low_quality from qa_pairs)"
_N = _F + f""", nodes as (select package || '/' || field_name as node_id, package, field_name, bool_or(target) as target, regexp_replace(field_name, '{_SUFFIX}', '') as concept from fld group by 1, 2, 3, 5),
edges as (select package || '#' || pos as edge_id, package, pos, package || '/' || source as source_id, package || '/' || target_field as target_id, source, target_field, formula from r0)
"""


def _nodes(f):
    return f.groupBy("package", "field_name").agg(F.max("target").alias("target")).select(F.concat_ws("/", "package", "field_name").alias("node_id"), "package", "field_name", "target", F.regexp_replace("field_name", _SUFFIX, "").alias("concept"))


def _edges(f):
    r = _rules(f).withColumn("source", F.get("source_fields", F.lit(0)))
    return r.select(F.concat_ws("#", "package", "pos").alias("edge_id"), "package", "pos", F.when(F.col("source").isNotNull(), F.concat_ws("/", "package", "source")).alias("source_id"), F.concat_ws("/", "package", "target_field").alias("target_id"), "source", "target_field", F.trim("formula").alias("formula"))


@query(_N + "select e.edge_id, s.field_name as source, t.field_name as target, c.concept, c.members from edges e join nodes s on s.node_id = e.source_id left join (select * from nodes where target) t on t.node_id = e.target_id left join (select concept, count(*)::bigint as members from nodes group by 1) c on c.concept = t.concept")
def join_03_edges(s, d):
    """JOIN-03: edges with their source node, and target node and concept where there are any."""
    f = _fields(s, d)
    n = _nodes(f)
    src = n.select(F.col("node_id").alias("source_id"), F.col("field_name").alias("source"))
    tgt = n.where("target").select(F.col("node_id").alias("target_id"), F.col("field_name").alias("target"), "concept")
    size = n.groupBy("concept").agg(F.count("*").alias("members"))
    return _edges(f).drop("source").join(src, "source_id").join(tgt, "target_id", "left").join(size, "concept", "left").select("edge_id", "source", "target", "concept", "members")


@query(_N + "select t.concept, t.field_name as target, array_to_string(list_sort(list(distinct s.field_name)), ',') as sources, count(distinct e.package)::bigint as packages from edges e join nodes t on t.node_id = e.target_id left join nodes s on s.node_id = e.source_id group by 1, 2 having count(s.field_name) > 0")
def join_04_graph_match(s, d):
    """JOIN-04: rules with their target, its concept and all their sources, over all packages."""
    f = _fields(s, d)
    n, e = _nodes(f), _edges(f)
    j = e.drop("source").join(n.select(F.col("node_id").alias("target_id"), "concept", F.col("field_name").alias("target")), "target_id").join(n.select(F.col("node_id").alias("source_id"), F.col("field_name").alias("source")), "source_id", "left")
    g = j.groupBy("concept", "target").agg(F.array_sort(F.collect_set("source")).alias("s"), F.count_distinct("package").alias("packages"))
    return g.where(F.size("s") > 0).select("concept", "target", F.array_join("s", ",").alias("sources"), "packages")


_A = r"'(?i)(?:^|[^\p{L}\p{N}_])([A-Z]{1,2}\d+\.\d+[A-Z]?\d*)(?:$|[^\p{L}\p{N}_])'"


@query(rf"""with b as (select distinct block_id, project_id, content from blocks), k as (select block_id, project_id, nullif(upper(coalesce(regexp_extract(content, {_A}, 1), '')), '') as code from b), x as (select block_id, project_id, code, unnest(pf) as f from k join (select block_id, any_value(protocol_fields) as pf from blocks group by 1) using (block_id)),
  r as (select block_id, project_id, code, f.field_name as field_name, f.formula as formula from x where f.formula is not null and f.field_name is not null), m as (select block_id as msg, project_id, code as want, f.field_name as field_name from x where f.field_name is not null),
  j as (select distinct msg, m.field_name, r.formula, r.block_id as rule_block, (r.code is not null)::int as exact from m join r on r.project_id = m.project_id and r.field_name = m.field_name and (r.code is null or r.code = m.want))
  select msg, field_name, formula, rule_block, exact from j qualify row_number() over (partition by msg, field_name order by exact desc, formula, rule_block) = 1""")
def join_05_wildcard(s, d):
    """JOIN-05: fields of a message with the best rule of the project for their name: of the message's code before those of
    none. The wildcard is a join of its own, so both are equi joins."""
    code = F.nullif(features.anchor(F.col("content")), F.lit(""))
    x = once(table(s, d, "blocks")).select("block_id", "project_id", code.alias("code"), F.explode("protocol_fields").alias("f")).select("block_id", "project_id", "code", "f.*").where("field_name is not null")
    r = x.where("formula is not null").select("project_id", "field_name", "formula", F.col("block_id").alias("rule_block"), F.col("code").alias("r_code"))
    m = x.select(F.col("block_id").alias("msg"), "project_id", "field_name", "code").distinct()
    exact = m.join(r.where("r_code is not null"), (m.project_id == r.project_id) & (m.field_name == r.field_name) & (m.code == r.r_code)).select("msg", m.field_name, "formula", "rule_block", F.lit(1).alias("exact"))
    wild = m.join(r.where("r_code is null"), ["project_id", "field_name"]).select("msg", "field_name", "formula", "rule_block", F.lit(0).alias("exact"))
    w = W.partitionBy("msg", "field_name").orderBy(F.desc("exact"), "formula", "rule_block")
    return exact.unionByName(wild).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


@query(_N + """, rules as (select target_field, list_sort(list(distinct source)) as src from edges where source is not null group by 1), n as (select package, list(distinct field_name) as have from fld group by 1)
  select package, target_field, array_to_string(src, ',') as sources from n, rules where len(list_filter(src, lambda x: not list_contains(have, x))) = 0""")
def join_06_all_present(s, d):
    """JOIN-06: rules of all packages whose every source a package has; counted matches instead of a join of all with all."""
    f = _fields(s, d)
    rules = _edges(f).where("source is not null").groupBy("target_field").agg(F.array_sort(F.collect_set("source")).alias("src"))
    have = f.select("package", F.col("field_name").alias("source")).distinct()
    met = rules.select("target_field", "src", F.explode("src").alias("source")).join(have, "source").groupBy("package", "target_field", "src").agg(F.count("*").alias("n"))
    return met.where(F.col("n") == F.size("src")).select("package", "target_field", F.array_join("src", ",").alias("sources"))


@query(_N + """, sig as (select distinct target_field, coalesce(source, '') as source, formula, edge_id, (select bool_or(target) from fld where fld.package = edges.package and fld.ordinal = edges.pos) as old from edges), k as (select target_field, source, formula, bool_or(old) as old from sig group by 1, 2, 3)
  select target_field, source, formula, case when old then 'updated' else 'created' end as change from k where exists (select 1 from sig where sig.target_field = k.target_field and sig.source = k.source and sig.formula = k.formula and not sig.old)""")
def join_07_created_updated(s, d):
    """JOIN-07: rules of texts against those of tables by target, source and formula: known ones are updates."""
    f = _fields(s, d)
    e = _edges(f).join(f.select("package", F.col("ordinal").alias("pos"), "target"), ["package", "pos"]).select("target_field", F.coalesce("source", F.lit("")).alias("source"), "formula", "target")
    k = e.groupBy("target_field", "source", "formula").agg(F.max("target").alias("old"), F.min("target").alias("all_old")).where("not all_old")
    return k.select("target_field", "source", "formula", F.when(F.col("old"), "updated").otherwise("created").alias("change"))


@query()
def join_15_candidates(s, d):
    """JOIN-15/RANK-05: scored source candidates of every target field, pruned."""
    f = _fields(s, d)
    return graph.source_candidates(f.where("target").select("package", "ordinal", "field_name"), f.where("not target").select("package", "field_name").distinct())


@query(_F + """, a as (select package, ordinal, field_name, upper(trim(field_name)) as k, regexp_extract(package, '^([a-z]+_[a-z]+)', 1) as family from fld where formula is not null),
  sch as (select package, regexp_extract(package, '^([a-z]+_[a-z]+)', 1) as family, upper(trim(field_name)) as k, bit_length, block_id, pos from fld where bit_length is not null),
  c as (select a.package, a.ordinal, a.field_name, s.bit_length, case when s.package = a.package then 1 when s.family = a.family then 2 else 3 end as pri, s.package as from_package, s.block_id, s.pos from a left join sch s on s.k = a.k)
  select package, ordinal, field_name, bit_length, case when bit_length is null then 'none' when pri = 1 then 'message' when pri = 2 then 'family' else 'default' end as level from c qualify row_number() over (partition by package, ordinal order by bit_length is null, pri, from_package, block_id, pos) = 1""")
def join_17_schema_fallback(s, d):
    """JOIN-17: the schema of a rule's field: of its own message, else of the family, else the first there is."""
    f = _fields(s, d)
    return graph.schema_fallback(f.where("formula is not null").select("package", "ordinal", "field_name"), f.where("bit_length is not null").select("package", "field_name", "bit_length", "block_id", "pos"), r"^([a-z]+_[a-z]+)")


_SQUASH = r"regexp_replace(lower(trim({})), '[\s_\-./:：，,()\[\]{{}}]+', '', 'g')"


@query(_F + f""", a as (select package, ordinal, case when ordinal % 4 = 0 then field_name when ordinal % 4 = 1 then lower(field_name) when ordinal % 4 = 2 then replace(field_name, '_', '-') else regexp_replace(field_name, '^[^_]*_', '') end as asked from fld),
  n as (select distinct package, field_name from fld), c as (select a.package, a.ordinal, a.asked, n.field_name, case when n.field_name = a.asked then 1 when upper(trim(n.field_name)) = upper(trim(a.asked)) then 2 when {_SQUASH.format("n.field_name")} = {_SQUASH.format("a.asked")} then 3 when ends_with(upper(n.field_name), '_' || upper(trim(a.asked))) then 4 end as tier from a join n using (package)),
  t as (select package, ordinal, asked, tier, count(*) as n, min(field_name) as found from c where tier is not null group by 1, 2, 3, 4), best as (select * from t qualify row_number() over (partition by package, ordinal order by tier) = 1)
  select a.package, a.ordinal, a.asked, case when best.n = 1 then best.found end as resolved, case when best.n is null then 'unknown' when best.n > 1 then 'ambiguous' when tier = 1 then 'exact' when tier = 2 then 'name' when tier = 3 then 'normalised' else 'suffix' end as how from a left join best using (package, ordinal)""")
def join_22_resolution(s, d):
    """JOIN-22: names in various notations resolved against the fields of their package in tiers; the first tier that knows a
    name decides, several fields of it are ambiguous."""
    f = _fields(s, d)
    way = F.col("ordinal") % 4
    name = F.col("field_name")
    asked = F.when(way == 0, name).when(way == 1, F.lower(name)).when(way == 2, F.replace(name, F.lit("_"), F.lit("-"))).otherwise(F.regexp_replace(name, "^[^_]*_", ""))
    return graph.resolve(f.select("package", "ordinal", asked.alias("asked")), f.select("package", "field_name").distinct())


@query(_F + "select package, pos, key, coalesce(source, '') as sources, formula, rule_type from r1")
def msg_15_normal_rules(s, d):
    """MSG-15: rules in one form: lookup name, sources, trimmed formula, inferred type."""
    r = evaluation.normal_rules(_rules(_fields(s, d)))
    return r.select("package", "pos", "key", F.array_join("sources", ",").alias("sources"), "formula", "rule_type")


@query(_F + "select package, key, target_field, formula, rule_type, rule_type <> 'const' and formula <> '0' as executable, md5(package || '|' || key || '|' || coalesce(source, '') || '|' || formula) as signature from ru")
def msg_12_payloads(s, d):
    """MSG-12: one executable rule per target with the signature it is written back under."""
    r = evaluation.first_rules(evaluation.normal_rules(_rules(_fields(s, d))))
    sig = F.md5(F.encode(F.concat_ws("|", "package", "key", F.array_join("sources", ","), "formula"), "utf-8"))
    return r.select("package", "key", "target_field", "formula", "rule_type", ((F.col("rule_type") != "const") & (F.col("formula") != "0")).alias("executable"), sig.alias("signature"))


@query(_N + ", l as (select field_name, arg_max(bit_length, (block_id, pos)) as newest, max(bit_length) as bits from fld group by 1), o as (select field_name, min((block_id, pos)) as first_at from fld group by 1) select field_name, arg_max({'b': bit_length}, (block_id, pos)).b as bit_length, case when count(*) > 1 then 'updated' else 'created' end as change from fld group by 1")
def snk_09_graph_upsert(s, d):
    """SNK-09: nodes written one after the other, the latest row of a name wins."""
    f = _fields(s, d).select("field_name", "bit_length", F.struct("block_id", "pos").alias("at"))
    once_ = upsert(f.limit(0), f, ["field_name"], "at")
    many = f.groupBy("field_name").agg(F.count("*").alias("n"))
    return once_.join(many, "field_name").select("field_name", "bit_length", F.when(F.col("n") > 1, "updated").otherwise("created").alias("change"))


@query(f"with q as (select *, not coalesce(is_low_quality, false) as good from {_Q}), h as (select dataset_id, bool_or(good) as has from q where dataset_id is not null group by 1) select qa_id, case when good then 'checked' else 'fallback' end as source from q join h using (dataset_id) where good or not has")
def set_05_fallback_source(s, d):
    """SET-05: of each dataset the pairs that passed, all of them where none did."""
    q = table(s, d, "qa_pairs").select("qa_id", "dataset_id", (~F.coalesce("is_low_quality", F.lit(False))).alias("good")).where("dataset_id is not null").dropDuplicates(["qa_id"])
    has = q.groupBy("dataset_id").agg(F.max("good").alias("has"))
    return q.join(has, "dataset_id").where("good or not has").select("qa_id", F.when(F.col("good"), "checked").otherwise("fallback").alias("source"))


@query(rf"""with q as (select dataset_id, coalesce(nullif(regexp_extract(answer, '字段名称\s*[:：]?\s*([A-Za-z][A-Za-z0-9_./\-]*)', 1), ''), nullif(regexp_extract(answer, '协议中\s*([A-Za-z][A-Za-z0-9_./\-]*)\s*字段', 1), ''), nullif(regexp_extract(answer, '(?:^|[^A-Za-z0-9_])([A-Z][A-Z0-9_./\-]{{2,}})(?:$|[^A-Za-z0-9_])', 1), ''),
  nullif(regexp_extract(question, '字段名称\s*[:：]?\s*([A-Za-z][A-Za-z0-9_./\-]*)', 1), ''), nullif(regexp_extract(question, '协议中\s*([A-Za-z][A-Za-z0-9_./\-]*)\s*字段', 1), ''), nullif(regexp_extract(question, '(?:^|[^A-Za-z0-9_])([A-Z][A-Z0-9_./\-]{{2,}})(?:$|[^A-Za-z0-9_])', 1), '')) as name from {_Q})
  select dataset_id, count(*)::bigint as total, count(name)::bigint as success, (count(*) - count(name))::bigint as failed from q group by 1""")
def agg_14_extracted(s, d):
    """AGG-14: QA pairs a field could be extracted from, per dataset."""
    q = table(s, d, "qa_pairs").drop("loaded_at").dropDuplicates(["qa_id"])
    g = q.select("dataset_id", X.qa_parameters(F.col("question"), F.col("answer"))["field_name"].alias("name")).groupBy("dataset_id")
    return g.agg(F.count("*").alias("total"), F.count("name").alias("success"), F.count_if(F.col("name").isNull()).alias("failed"))


@query("with b as (select distinct block_id, file_name, page_num from blocks) select block_id, file_name, row_number() over (partition by file_name order by page_num nulls first, block_id)::int as place from b where file_name like 'icd%' and block_id > 0")
def val_16_block_filter(s, d):
    """VAL-16: blocks of files of a kind, in order; an empty filter keeps all."""
    b = graph.block_filter(once(table(s, d, "blocks")), F.col("file_name").startswith("icd"), None)
    return b.select("block_id", "file_name", F.row_number().over(W.partitionBy("file_name").orderBy(F.asc_nulls_first("page_num"), "block_id")).alias("place"))


@query()
def cln_11_json_answers(s, d):
    """CLN-11: the first JSON object or array an answer holds, in whatever text."""
    q = table(s, d, "qa_pairs").drop("loaded_at").dropDuplicates(["qa_id"])
    return q.select("qa_id", first_json("answer").alias("found")).where("found is not null")


@query(rf"""with b as (select distinct block_id, project_id, file_name, content from blocks), k as (select block_id, project_id, file_name, nullif(upper(coalesce(regexp_extract(content, {_A}, 1), '')), '') as code from b), x as (select block_id, project_id, file_name, code, unnest(pf) as f from k join (select block_id, any_value(protocol_fields) as pf from blocks group by 1) using (block_id)),
  r as (select block_id, project_id, file_name, code, f.field_name as field_name, f.formula as formula, f.bit_length / 64.0 as conf from x where f.formula is not null and f.field_name is not null),
  m as (select distinct block_id as msg, project_id, file_name, code as want from x),
  j as (select msg, r.field_name, r.formula, r.block_id as rule_block, case when r.code = m.want then 30 when r.code is null then 8 else 0 end + 12 * (r.block_id = m.msg)::int + 16 * (r.file_name = m.file_name)::int + floor(coalesce(r.conf, 0) * 5)::int as score from m join r on r.project_id = m.project_id and r.file_name = m.file_name and (r.code is null or r.code = m.want))
  select msg, field_name, formula, rule_block, score::int as score, (row_number() over (partition by msg order by score desc, field_name, formula, rule_block))::int as place from j qualify row_number() over (partition by msg order by score desc, field_name, formula, rule_block) <= 5""")
def rank_07_rule_ranking(s, d):
    """RANK-07: rules of a file for each of its messages by points, five at most; rules of any code are a join of their own."""
    code = F.nullif(features.anchor(F.col("content")), F.lit(""))
    x = once(table(s, d, "blocks")).where("protocol_fields is not null and size(protocol_fields) > 0").select("block_id", "project_id", "file_name", code.alias("code"), "protocol_fields")
    r = x.select("project_id", "file_name", F.col("code").alias("r_code"), F.col("block_id").alias("rule_block"), F.explode("protocol_fields").alias("f")).select("*", "f.field_name", "f.formula", (F.col("f.bit_length") / 64.0).alias("conf")).drop("f").where("formula is not null and field_name is not null")
    m = x.select(F.col("block_id").alias("msg"), "project_id", "file_name", F.col("code").alias("want"))
    exact = m.where("want is not null").join(r.withColumn("want", F.col("r_code")), ["project_id", "file_name", "want"])
    both = exact.unionByName(m.join(r.where("r_code is null"), ["project_id", "file_name"]))
    score = rule_score(F.col("r_code"), F.col("want"), F.col("rule_block") == F.col("msg"), F.lit(True), F.col("conf"))
    j = both.select("msg", "field_name", "formula", "rule_block", score.alias("score"))
    return j.withColumn("place", F.row_number().over(W.partitionBy("msg").orderBy(F.desc("score"), "field_name", "formula", "rule_block"))).where("place <= 5")


@query(_F + """, have as (select package, list(distinct key) as l from fld where not target group by 1),
  v as (select r1.package, r1.pos, r1.key, r1.formula, case when r1.source is not null and not coalesce(list_contains(h.l, r1.skey), false) then 'unknown source' when r1.formula = '' then 'no formula'
    when len(list_filter(regexp_extract_all(r1.formula, '[A-Za-z_][A-Za-z0-9_]*'), lambda x: x not in ('x', 'value', 'raw', 'bits', 'abs', 'round', 'int', 'float', 'min', 'max', 'len', 'sum', 'range', 'enumerate', 'list', 'dict', 'signed', 'unsigned', 'clip', 'scale') and x <> coalesce(r1.source, ''))) > 0 then 'undeclared name'
    when not exists (select 1 from fld t where t.package = r1.package and t.key = r1.key and t.target) then 'unknown target' else '' end as reason from r1 left join have h using (package)) select package, pos, key, formula, reason from v""")
def val_11_filtered_rules(s, d):
    """VAL-11: every rule with the first reason against it, empty for those that stay."""
    f = _fields(s, d)
    specs = evaluation.field_specs(f.select("package", "field_name", "target", F.lit("").alias("path"), F.lit("").alias("protocol"), F.lit("").alias("file_name"), "bit_length", F.lit("").alias("default_value")))
    return graph.filtered_rules(evaluation.normal_rules(_rules(f)), specs.where("not target"), specs.where("target"))


@query(_N + """, inst as (select package, concept, count(*) as n, min(field_name) as only_one from nodes where target group by 1, 2), r as (select distinct e.package, e.pos, e.target_field, regexp_replace(e.target_field, '""" + _SUFFIX + """', '') as concept, e.formula from edges e)
  select r.package, r.pos, case when t.node_id is not null or i.n is null then r.target_field else i.only_one end as target_field, case when t.node_id is not null then 'bound' when i.n is null then 'kept' else 'expanded' end as how, r.formula
  from r left join (select node_id, package, field_name from nodes where target) t on t.package = r.package and t.field_name = r.target_field left join inst i on i.package = r.package and i.concept = r.concept where t.node_id is not null or i.n is null or i.n = 1""")
def join_14_instances(s, d):
    """JOIN-14: rules of a concept bound to their target instance; one rule is never laid over several instances."""
    f = _fields(s, d)
    n = _nodes(f).where("target")
    inst = n.groupBy("package", "concept").agg(F.count("*").alias("n"), F.min("field_name").alias("only_one"))
    r = _edges(f).select("package", "pos", "target_field", F.regexp_replace("target_field", _SUFFIX, "").alias("concept"), "formula")
    j = r.join(n.select("package", F.col("field_name").alias("target_field"), F.lit(True).alias("bound")), ["package", "target_field"], "left").join(inst, ["package", "concept"], "left")
    j = j.where("bound or n is null or n = 1")
    own = F.col("bound") | F.col("n").isNull()
    return j.select("package", "pos", F.when(own, F.col("target_field")).otherwise(F.col("only_one")).alias("target_field"), F.when(F.col("bound"), "bound").when(F.col("n").isNull(), "kept").otherwise("expanded").alias("how"), "formula")


@query(_N + """, i as (select package, regexp_replace(field_name, '""" + _SUFFIX + """', '') as concept, field_name, min(ordinal) as ordinal, arg_min(bit_length, ordinal) filter (bit_length is not null) as bl, min(ordinal) filter (bit_length is not null) as bl_at, arg_min(meaning, ordinal) filter (meaning is not null) as mn, min(ordinal) filter (meaning is not null) as mn_at from fld where target group by 1, 2, 3)
  select package, concept, count(*)::bigint as instances, string_agg(field_name, ',' order by ordinal) as members, arg_min(bl, bl_at) as bit_length, arg_min(mn, mn_at) as meaning from i group by 1, 2""")
def agg_13_concepts(s, d):
    """AGG-13: required fields once each, grouped by concept: how many, which, and the first attributes given."""
    f = _fields(s, d).where("target")
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("ordinal", c)))[c]
    once_ = f.groupBy("package", "field_name").agg(F.min("ordinal").alias("at"))
    members = once_.withColumn("concept", F.regexp_replace("field_name", _SUFFIX, "")).groupBy("package", "concept").agg(F.count("*").alias("instances"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "field_name"))), lambda x: x["field_name"]), ",").alias("members"))
    given = f.withColumn("concept", F.regexp_replace("field_name", _SUFFIX, "")).groupBy("package", "concept").agg(first("bit_length").alias("bit_length"), first("meaning").alias("meaning"))
    return members.join(given, ["package", "concept"])


@query(r"""with q as (select distinct qa_id, dataset_id, question, answer, is_low_quality, conversion_mode from qa_pairs where qa_task_type = 'protocol_conversion'),
  c as (select conversion_mode, least(100, length(coalesce(answer, '')))::double as correctness, case when regexp_matches(coalesce(answer, ''), '[0-9]') then 100.0 else 50.0 end::double as rate, (length(question) % 7 * 10)::double as fragments, regexp_matches(coalesce(answer, ''), '=') as exact, not regexp_matches(question, '[A-Z][A-Z0-9]+_[A-Z0-9_]+') as incomplete,
    coalesce(answer, '') = '' as failed, regexp_matches(coalesce(answer, ''), '[A-Z][A-Z0-9]+_') as executable, length(coalesce(answer, '')) > 300 as wordy, coalesce(is_low_quality, false) as heuristic from q)
  select conversion_mode, count(*)::bigint as cases, (count(*) filter (rate >= 100 and correctness >= 99))::bigint as perfect, (count(*) filter (rate >= 100 and correctness >= 99 and not incomplete))::bigint as perfect_complete, round(sum(correctness) / count(*), 4) as avg_correctness, round(sum(rate) / count(*), 4) as avg_rate,
  round(coalesce(sum(correctness) filter (not incomplete), 0) / greatest(count(*) filter (not incomplete), 1), 4) as avg_correctness_complete, round(coalesce(sum(rate) filter (not incomplete), 0) / greatest(count(*) filter (not incomplete), 1), 4) as avg_rate_complete, round(sum(fragments) / count(*), 4) as avg_fragments, (count(*) filter (exact))::bigint as exact,
  (count(*) filter (incomplete))::bigint as incomplete, (count(*) filter (not incomplete))::bigint as complete, (count(*) filter (not incomplete and rate < 100))::bigint as model_failures, (count(*) filter (not incomplete and failed))::bigint as extraction_failures, (count(*) filter (executable))::bigint as executable, round((count(*) filter (executable)) / count(*) * 100.0, 4)::double as executable_rate,
  (count(*) filter (wordy))::bigint as "verbose", round((count(*) filter (wordy)) / count(*) * 100.0, 4)::double as verbose_rate, (count(*) filter (heuristic))::bigint as heuristic, round((count(*) filter (heuristic)) / count(*) * 100.0, 4)::double as heuristic_rate from c group by 1""")
def agg_10_cases(s, d):
    """AGG-10: all measures over case results, here conversion pairs with results read off their texts."""
    a = F.coalesce("answer", F.lit(""))
    q = table(s, d, "qa_pairs").where("qa_task_type = 'protocol_conversion'").drop("loaded_at").dropDuplicates(["qa_id"])
    c = q.select(
        "conversion_mode", F.least(F.lit(100), F.char_length(a)).cast("double").alias("correctness"), F.when(a.rlike("[0-9]"), 100.0).otherwise(50.0).alias("rate"), (F.char_length("question") % 7 * 10).cast("double").alias("fragments"), F.contains(a, F.lit("=")).alias("exact"),
        (~F.col("question").rlike("[A-Z][A-Z0-9]+_[A-Z0-9_]+")).alias("incomplete"), (a == "").alias("failed"), a.rlike("[A-Z][A-Z0-9]+_").alias("executable"), (F.char_length(a) > 300).alias("verbose"), F.col("is_low_quality").alias("heuristic"),
    )
    return aggregate_cases(c, "conversion_mode")


@query(r"""with q as (select distinct qa_id, question from qa_pairs where question is not null), t as (select qa_id, regexp_extract_all(question, '[A-Z][A-Z0-9_./\-]{2,}') as l from q), u as (select qa_id, unnest(l) as name, generate_subscripts(l, 1) as i from t),
  f as (select field_name, min(formula) as formula from (select unnest(protocol_fields, recursive := true) from blocks) where field_name is not null group by 1), m as (select qa_id, name, formula, i, f.field_name is not null as known, name not in ('WHAT', 'HOW', 'WHY', 'THE', 'AND', 'FOR', 'PROTOCOL') as word from u left join f on f.field_name = u.name)
  select qa_id, name as source_field, formula, known from m qualify row_number() over (partition by qa_id order by known desc, word desc, i) = 1""")
def fn_26_question_fields(s, d):
    """FN-26: the field a question is about, a known one before others, with its formula."""
    q = table(s, d, "qa_pairs").where("question is not null").drop("loaded_at").dropDuplicates(["qa_id"]).select("qa_id", F.posexplode(F.regexp_extract_all("question", F.lit(r"([A-Z][A-Z0-9_./\-]{2,})"), 1)).alias("i", "name"))
    f = once(table(s, d, "blocks")).select(F.explode("protocol_fields").alias("f")).where("f.field_name is not null").groupBy(F.col("f.field_name").alias("name")).agg(F.min("f.formula").alias("formula")).withColumn("known", F.lit(True))
    m = q.join(f, "name", "left").withColumns({"known": F.coalesce("known", F.lit(False)), "word": ~F.col("name").isin("WHAT", "HOW", "WHY", "THE", "AND", "FOR", "PROTOCOL")})
    best = m.groupBy("qa_id").agg(F.min_by(F.struct("name", "formula", "known"), F.struct(~F.col("known"), ~F.col("word"), "i")).alias("b"))
    return best.select("qa_id", F.col("b.name").alias("source_field"), "b.formula", "b.known")


@query(_F + r""", t as (select package, key, min(field_name) as target_field from fld where target group by 1, 2),
  k as (select ru.package, ru.key, t.target_field, case when ru.source is null or regexp_matches(ru.formula, '(?i)(?:^|[^A-Za-z0-9_])result(?:$|[^A-Za-z0-9_])') then '0' else regexp_replace(ru.formula, '(^|[^A-Za-z0-9_.])x($|[^A-Za-z0-9_.])', '\1src.' || ru.source || '\2', 'g') end as formula, ru.source from ru join t using (package, key))
  select package, target_field, formula, case when formula = '0' then 'const' else 'expression' end as rule_type, 'rule' as origin from k union all select t.package, t.target_field, '0', 'const', 'default' from t where not exists (select 1 from k where k.package = t.package and k.key = t.key)""")
def msg_16_package(s, d):
    """MSG-16/JOIN-13: the conversion package of a file: one rule per known target, formulas with aliased sources, a zero rule
    where a source is missing or the formula still names its result, and for every target without a rule."""
    f = _fields(s, d)
    rules = evaluation.first_rules(evaluation.normal_rules(_rules(f)))
    targets = evaluation.field_specs(f.where("target").select("package", "field_name", F.lit("").alias("path"), F.lit("").alias("protocol"), F.lit("").alias("file_name"), "bit_length", F.lit("").alias("default_value")))
    return graph.assembled(rules, targets, "src")
