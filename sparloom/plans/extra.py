"""Queries that complete the inventory: validation, sets, merges, scores, retrieval chains (VAL, CLN, SPL, JOIN, AGG, RANK, SET, FN, MSG, SRC, SNK, STR)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparloom.operators.cleaning import once
from sparloom.operators.rules import Rule, completed, convert
from sparloom.sources.tables import table
from sparloom.streaming import messages as M

QUERIES, SQL = {}, {}
_B = "(select distinct block_id, project_id, file_name, page_num, content, block_type, cleaned_content from blocks)"
_C = "(select distinct chunk_id, project_id, dataset_id, source_block_ids, semantic_type, content_snapshot, metadata.token_estimate as token_estimate, metadata.quality_score as quality_score, metadata.protocol_anchor as anchor from chunks)"
_Q = "(select distinct qa_id, dataset_id, source_block_ids, question, answer, qa_task_type, conversion_mode, instruction, is_low_quality, protocol_type from qa_pairs)"
_F = "(select block_id, unnest(pf, recursive := true) from (select block_id, any_value(protocol_fields) as pf from blocks group by 1))"
_J = "(select distinct job_id, status, base_model, dataset_id, config, progress from finetune_jobs)"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _blocks(s, d):
    return once(table(s, d, "blocks"))


def _chunks(s, d):
    return table(s, d, "chunks").drop("loaded_at").dropDuplicates(["chunk_id"])


def _qa(s, d):
    return table(s, d, "qa_pairs").drop("loaded_at").dropDuplicates(["qa_id"])


def _jobs(s, d):
    return table(s, d, "finetune_jobs").drop("loaded_at").dropDuplicates(["job_id"])


def _fields(s, d):
    return _blocks(s, d).select("block_id", "project_id", F.posexplode("protocol_fields").alias("pos", "f")).select("block_id", "project_id", "pos", "f.*").where("field_name is not null")


@query(f"select project_id, count(*) as total, count(*) filter (length(trim(content)) >= 20) as passed, count(*) filter (content is null or length(trim(content)) < 20) as failed from {_B} group by 1")
def val_05_batch_summary(s, d):
    ok = F.coalesce(F.char_length(F.trim("content")) >= 20, F.lit(False))
    return _blocks(s, d).groupBy("project_id").agg(F.count("*").alias("total"), F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"))


@query(f"""with f as (select block_id, generate_subscripts(pf, 1) - 1 as pos, unnest(pf) as x from (select block_id, any_value(protocol_fields) as pf from blocks group by 1)), g as (select block_id, pos, x.field_name as field_name, x.bit_start as bs, x.bit_length as bl, x.range_min as lo, x.range_max as hi, x.formula as fm, x.meaning as mn, row_number() over (partition by upper(trim(x.field_name)) order by block_id, pos) as r from f where x.field_name is not null)
  select g.block_id, g.pos::int as pos, g.field_name, g.field_name = o.field_name as name_ok, g.bl is null or o.bl is null or g.bl = o.bl as width_ok, g.bs is null or o.bs is null or g.bs = o.bs as start_ok, (g.lo is null or o.lo is null or g.lo >= o.lo) and (g.hi is null or o.hi is null or g.hi <= o.hi) as range_ok,
  regexp_replace(coalesce(g.fm, ''), '\\s', '', 'g') = regexp_replace(coalesce(o.fm, ''), '\\s', '', 'g') as formula_ok, g.mn is null or o.mn is null or lower(trim(g.mn)) = lower(trim(o.mn)) as meaning_ok from g join (select * from g where r = 1) o on upper(trim(g.field_name)) = upper(trim(o.field_name))""")
def val_07_schema_checks(s, d):
    """VAL-07: each field against the schema, here the first of its name: name, width, first bit, range, formula, meaning; what
    either side leaves open is no fault."""
    key = F.upper(F.trim("field_name"))
    f = _fields(s, d).withColumn("key", key)
    cols = ["field_name", "bit_start", "bit_length", "range_min", "range_max", "formula", "meaning"]
    schema = f.groupBy("key").agg(F.min_by(F.struct(*cols), F.struct("block_id", "pos")).alias("o"))
    open_or = lambda c, ok: F.col(c).isNull() | F.col(f"o.{c}").isNull() | ok
    same = lambda c: open_or(c, F.col(c) == F.col(f"o.{c}"))
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s", "")
    j = f.join(schema, "key")
    return j.select(
        "block_id", "pos", "field_name", (F.col("field_name") == F.col("o.field_name")).alias("name_ok"), same("bit_length").alias("width_ok"), same("bit_start").alias("start_ok"),
        (open_or("range_min", F.col("range_min") >= F.col("o.range_min")) & open_or("range_max", F.col("range_max") <= F.col("o.range_max"))).alias("range_ok"), (bare(F.col("formula")) == bare(F.col("o.formula"))).alias("formula_ok"),
        open_or("meaning", F.lower(F.trim("meaning")) == F.lower(F.trim("o.meaning"))).alias("meaning_ok"),
    )


@query(f"select name, count(*) as times from (select name from datasets) group by 1 having count(*) > 1")
def val_13_unique_names(s, d):
    return table(s, d, "datasets").groupBy("name").agg(F.count("*").alias("times")).where("times > 1")


@query(f"select distinct formula, len(list_filter(regexp_extract_all(formula, '[A-Za-z_][A-Za-z0-9_]*'), lambda x: x not in ('value', 'raw', 'bits', 'abs', 'round', 'min', 'max')))::int as foreign_names from {_F} where formula is not null")
def val_14_whitelist(s, d):
    """VAL-14: names in formulas that the language does not know."""
    n = F.filter(F.regexp_extract_all("formula", F.lit("([A-Za-z_][A-Za-z0-9_]*)"), 1), lambda x: ~x.isin("value", "raw", "bits", "abs", "round", "min", "max"))
    return _fields(s, d).where("formula is not null").select("formula", F.size(n).alias("foreign_names")).distinct()


@query(f"with c as (select chunk_id, dataset_id, coalesce(anchor, '') as a, max((coalesce(anchor, '') like 'JG%')::int) over (partition by dataset_id) as has from {_C}) select chunk_id from c where a like 'JG%' or has = 0")
def val_17_fallback_filter(s, d):
    """VAL-17: chunks of a dataset that match, all of it where none does."""
    hit = F.coalesce(F.col("metadata.protocol_anchor"), F.lit("")).startswith("JG")
    c = _chunks(s, d).select("chunk_id", "dataset_id", hit.alias("hit"))
    per = c.groupBy("dataset_id").agg(F.max("hit").alias("has"))
    return c.join(per, "dataset_id").where("hit or not has").select("chunk_id")


@query(f"select job_id, status from {_J} where status is null or status in ('completed', 'running')")
def val_18_status(s, d):
    return _jobs(s, d).where(F.col("status").isNull() | F.col("status").isin("completed", "running")).select("job_id", "status")


@query(rf"with t as (select doc_id, regexp_replace(text, '([^\p{{L}}\p{{N}}_]|^)([A-Z]{{1,2}}[0-9]+\.[0-9]+)', '\1' || chr(1) || '\2', 'g') as t from documents where text is not null), p as (select doc_id, unnest(string_split(t, chr(1))) as part from t) select doc_id, count(*)::bigint as parts, sum(length(part))::bigint as chars from p where length(part) >= 200 group by 1")
def spl_06_long_parts(s, d):
    """SPL-06: documents split before each message code, parts under 200 characters dropped."""
    marked = F.regexp_replace("text", r"([^\p{L}\p{N}_]|^)([A-Z]{1,2}[0-9]+\.[0-9]+)", "$1\u0001$2")
    parts = table(s, d, "documents").where("text is not null").select("doc_id", F.explode(F.split(marked, "\u0001")).alias("part")).where(F.char_length("part") >= 200)
    return parts.groupBy("doc_id").agg(F.count("*").alias("parts"), F.sum(F.char_length("part")).alias("chars"))


@query(f"""with f as (select block_id, generate_subscripts(pf, 1) as pos, unnest(pf) as x from (select block_id, any_value(protocol_fields) as pf from blocks group by 1)), g as (select block_id, pos, x.field_name as field_name, x.bit_length as bl, x.formula as fm, x.meaning as mn, row_number() over (partition by x.field_name order by block_id, pos) as r from f where x.field_name is not null)
  select block_id, (pos - 1)::int as pos, field_name, coalesce(g.bl, o.bl) as bits, coalesce(g.fm, o.fm) as formula, coalesce(g.mn, o.mn) as meaning from g join (select field_name, bl, fm, mn from g where r = 1) o using (field_name)""")
def spl_15_filled(s, d):
    """SPL-15: each field as it stands, its blanks filled from the first field of that name."""
    f = _fields(s, d).select("block_id", "pos", "field_name", "bit_length", "formula", "meaning")
    first = f.groupBy("field_name").agg(F.min_by(F.struct("bit_length", "formula", "meaning"), F.struct("block_id", "pos")).alias("o"))
    j = f.join(first, "field_name")
    return j.select("block_id", "pos", "field_name", F.coalesce("bit_length", "o.bit_length").alias("bits"), F.coalesce("formula", "o.formula").alias("formula"), F.coalesce("meaning", "o.meaning").alias("meaning"))


@query(f"select block_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:8], ',') as candidates from (select block_id, regexp_extract_all(content, '[A-Z][A-Z0-9]+_[A-Z0-9_]+') as l from {_B} where content is not null)")
def spl_18_candidates(s, d):
    """SPL-18: distinct field names a text mentions, in order, eight at most."""
    n = F.array_distinct(F.regexp_extract_all("content", F.lit("([A-Z][A-Z0-9]+_[A-Z0-9_]+)"), 1))
    return _blocks(s, d).where("content is not null").select("block_id", F.array_join(F.slice(n, 1, 8), ",").alias("candidates"))


@query("select c_custkey, 'none' as status from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000) union all select distinct o_custkey, 'has' from orders where o_totalprice > 300000")
def join_13_defaults(s, d):
    """JOIN-13: a default row for every key without one of its own."""
    o = table(s, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")).distinct()
    rest = table(s, d, "customer").select("c_custkey").join(o, "c_custkey", "left_anti").select("c_custkey", F.lit("none").alias("status"))
    return rest.unionByName(o.select("c_custkey", F.lit("has").alias("status")))


@query(f"select qa_task_type, count(*) as cases, count(*) filter (dataset_id in (select dataset_id from datasets)) as known, count(*) filter (dataset_id not in (select dataset_id from datasets)) as skipped from {_Q} where dataset_id is not null group by 1")
def join_16_skips(s, d):
    """JOIN-16/AGG-20: matches and misses counted."""
    known = table(s, d, "datasets").select("dataset_id", F.lit(1).alias("k")).dropDuplicates(["dataset_id"])
    return _qa(s, d).where("dataset_id is not null").join(known, "dataset_id", "left").groupBy("qa_task_type").agg(F.count("*").alias("cases"), F.count("k").alias("known"), F.count_if(F.col("k").isNull()).alias("skipped"))


@query("select p.p_partkey as p_partkey, s.s_suppkey as s_suppkey from part p join supplier s on starts_with(p.p_partkey::varchar, s.s_suppkey::varchar) qualify row_number() over (partition by p.p_partkey order by length(s.s_suppkey::varchar) desc) = 1")
def join_19_longest_prefix(s, d):
    """JOIN-19: the longest key that begins a text; prefixes are exploded, so it is an equi join."""
    p = table(s, d, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("t"))
    pre = p.select("p_partkey", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("t")), lambda n: F.left(F.col("t"), n))).alias("prefix"))
    su = table(s, d, "supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("prefix"))
    return pre.join(su, "prefix").groupBy("p_partkey").agg(F.max_by("s_suppkey", F.char_length("prefix")).alias("s_suppkey"))


@query(f"""with t as (select distinct file_name, field_name from {_B} join {_F} using (block_id) where block_type = 'table' and field_name is not null), u as (select distinct file_name, field_name from {_B} join {_F} using (block_id) where block_type <> 'table' and field_name is not null), a as (select file_name, list(field_name) as l from t group by 1), b as (select file_name, list(field_name) as l from u group by 1)
  select coalesce(a.file_name, b.file_name) as file_name, array_to_string(list_sort(list_filter(coalesce(a.l, []), lambda x: not list_contains(coalesce(b.l, []), x))), ',') as missing, array_to_string(list_sort(list_filter(coalesce(b.l, []), lambda x: not list_contains(coalesce(a.l, []), x))), ',') as unexpected from a full join b using (file_name)""")
def agg_05_missing_fields(s, d):
    """AGG-05: per file the fields its tables name and its text doesn't, and the other way round."""
    f = _fields(s, d).join(_blocks(s, d).select("block_id", "file_name", (F.col("block_type") == "table").alias("t")), "block_id")
    g = f.groupBy("file_name").agg(F.collect_set(F.when(F.col("t"), F.col("field_name"))).alias("a"), F.collect_set(F.when(~F.col("t"), F.col("field_name"))).alias("b"))
    less = lambda x, y: F.array_join(F.array_sort(F.array_except(x, y)), ",")
    return g.select("file_name", less("a", "b").alias("missing"), less("b", "a").alias("unexpected"))


@query(f"select count(*) as chunks, count(distinct project_id) as projects, count(distinct dataset_id) as datasets, count(distinct anchor) as anchors from {_C}")
def agg_17_graph_summary(s, d):
    return _chunks(s, d).agg(F.count("*").alias("chunks"), F.count_distinct("project_id").alias("projects"), F.count_distinct("dataset_id").alias("datasets"), F.count_distinct("metadata.protocol_anchor").alias("anchors"))


@query(f"select qa_id, array_to_string(list_filter(source_block_ids, lambda x, i: list_position(source_block_ids, x) = i), ',') as kept from {_Q} where source_block_ids is not null")
def agg_18_distinct_order(s, d):
    """AGG-18: distinct ids in the order they are first named."""
    return _qa(s, d).where("source_block_ids is not null").select("qa_id", F.array_join(F.array_distinct("source_block_ids"), ",").alias("kept"))


@query("""with q as (select vec_id as qid, embedding::double[] as qe, label as ql from embeddings where vec_id % 100 = 0), s as (select qid, ql, vec_id, label, list_cosine_similarity(embedding::double[], qe) as score from embeddings, q), t as (select * from s qualify row_number() over (partition by qid order by round(score, 9) desc, vec_id) <= 20)
  select qid as query_id, vec_id, round(score, 4) as score, label from t qualify row_number() over (partition by qid order by (label = ql)::int desc, round(score, 9) desc, vec_id) <= 5""")
def vec_03_rerank(s, d):
    """VEC-03/RANK-03: for every id divisible by 100 the top 20 by cosine, reranked by a second score, top 5."""
    from sparloom.operators.retrieval import search

    e = table(s, d, "embeddings")
    q = e.where("vec_id % 100 = 0")
    top = search(e, q, 20).join(e.select("vec_id", "label"), "vec_id").join(q.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    r = F.row_number().over(W.partitionBy("query_id").orderBy((F.col("label") == F.col("own")).desc(), F.round("score", 9).desc(), "vec_id"))
    return top.withColumn("r", r).where("r <= 5").select("query_id", "vec_id", F.round("score", 4).alias("score"), "label")


@query("select p_partkey, source from (select p_partkey, source, row_number() over (partition by p_partkey order by pri) as r from (select p_partkey, 'large' as source, 1 as pri from part where p_size > 40 union all select p_partkey, 'seven', 2 from part where p_size % 7 = 0 union all select p_partkey, 'zero', 3 from part)) where r = 1")
def set_01_priority_union(s, d):
    """SET-01: union of sources, the first that has the key wins."""
    p = table(s, d, "part")
    u = p.where("p_size > 40").select("p_partkey", F.lit("large").alias("source"), F.lit(1).alias("pri")).unionByName(p.where("p_size % 7 = 0").select("p_partkey", F.lit("seven").alias("source"), F.lit(2).alias("pri"))).unionByName(p.select("p_partkey", F.lit("zero").alias("source"), F.lit(3).alias("pri")))
    return u.groupBy("p_partkey").agg(F.min_by("source", "pri").alias("source"))


@query(f"select project_id, count(distinct content) as texts, count(*) as blocks from {_B} where content is not null group by 1")
def set_04_distinct_contents(s, d):
    """SET-04: distinct contents; hashed before the distinct count."""
    b = _blocks(s, d).where("content is not null").select("project_id", F.sha2(F.encode("content", "utf-8"), 256).alias("h"))
    per = b.groupBy("project_id", "h").agg(F.count("*").alias("n"))
    return per.groupBy("project_id").agg(F.count("*").alias("texts"), F.sum("n").alias("blocks"))


@query(f"select qa_id, md5('<|user|>' || question || '<|assistant|>' || coalesce(answer, '')) as chat_md5 from {_Q}")
def fn_27_chat_text(s, d):
    t = F.concat(F.lit("<|user|>"), F.col("question"), F.lit("<|assistant|>"), F.coalesce("answer", F.lit("")))
    return _qa(s, d).select("qa_id", F.md5(F.encode(t, "utf-8")).alias("chat_md5"))


@query(f"select qa_id, least(length(coalesce(answer, '')), 400) as answer_kept, least(length(question), 512 - least(length(coalesce(answer, '')), 400)) as prompt_kept from {_Q}")
def msg_18_budget(s, d):
    """MSG-18: the response is kept, the prompt cut to what is left of the budget."""
    a = F.least(F.char_length(F.coalesce("answer", F.lit(""))), F.lit(400))
    return _qa(s, d).select("qa_id", a.cast("bigint").alias("answer_kept"), F.least(F.char_length("question"), F.lit(512) - a).cast("bigint").alias("prompt_kept"))


@query("select distinct regexp_replace(field_name, '_(RAW|MIN|MAX|MEAN|REF|VAL|CNT|IDX|LVL|CODE|TYPE|FLAG|STAT|UNIT|RATE|MSB|LSB)(_[0-9]+)?$', '') as concept, field_name from " + _F + " where field_name is not null")
def fn_22_concepts(s, d):
    """FN-22: concept of a field by its name without suffixes."""
    c = F.regexp_replace("field_name", "_(RAW|MIN|MAX|MEAN|REF|VAL|CNT|IDX|LVL|CODE|TYPE|FLAG|STAT|UNIT|RATE|MSB|LSB)(_[0-9]+)?$", "")
    return _fields(s, d).select(c.alias("concept"), "field_name").distinct()


@query("select event_id, case when value > 90 then 'high' when event_type = 'error' then 'error' when value < 5 then 'low' else 'normal' end as response from events")
def msg_11_response(s, d):
    """MSG-11: response code, conditions in order, default last."""
    v = F.col("value")
    return table(s, d, "events").select("event_id", F.when(v > 90, "high").when(F.col("event_type") == "error", "error").when(v < 5, "low").otherwise("normal").alias("response"))


@query("""select o_orderkey, o_totalprice::double * 2 as "A", 0.0::double as "B", 0.0::double as "C" from orders""")
def msg_17_completed(s, d):
    """MSG-17: targets without a rule get 0."""
    o = table(s, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    return convert(o, completed([Rule("A", "o_totalprice * 2", ("o_totalprice",))], ["a", "b", "c"]), "o_orderkey")


@query("select event_id as id, 5::bigint + event_id % 10 as step, value as loss from events")
def str_06_training_log(s, d):
    """STR-06: log lines to progress records."""
    e = table(s, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("step="), (F.col("event_id") % 10 + 5).cast("string"), F.lit(" loss="), F.format_string("%.2f", "value")).alias("line"))
    return M.training_log(e).select("id", "step", "loss")


@query("select user_id, event_type, window_start, n, total from (select user_id, event_type, time_bucket(interval '1 hour', ts) as window_start, count(*) as n, round(sum(value), 2) as total from events group by 1, 2, 3)")
def str_05_windows(s, d):
    """STR-05: counts and sums in windows of an hour."""
    e = table(s, d, "events")
    return e.groupBy("user_id", "event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select("user_id", "event_type", F.col("w.start").alias("window_start"), "n", "total")


@query("select n_regionkey, n_nationkey, count(*) as customers, grouping(n_nationkey)::int as lvl from customer join nation on n_nationkey = c_nationkey group by rollup (n_regionkey, n_nationkey)")
def agg_rollup(s, d):
    """Roll-up over two levels."""
    c = table(s, d, "customer").join(F.broadcast(table(s, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    return c.rollup("n_regionkey", "n_nationkey").agg(F.count("*").alias("customers"), F.grouping("n_nationkey").cast("int").alias("lvl"))


@query("select doc_id, source, n_chars from documents order by n_chars desc nulls last, doc_id limit 40")
def sort_01_top(s, d):
    """SORT-01/LIM-01: ordered slice."""
    return table(s, d, "documents").orderBy(F.desc_nulls_last("n_chars"), "doc_id").limit(40).select("doc_id", "source", "n_chars")
