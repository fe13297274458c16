"""Queries of block features, gates, joins, sets, rankings and windows over the document tables (FN, AGG, VAL, JOIN, RANK, WIN, SET, SPL, SNK)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparloom.functions import features as X
from sparloom.functions.text import tokens
from sparloom.operators.blocks import block_features, budget_split, chunk_rollup, group_blocks
from sparloom.operators.cleaning import once
from sparloom.operators.orphans import plain_number
from sparloom.sources.tables import table

QUERIES, SQL = {}, {}
_B = "(select distinct block_id, project_id, file_name, page_num, content, block_type, cleaned_content from blocks)"
_C = "(select distinct chunk_id, project_id, dataset_id, source_block_ids, semantic_type, content_snapshot, metadata.token_estimate as token_estimate, metadata.block_count as block_count, metadata.quality_score as quality_score, created_at from chunks)"
_Q = "(select distinct qa_id, dataset_id, source_block_ids, question, answer, qa_task_type, conversion_mode, instruction, is_low_quality, quality_reason, created_at from qa_pairs)"


_ANCHOR = r"'(?i)(?:^|[^\p{L}\p{N}_])([A-Z]{1,2}\d+\.\d+[A-Z]?\d*)(?:$|[^\p{L}\p{N}_])'"
#: Blanks of any kind at both ends.
_ENDS = r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$"


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


@query(f"select block_id, coalesce(length(content), 0) // 3 as tokens from {_B}")
def fn_01_tokens(s, d):
    return _blocks(s, d).select("block_id", tokens(F.col("content")).alias("tokens"))


@query(rf"select chunk_id, upper(coalesce(nullif(regexp_extract(metadata.protocol_anchor, {_ANCHOR}, 1), ''), nullif(regexp_extract(content_snapshot, {_ANCHOR}, 1), ''), '')) as anchor from (select chunk_id, any_value(metadata) as metadata, any_value(content_snapshot) as content_snapshot from chunks group by 1)")
def fn_02_anchor(s, d):
    """FN-02: the message anchor of a chunk, of its metadata before its text."""
    return _chunks(s, d).select("chunk_id", X.anchor(F.col("content_snapshot"), F.col("metadata.protocol_anchor")).alias("anchor"))


@query(rf"select block_id, len(regexp_extract_all(content, '-?\d+\s*(?:=|->|→)\s*[A-Za-z_][A-Za-z0-9_./\-]*'))::int as pairs from {_B} where content is not null")
def fn_04_mapping_pairs(s, d):
    return _blocks(s, d).where("content is not null").select("block_id", X.mapping_pairs(F.col("content")).alias("pairs"))


@query()
def fn_05_noise_penalty(s, d):
    return _blocks(s, d).select("block_id", X.noise_penalty(F.col("content"), F.col("block_type"), F.coalesce(F.size("protocol_fields") > 0, F.lit(False))).alias("noise"))


@query(f"""select block_id, case when block_type = 'table' then 'table_data' when block_type = 'code' then 'code_example'
  when regexp_matches(t, '字段|field|位宽|bit|范围|range|单位|unit') then 'field_definition' when regexp_matches(t, '公式|formula|计算|calculate|转换|convert|映射|map') then 'conversion_rule'
  when regexp_matches(t, '协议|protocol|概述|overview|用途|purpose|介绍|introduction') then 'protocol_description' else 'general_content' end as semantic
  from (select block_id, block_type, lower(coalesce(content, '')) as t from {_B})""")
def fn_07_semantic_type(s, d):
    return _blocks(s, d).select("block_id", X.semantic_type(F.col("content"), F.col("block_type")).alias("semantic"))


@query("select block_id, len(list_filter(f, lambda x: trim(coalesce(x.formula, '')) <> ''))::int as formulas, len(list_filter(f, lambda x: x.bit_start is not null or x.bit_length is not null))::int as bits, len(list_filter(f, lambda x: x.range_min is not null or x.range_max is not null))::int as ranges from (select block_id, any_value(protocol_fields) as f from blocks where protocol_fields is not null group by 1)")
def agg_01_field_counts(s, d):
    n = X.field_counts(F.col("protocol_fields"))
    return _blocks(s, d).where("protocol_fields is not null").select("block_id", *[n[k].alias(k) for k in ("formulas", "bits", "ranges")])


def _members(s, d):
    return _chunks(s, d).select("chunk_id", F.posexplode("source_block_ids").alias("pos", "block_id"))


@query()
def agg_02_chunk_rollup(s, d):
    return chunk_rollup(block_features(_blocks(s, d)), _members(s, d))


@query()
def fn_06_evidence(s, d):
    return block_features(_blocks(s, d)).select("block_id", "evidence", "formulas", F.array_join("names", ",").alias("names"))


@query(f"select project_id, count(*) filter (block_type = 'table') as tables, count(*) filter (block_type = 'text') as texts, count(*) filter (block_type = 'code') as codes, count(*) as blocks from {_B} group by 1")
def agg_03_block_counts(s, d):
    n = lambda k: F.count_if(F.col("block_type") == k)
    return _blocks(s, d).groupBy("project_id").agg(n("table").alias("tables"), n("text").alias("texts"), n("code").alias("codes"), F.count("*").alias("blocks"))


@query()
def win_03_scored_groups(s, d):
    return group_blocks(block_features(_blocks(s, d)))


@query()
def win_04_budget_groups(s, d):
    return group_blocks(block_features(_blocks(s, d)), scored=False)


@query()
def win_05_oversize_split(s, d):
    return budget_split(block_features(_blocks(s, d)))


@query(f"""with r as (select block_id, project_id, file_name, content, coalesce(sum(length(content)) over (partition by project_id, file_name order by page_num nulls first, block_id rows between unbounded preceding and 1 preceding), 0) as before from {_B} where content is not null)
  select block_id, case when before + length(content) > 500 then content[1:(500 - before)] || '...' else content end as shown from r where before < 500""")
def win_06_prefix(s, d):
    """WIN-06: of a file's concatenated contents the first 500 characters."""
    w = W.partitionBy("project_id", "file_name").orderBy(F.asc_nulls_first("page_num"), "block_id").rowsBetween(W.unboundedPreceding, -1)
    r = _blocks(s, d).where("content is not null").select("block_id", "content", F.coalesce(F.sum(F.char_length("content")).over(w), F.lit(0)).alias("before")).where("before < 500")
    return r.select("block_id", F.when(F.col("before") + F.char_length("content") > 500, F.concat(F.expr("substring(content, 1, 500 - before)"), F.lit("..."))).otherwise(F.col("content")).alias("shown"))


@query(f"""with l as (select block_id, unnest(string_split(content, E'\\n')) as line, generate_subscripts(string_split(content, E'\\n'), 1) as i from {_B} where content is not null),
  p as (select *, lag(trim(line, ' ')) over (partition by block_id order by i) as before from l) select block_id, i::int as line_no from p where trim(line, ' ') <> '' and trim(line, ' ') = before""")
def win_02_repeated_lines(s, d):
    """WIN-02: lines that equal the line before them."""
    lines = _blocks(s, d).where("content is not null").select("block_id", F.posexplode(F.split("content", "\n")).alias("p", "line")).withColumn("line", F.trim("line"))
    before = F.lag("line").over(W.partitionBy("block_id").orderBy("p"))
    return lines.withColumn("before", before).where("line <> '' and line = before").select("block_id", (F.col("p") + 1).alias("line_no"))


@query("""with f as (select block_id, unnest(pf, recursive := true) from (select block_id, any_value(protocol_fields) as pf from blocks group by 1)),
  w as (select block_id, field_name, bit_start, bit_start + bit_length - 1 as bit_end, lead(bit_start) over (partition by block_id order by bit_start, bit_start + bit_length - 1, field_name) as nxt from f where bit_start is not null and bit_length is not null)
  select block_id, field_name, bit_start, bit_end from w where nxt <= bit_end""")
def win_01_bit_overlap(s, d):
    """WIN-01: fields of a block whose bits reach into the next field's."""
    f = _blocks(s, d).select("block_id", F.explode("protocol_fields").alias("f")).select("block_id", "f.*").where("bit_start is not null and bit_length is not null").withColumn("bit_end", F.col("bit_start") + F.col("bit_length") - 1)
    nxt = F.lead("bit_start").over(W.partitionBy("block_id").orderBy("bit_start", "bit_end", "field_name"))
    return f.withColumn("nxt", nxt).where("nxt <= bit_end").select("block_id", "field_name", "bit_start", "bit_end")


_JOINED = f"""with u as (select chunk_id, unnest(source_block_ids) as block_id, generate_subscripts(source_block_ids, 1) as pos from {_C}),
  t as (select chunk_id, string_agg(coalesce(nullif(trim(cleaned_content), ''), content), E'\\n' order by pos) as joined from u join {_B} using (block_id) where coalesce(nullif(trim(cleaned_content), ''), content) is not null group by 1)"""


@query(_JOINED + f" select c.chunk_id, length(coalesce(nullif(joined, ''), content_snapshot, '')) as chars, md5(coalesce(nullif(joined, ''), content_snapshot, '')) as text_md5 from {_C} c left join t using (chunk_id)")
def join_01_chunk_text(s, d):
    """JOIN-01: chunk texts from their blocks in list order, else the snapshot. The list join is salted by position."""
    text = F.coalesce(F.nullif(F.trim("cleaned_content"), F.lit("")), F.col("content"))
    b = _blocks(s, d).select("block_id", text.alias("text")).where("text is not null")
    joined = _members(s, d).join(b, "block_id").groupBy("chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("joined"))
    whole = F.coalesce(F.nullif("joined", F.lit("")), "content_snapshot", F.lit(""))
    return _chunks(s, d).join(joined, "chunk_id", "left").select("chunk_id", F.char_length(whole).cast("bigint").alias("chars"), F.md5(F.encode(whole, "utf-8")).alias("text_md5"))


@query(f"with u as (select chunk_id, unnest(source_block_ids) as block_id, generate_subscripts(source_block_ids, 1) - 1 as pos from {_C}) select chunk_id, pos::int as pos, block_id, file_name, block_type from u join {_B} using (block_id)")
def join_02_id_list(s, d):
    return _members(s, d).join(_blocks(s, d).select("block_id", "file_name", "block_type"), "block_id").select("chunk_id", "pos", "block_id", "file_name", "block_type")


@query(f"""select project_id, coalesce(nullif(trim(file_name), ''), 'unnamed') as file_name, count(*) as blocks, array_to_string(list_sort(list_distinct(list(page_num) filter (page_num is not null))), ',') as pages, sha256(string_agg(block_id::varchar, ',' order by page_num nulls first, block_id)) as content_hash,
  md5(string_agg(content, E'\\n' order by page_num nulls first, block_id)) as text_md5 from {_B} group by 1, 2""")
def agg_12_doc_sets(s, d):
    """AGG-11/12: blocks of a file in order as one text, its pages, and a hash over its ids."""
    name = F.coalesce(F.nullif(F.trim("file_name"), F.lit("")), F.lit("unnamed"))
    rows = F.array_sort(F.collect_list(F.struct(F.coalesce("page_num", F.lit(-1)).alias("p"), "block_id", "content")))
    g = _blocks(s, d).groupBy("project_id", name.alias("file_name")).agg(F.count("*").alias("blocks"), F.array_join(F.array_sort(F.collect_set("page_num")), ",").alias("pages"), rows.alias("rows"))
    ids = F.array_join(F.transform("rows", lambda x: x["block_id"].cast("string")), ",")
    texts = F.filter(F.transform("rows", lambda x: x["content"]), lambda x: x.isNotNull())
    return g.select("project_id", "file_name", "blocks", "pages", F.sha2(F.encode(ids, "utf-8"), 256).alias("content_hash"), F.when(F.size(texts) > 0, F.md5(F.encode(F.array_join(texts, "\n"), "utf-8"))).alias("text_md5"))


@query(rf"""with q as (select qa_id, qa_task_type, regexp_replace(question, '{_ENDS}', '', 'g') as q, regexp_replace(coalesce(answer, ''), '{_ENDS}', '', 'g') as a from {_Q})
  select qa_id, length(q) < 8 or length(a) < 6 or not regexp_matches(a, '[0-9]') as low,
  concat_ws('; ', case when length(q) < 8 then 'question short' end, case when length(a) < 6 then 'answer short' end, case when not regexp_matches(a, '[0-9]') then 'no figure' end, case when regexp_matches(a, '可能|也许|大概|不确定|不清楚') then 'vague' end) as reasons from q where qa_task_type <> 'protocol_conversion'
  union all select qa_id, length(q) < 8 or length(a) < 3 or not (regexp_matches(a, '[0-9]\s*[-+*/]\s*[0-9A-Za-z(]|[A-Za-z_)]\s*[*/+]\s*[0-9A-Za-z(]') or regexp_matches(a, '=|->|→')), concat_ws('; ', case when length(q) < 8 then 'question short' end, case when length(a) < 3 then 'no formula' end,
  case when not (regexp_matches(a, '[0-9]\s*[-+*/]\s*[0-9A-Za-z(]|[A-Za-z_)]\s*[*/+]\s*[0-9A-Za-z(]') or regexp_matches(a, '=|->|→')) then 'nothing to compute' end) from q where qa_task_type = 'protocol_conversion'""")
def val_12_qa_gate(s, d):
    """VAL-12: question under 8 characters; answers under 6 or without a figure, vague words noted only; answers of conversion
    pairs need something to compute or to map."""
    strip = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), _ENDS, "")
    q, a = strip(F.col("question")), strip(F.col("answer"))
    short_q, short_a, none, short_f = F.char_length(q) < 8, F.char_length(a) < 6, ~a.rlike("[0-9]"), F.char_length(a) < 3
    idle = ~(a.rlike(r"[0-9]\s*[-+*/]\s*[0-9A-Za-z(]|[A-Za-z_)]\s*[*/+]\s*[0-9A-Za-z(]") | a.rlike("=|->|→"))
    text = F.concat_ws("; ", F.when(short_q, "question short"), F.when(short_a, "answer short"), F.when(none, "no figure"), F.when(a.rlike("可能|也许|大概|不确定|不清楚"), "vague"))
    rule = F.concat_ws("; ", F.when(short_q, "question short"), F.when(short_f, "no formula"), F.when(idle, "nothing to compute"))
    conversion = F.col("qa_task_type") == "protocol_conversion"
    return _qa(s, d).where("qa_task_type is not null").select("qa_id", F.when(conversion, short_q | short_f | idle).otherwise(short_q | short_a | none).alias("low"), F.when(conversion, rule).otherwise(text).alias("reasons"))


@query("""with f as (select block_id, unnest(pf, recursive := true) from (select block_id, any_value(protocol_fields) as pf from blocks group by 1))
  select block_id, field_name, bit_start, coalesce(bit_length is not null and range_min is not null and range_max is not null and pow(2, bit_length) >= range_max - range_min, false) as covers, coalesce(bit_length > 0, false) as width_ok,
  range_min is null or range_max is null or range_min < range_max as range_ok from f where field_name is not null""")
def val_06_field_rules(s, d):
    """VAL-06: the width covers the range, the width is positive, the range is in order; nothing known fails the first."""
    f = _blocks(s, d).select("block_id", F.explode("protocol_fields").alias("f")).select("block_id", "f.*").where("field_name is not null")
    covers = F.pow(F.lit(2.0), F.col("bit_length")) >= F.col("range_max") - F.col("range_min")
    ok = F.col("range_min").isNull() | F.col("range_max").isNull() | (F.col("range_min") < F.col("range_max"))
    return f.select("block_id", "field_name", "bit_start", F.coalesce(covers, F.lit(False)).alias("covers"), F.coalesce(F.col("bit_length") > 0, F.lit(False)).alias("width_ok"), ok.alias("range_ok"))


@query(f"""with b as (select *, regexp_matches(coalesce(content, ''), 'Orlink') as hit from {_B}), h as (select distinct project_id, file_name, unnest([page_num - 1, page_num, page_num + 1]) as page_num from b where hit and page_num is not null), p as (select project_id, bool_or(hit) as named from b group by 1)
  select block_id from b join p using (project_id) where not named or hit or exists (select 1 from h where h.project_id = b.project_id and h.file_name = b.file_name and h.page_num = b.page_num)""")
def val_15_page_window(s, d):
    """VAL-15: of each project the blocks that name the target and those within a page of them; all blocks where none does."""
    b = _blocks(s, d).withColumn("hit", F.coalesce(F.col("content").contains("Orlink"), F.lit(False)))
    pages = b.where("hit and page_num is not null").select("project_id", "file_name", F.explode(F.sequence(F.col("page_num") - 1, F.col("page_num") + 1)).alias("page_num")).distinct().withColumn("near", F.lit(True))
    some = b.groupBy("project_id").agg(F.max("hit").alias("some"))
    return b.join(some, "project_id").join(pages, ["project_id", "file_name", "page_num"], "left").where("not some or hit or near").select("block_id")


@query(f"""with c as (select dataset_id, chunk_id, coalesce(quality_score, 0) as q, coalesce(token_estimate, 0) as t from {_C} where dataset_id is not null),
  u as (select dataset_id, chunk_id, 'understanding' as part from c qualify row_number() over (partition by dataset_id order by q desc, chunk_id) <= 3),
  v as (select dataset_id, chunk_id, 'conversion' as part from c anti join u using (dataset_id, chunk_id) qualify row_number() over (partition by dataset_id order by t desc, chunk_id) <= 2),
  w as (select dataset_id, chunk_id, 'fill' as part from c anti join (select * from u union all select * from v) using (dataset_id, chunk_id) qualify row_number() over (partition by dataset_id order by q + t / 100.0 desc, chunk_id) <= 3) select * from u union all select * from v union all select * from w""")
def rank_01_selection(s, d):
    """RANK-01: of each dataset quotas for two tasks out of one ranking each, the second only from what the first left, then
    the best of the rest up to eight."""
    c = _chunks(s, d).where("dataset_id is not null").select("dataset_id", "chunk_id", F.coalesce("metadata.quality_score", F.lit(0.0)).alias("q"), F.coalesce("metadata.token_estimate", F.lit(0)).alias("t"))
    place = lambda by: F.row_number().over(W.partitionBy("dataset_id").orderBy(F.desc(by), "chunk_id"))
    c = c.withColumn("part", F.when(place("q") <= 3, "understanding"))
    left = lambda df, by, n, name: df.withColumn("r", F.row_number().over(W.partitionBy("dataset_id", F.col("part").isNull()).orderBy(F.desc(by), "chunk_id"))).withColumn("part", F.coalesce("part", F.when(F.col("r") <= n, name))).drop("r")
    c = left(left(c, F.col("t"), 2, "conversion"), F.col("q") + F.col("t") / 100.0, 3, "fill")
    return c.where("part is not null").select("dataset_id", "chunk_id", "part")


@query(f"select dataset_id, chunk_id, r::int as r from (select dataset_id, chunk_id, row_number() over (partition by dataset_id order by coalesce(quality_score, 0) desc, chunk_id) as r from {_C}) where r <= 3")
def rank_04_top_per_dataset(s, d):
    r = F.row_number().over(W.partitionBy("dataset_id").orderBy(F.desc(F.coalesce("metadata.quality_score", F.lit(0.0))), "chunk_id"))
    return _chunks(s, d).select("dataset_id", "chunk_id", r.alias("r")).where("r <= 3")


@query(f"""with b as (select block_id, project_id, lower(split_part(coalesce(content, ''), E'\\n', 1)) as title, lower(coalesce(content, '')) as body from {_B}),
  s as (select block_id, project_id, contains(title, 'relative altitude')::int * 4.0::double + contains(title, 'angular velocity')::int * 4.0::double + contains(body, 'relative altitude')::int * 2.0::double + contains(body, 'angular velocity')::int * 2.0::double
  + least(4, contains(body, 'relative')::int + contains(body, 'altitude')::int + contains(body, 'angular')::int + contains(body, 'velocity')::int) * 0.4::double as score from b) select project_id, block_id, round(score, 4) as score from s where score > 0 qualify row_number() over (partition by project_id order by score desc, block_id) <= 6""")
def rank_06_evidence(s, d):
    """RANK-06: points of each query in title (4) and body (2), and of up to four of its words (0.4 each); best six of a project."""
    queries = ["relative altitude", "angular velocity"]
    title, body = F.lower(F.split_part(F.coalesce("content", F.lit("")), F.lit("\n"), F.lit(1))), F.lower(F.coalesce("content", F.lit("")))
    n = lambda text, words: sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))
    score = n(title, queries) * 4.0 + n(body, queries) * 2.0 + F.least(F.lit(4), n(body, [w for q in queries for w in q.split()])) * 0.4
    b = _blocks(s, d).select("project_id", "block_id", F.round(score, 4).alias("score")).where("score > 0")
    return b.withColumn("r", F.row_number().over(W.partitionBy("project_id").orderBy(F.desc("score"), "block_id"))).where("r <= 6").select("project_id", "block_id", "score")


@query("""with f as (select block_id, generate_subscripts(pf, 1) as pos, unnest(pf) as x from (select block_id, any_value(protocol_fields) as pf from blocks group by 1)),
  r as (select block_id, x.field_name as field_name, x.bit_length as bit_length, row_number() over (partition by x.field_name order by (x.formula is not null)::int desc, (x.meaning is not null)::int desc, block_id, pos) as r from f where x.field_name is not null)
  select block_id, field_name, bit_length from r where r = 1""")
def rank_08_best_definition(s, d):
    """RANK-08/09: of several definitions of a field the one with a formula, then a meaning, then the first."""
    f = _blocks(s, d).select("block_id", F.posexplode("protocol_fields").alias("pos", "x")).select("block_id", "pos", "x.*").where("field_name is not null")
    r = F.row_number().over(W.partitionBy("field_name").orderBy(F.col("formula").isNotNull().desc(), F.col("meaning").isNotNull().desc(), "block_id", "pos"))
    return f.withColumn("r", r).where("r = 1").select("block_id", "field_name", "bit_length")


@query(f"""with g as (select block_id, project_id, file_name, page_num, list_distinct(regexp_extract_all(content, '([A-Z][A-Z0-9]+)_', 1)) as names from {_B} where content is not null),
  p as (select block_id, names, lead(names) over (partition by project_id, file_name order by page_num nulls first, block_id) as nxt from g) select block_id, len(list_intersect(names, nxt)) as shared from p where len(list_intersect(names, nxt)) > 0""")
def set_02_shared_names(s, d):
    """SET-02: name stems a block shares with the next block of its file."""
    b = _blocks(s, d).where("content is not null").select("block_id", "project_id", "file_name", "page_num", F.array_distinct(F.regexp_extract_all("content", F.lit("([A-Z][A-Z0-9]+)_"), 1)).alias("names"))
    nxt = F.lead("names").over(W.partitionBy("project_id", "file_name").orderBy(F.asc_nulls_first("page_num"), "block_id"))
    return b.select("block_id", F.size(F.array_intersect("names", nxt)).cast("bigint").alias("shared")).where("shared > 0")


@query(f"""with a as (select distinct unnest(source_block_ids)::varchar as id from {_C}), q as (select distinct nullif(regexp_replace(trim(x), '^[+]?0*([0-9]+)([.]0*)?$', '\\1'), '') as id from (select unnest(source_block_ids) as x from qa_pairs))
  select id, 'chunks only' as side from a where id is not null and id not in (select id from q where id is not null) union all select id, 'pairs only' from q where id is not null and id not in (select id from a where id is not null)""")
def set_03_difference(s, d):
    """SET-03: ids named by chunks and not by QA pairs, in whatever notation, and the other way round."""
    a = _chunks(s, d).select(F.explode(F.col("source_block_ids").cast("array<string>")).alias("id")).where("id is not null").distinct()
    q = _qa(s, d).select(F.explode("source_block_ids").alias("x")).select(plain_number(F.col("x")).alias("id")).where("id is not null").distinct()
    return a.join(q, "id", "left_anti").select("id", F.lit("chunks only").alias("side")).unionByName(q.join(a, "id", "left_anti").select("id", F.lit("pairs only").alias("side")))


@query(f"select dataset_id, count(*) as pairs, count(*) filter (not coalesce(is_low_quality, false)) as good, count(*) filter (coalesce(is_low_quality, false)) as low from {_Q} group by 1")
def agg_15_quality_counts(s, d):
    low = F.coalesce("is_low_quality", F.lit(False))
    return _qa(s, d).groupBy("dataset_id").agg(F.count("*").alias("pairs"), F.count_if(~low).alias("good"), F.count_if(low).alias("low"))


@query(f"select job_id, status, progress.current_step as step, round(100.0 * progress.current_step / progress.total_steps, 4) as percent from (select distinct job_id, status, progress from finetune_jobs) where progress.total_steps > 0")
def fn_25_percent(s, d):
    j = table(s, d, "finetune_jobs").drop("loaded_at").dropDuplicates(["job_id"]).where("progress.total_steps > 0")
    return j.select("job_id", "status", F.col("progress.current_step").alias("step"), F.round(F.lit(100.0) * F.col("progress.current_step") / F.col("progress.total_steps"), 4).alias("percent"))


@query(f"select qa_id, case when qa_task_type = 'protocol_conversion' then 'json' else 'text' end as shape, md5(coalesce(instruction, '') || E'\\n' || question || E'\\n' || coalesce(answer, '')) as row_md5 from {_Q} where not coalesce(is_low_quality, false)")
def snk_05_training_rows(s, d):
    """SNK-05: rows of the training export, low-quality pairs dropped."""
    q = _qa(s, d).where(~F.coalesce("is_low_quality", F.lit(False)))
    row = F.concat(F.coalesce("instruction", F.lit("")), F.lit("\n"), F.col("question"), F.lit("\n"), F.coalesce("answer", F.lit("")))
    return q.select("qa_id", F.when(F.col("qa_task_type") == "protocol_conversion", "json").otherwise("text").alias("shape"), F.md5(F.encode(row, "utf-8")).alias("row_md5"))


@query(f"with l as (select block_id, unnest(string_split(content, E'\\n')) as line, generate_subscripts(string_split(content, E'\\n'), 1) as i from {_B} where block_type = 'table'), p as (select block_id, i, string_split(line, '|') as c from l where len(string_split(line, '|')) >= 3) select block_id, i::int as i, trim(c[1]) as name, try_cast(trim(c[2]) as int) as bits from p where regexp_full_match(trim(c[1]), '[A-Z][A-Z0-9_]+')")
def spl_11_field_rows(s, d):
    """SPL-11: field rows of piped tables."""
    l = _blocks(s, d).where("block_type = 'table'").select("block_id", F.posexplode(F.split("content", "\n")).alias("p", "line")).select("block_id", (F.col("p") + 1).alias("i"), F.split("line", r"\|").alias("c")).where("size(c) >= 3")
    return l.where(F.trim(F.col("c")[0]).rlike("^[A-Z][A-Z0-9_]+$")).select("block_id", "i", F.trim(F.col("c")[0]).alias("name"), F.expr("try_cast(trim(c[1]) as int)").alias("bits"))


@query("select doc_id, i::int as line_no, length(regexp_extract(line, '^(#{1,6}) ', 1))::int as level, trim(regexp_replace(line, '^#+ ', '')) as title from (select doc_id, unnest(string_split(text, E'\\n')) as line, generate_subscripts(string_split(text, E'\\n'), 1) as i from documents) where regexp_matches(line, '^#{1,6} ')")
def spl_08_headings(s, d):
    """SPL-08: heading lines with their level."""
    l = table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).where(F.col("line").rlike("^#{1,6} "))
    return l.select("doc_id", (F.col("p") + 1).alias("line_no"), F.char_length(F.regexp_extract("line", "^(#{1,6}) ", 1)).alias("level"), F.trim(F.regexp_replace("line", "^#+ ", "")).alias("title"))


@query(f"select block_id, array_to_string(string_split(content, E'\\n')[1:20], E'\\n') as head from {_B} where content is not null")
def spl_10_line_slice(s, d):
    return _blocks(s, d).where("content is not null").select("block_id", F.array_join(F.slice(F.split("content", "\n"), 1, 20), "\n").alias("head"))


@query(f"with p as (select block_id, content, coalesce(nullif(trim(cleaned_content), ''), content) as t from {_B}) select block_id, t is distinct from content as replaced, coalesce(length(t), 0) as chars from p")
def snk_02_merged_text(s, d):
    """SNK-02/03: the newer text over the older one where there is one."""
    t = F.coalesce(F.nullif(F.trim("cleaned_content"), F.lit("")), F.col("content"))
    return _blocks(s, d).select("block_id", (~t.eqNullSafe(F.col("content"))).alias("replaced"), F.coalesce(F.char_length(t), F.lit(0)).cast("bigint").alias("chars"))


@query(f"select dataset_id, max(d.block_count) as declared, count(distinct chunk_id) as chunks from (select dataset_id, block_count from datasets) d join {_C} c using (dataset_id) group by 1")
def join_21_registry(s, d):
    """JOIN-21: datasets with the chunks that name them."""
    c = _chunks(s, d).groupBy("dataset_id").agg(F.count("*").alias("chunks"))
    return table(s, d, "datasets").groupBy("dataset_id").agg(F.max("block_count").alias("declared")).join(c, "dataset_id").select("dataset_id", "declared", "chunks")


@query("select sha256(dataset_id || '/' || name)[1:16] as id, dataset_id from datasets")
def fn_21_hash_ids(s, d):
    return table(s, d, "datasets").select(F.substring(F.sha2(F.concat("dataset_id", F.lit("/"), "name"), 256), 1, 16).alias("id"), "dataset_id")
