"""Further queries: similarity, groups, codec, offsets, splitting, trees, sinks (FN, MSG, SPL, JOIN, SNK, AGG)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparloom.functions import codec
from sparloom.functions import similarity as Y
from sparloom.operators import nested, splitter
from sparloom.operators.cleaning import once
from sparloom.sources import sinks
from sparloom.sources.tables import table

QUERIES, SQL = {}, {}
_B = "(select distinct block_id, project_id, file_name, page_num, content, block_type, cleaned_content from blocks)"
_F = "(select block_id, unnest(pf, recursive := true) from (select block_id, any_value(protocol_fields) as pf from blocks group by 1))"
_G = "case " + " ".join(f"when regexp_matches(t, '{'|'.join(w)}') then '{n}'" for n, w in Y.GROUPS) + " end"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _fields(s, d):
    return once(table(s, d, "blocks")).select("block_id", F.posexplode("protocol_fields").alias("pos", "f")).select("block_id", "pos", "f.*").where("field_name is not null")


@query(f"""select distinct formula, case when regexp_matches(t, '-?[0-9]+\\s*(?:->|→|=[^=])') and regexp_matches(t, '-?[0-9]+\\s*(?:->|→|=)\\s*[A-Za-z_]') then 'mapping' when regexp_matches(t, '\\?|\\bif\\b|\\bwhen\\b') then 'conditional' when regexp_full_match(t, '[-+]?[0-9]+(\\.[0-9]+)?') then 'const'
  when regexp_full_match(t, '[A-Za-z_][A-Za-z0-9_]*') then 'direct' when regexp_matches(t, '[-+*/%]|[A-Za-z0-9_]\\(') then 'expression' else 'none' end as kind, length(replace(t, '(', '')) = length(replace(t, ')', '')) and t <> '' as balanced from (select formula, trim(formula) as t from {_F} where formula is not null)""")
def fn_09_formula_kind(s, d):
    f = _fields(s, d).where("formula is not null").select("formula").distinct()
    n = lambda x: F.regexp_count(F.col("formula"), F.lit(x))
    return f.select("formula", Y.formula_kind(F.col("formula")).alias("kind"), ((n(r"\(") == n(r"\)")) & (F.trim("formula") != "")).alias("balanced"))


@query()
def fn_15_sequence_ratio(s, d):
    """FN-15: question against answer."""
    return table(s, d, "qa_pairs").drop("loaded_at").dropDuplicates(["qa_id"]).select("qa_id", F.round(Y.sequence_ratio("question", "answer"), 6).alias("ratio"))


@query("select doc_id, (length(lower(text)) - length(replace(lower(text), 'bit', ''))) // 3 + (length(lower(text)) - length(replace(lower(text), 'range', ''))) // 5 as score from documents")
def agg_19_keywords(s, d):
    """AGG-19: keyword hits per text."""
    low = F.lower("text")
    n = lambda w: F.floor((F.char_length(low) - F.char_length(F.replace(low, F.lit(w), F.lit("")))) / len(w))
    return table(s, d, "documents").select("doc_id", (n("bit") + n("range")).cast("bigint").alias("score"))


@query("with f as (select block_id, generate_subscripts(pf, 1) - 1 as pos, unnest(pf) as x from (select block_id, any_value(protocol_fields) as pf from blocks group by 1)) select block_id, pos::int as pos, x.field_name as field_name, coalesce(sum(coalesce(x.bit_length, 0)) over (partition by block_id order by pos rows between unbounded preceding and 1 preceding), 0)::bigint as bit_offset from f where x.field_name is not null")
def msg_08_offsets(s, d):
    """MSG-08: cumulative bit offset of each field."""
    w = W.partitionBy("block_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    return _fields(s, d).select("block_id", "pos", "field_name", F.coalesce(F.sum(F.coalesce("bit_length", F.lit(0))).over(w), F.lit(0)).alias("bit_offset"))


_CODEC = [("p_size", 6), ("k", 11), ("r", 3)]


@query("select p_partkey, p_size::bigint as p_size, (p_partkey % 2048)::bigint as k, (p_partkey % 7)::bigint as r from part")
def msg_09_roundtrip(s, d):
    """MSG-09/10: values packed into bits and read back."""
    p = table(s, d, "part").select("p_partkey", "p_size", F.expr("p_partkey % 2048").alias("k"), F.expr("p_partkey % 7").alias("r"))
    return codec.decode_messages(codec.encode_messages(p, "p_partkey", _CODEC), "p_partkey", _CODEC)


@query("select p_partkey, lpad(to_hex(((p_size * 2048 + p_partkey % 2048) * 8 + p_partkey % 7) * 16), 6, '0') as buffer from part")
def msg_10_encode(s, d):
    """MSG-10: 6, 11 and 3 bits, most significant first, padded to three bytes."""
    p = table(s, d, "part").select("p_partkey", "p_size", F.expr("p_partkey % 2048").alias("k"), F.expr("p_partkey % 7").alias("r"))
    return codec.encode_messages(p, "p_partkey", _CODEC).select("p_partkey", F.hex("buffer").alias("buffer"))


@query()
def spl_02_pieces(s, d):
    return splitter.split_blocks(once(table(s, d, "blocks"))).select("block_id", "chunk_index", "total_chunks", F.char_length("content").alias("chars"))


@query()
def spl_03_stitched(s, d):
    return splitter.stitch_tables(once(table(s, d, "blocks")))


@query()
def spl_09_breadcrumbs(s, d):
    return splitter.breadcrumbs(nested.node_table(nested.flatten_trees(table(s, d, "pageindex_workspace"), {"node": nested.ATTRIBUTES["node"]})))


@query("select qa_id, md5(answer) as answer_md5, json_extract_string(answer, '$.target_field') as target_field, json_extract_string(answer, '$.conversion_mode') as mode, json_array_length(answer, '$.source_fields')::int as sources from (select distinct qa_id, answer from qa_pairs) where answer like '{%' and json_valid(answer)")
def spl_16_answers(s, d):
    """SPL-16: rules given as JSON in answers."""
    q = table(s, d, "qa_pairs").select("qa_id", "answer").distinct().where("answer like '{%' and try_parse_json(answer) is not null")
    x = F.from_json("answer", "target_field string, conversion_mode string, source_fields array<string>")
    return q.select("qa_id", F.md5(F.encode("answer", "utf-8")).alias("answer_md5"), x["target_field"].alias("target_field"), x["conversion_mode"].alias("mode"), F.size(x["source_fields"]).alias("sources"))


@query(f"select block_id, len(string_split(content, E'\\n')) as lines, len(list_filter(string_split(content, E'\\n'), lambda r: len(string_split(r, '|')) >= 3)) as rows from {_B} where content is not null")
def spl_04_pseudo_tables(s, d):
    """SPL-04/05: lines that are rows of a table."""
    lines = F.split("content", "\n")
    return once(table(s, d, "blocks")).where("content is not null").select("block_id", F.size(lines).cast("bigint").alias("lines"), F.size(F.filter(lines, lambda r: F.size(F.split(r, r"\|")) >= 3)).cast("bigint").alias("rows"))


@query()
def snk_05_lines(s, d):
    return sinks.training_lines(table(s, d, "qa_pairs").drop("loaded_at").dropDuplicates(["qa_id"]))


@query("select job_id, (s // 3600)::varchar || 'h ' || ((s % 3600) // 60)::varchar || 'm ' || (s % 60)::varchar || 's' as run from (select job_id, progress.current_step::bigint * 7 as s from (select distinct job_id, progress from finetune_jobs) where progress is not null)")
def fn_24_duration(s, d):
    """FN-24: seconds as hours, minutes and seconds."""
    j = table(s, d, "finetune_jobs").drop("loaded_at").dropDuplicates(["job_id"]).where("progress is not null").select("job_id", (F.col("progress.current_step").cast("bigint") * 7).alias("s"))
    return j.select("job_id", F.concat(F.expr("s div 3600").cast("string"), F.lit("h "), F.expr("(s % 3600) div 60").cast("string"), F.lit("m "), F.expr("s % 60").cast("string"), F.lit("s")).alias("run"))


@query("with c as (select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as best, row_number() over (partition by o_custkey order by o_totalprice, o_orderkey) as worst from orders) select a.o_custkey as o_custkey, a.o_orderkey as chosen, b.o_orderkey as rejected from c a join c b on a.o_custkey = b.o_custkey and a.best = 1 and b.worst <= 3 and a.o_totalprice - b.o_totalprice >= 50000")
def rank_10_preference_pairs(s, d):
    """RANK-10: best against the worst three of each case, with a least gap."""
    o = table(s, d, "orders")
    best = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    worst = W.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    c = o.select("o_custkey", "o_orderkey", "o_totalprice", F.row_number().over(best).alias("best"), F.row_number().over(worst).alias("worst"))
    a = c.where("best = 1").select("o_custkey", F.col("o_orderkey").alias("chosen"), F.col("o_totalprice").alias("p"))
    b = c.where("worst <= 3").select("o_custkey", F.col("o_orderkey").alias("rejected"), F.col("o_totalprice").alias("q"))
    return a.join(b, "o_custkey").where("p - q >= 50000").select("o_custkey", "chosen", "rejected")


@query(f"select project_id, count(*) as blocks from {_B} where project_id in (select project_id from datasets) group by 1")
def src_09_by_owner(s, d):
    """SRC-09: scan by owner."""
    return once(table(s, d, "blocks")).join(table(s, d, "datasets").select("project_id").distinct(), "project_id", "left_semi").groupBy("project_id").agg(F.count("*").alias("blocks"))


@query("select file_ext, count(*) as files from (select distinct file_name, lower(regexp_extract(file_name, '\\.([A-Za-z0-9]+)$', 1)) as file_ext from blocks) where file_ext in ('pdf','docx','doc','xlsx','xls','txt','md','csv','json','xml','html','htm','yaml','yml') group by 1")
def src_01_types(s, d):
    from sparloom.sources.files import ACCEPTED, extension

    f = table(s, d, "blocks").select("file_name", extension(F.col("file_name")).alias("file_ext")).distinct()
    return f.where(F.col("file_ext").isin(*ACCEPTED)).groupBy("file_ext").agg(F.count("*").alias("files"))


@query("select project_id, sum(length(content)) filter (length(trim(content)) >= 20) as readable_chars, count(*) filter (length(trim(content)) >= 20) as readable, count(*) as units from (select distinct block_id, project_id, content from blocks) group by 1")
def val_04_metrics(s, d):
    ok = F.coalesce(F.char_length(F.trim("content")) >= 20, F.lit(False))
    return once(table(s, d, "blocks")).groupBy("project_id").agg(F.sum(F.when(ok, F.char_length("content"))).alias("readable_chars"), F.count_if(ok).alias("readable"), F.count("*").alias("units"))
