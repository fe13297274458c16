"""Queries of the cleaning operators (CLN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparloom.functions import text as T
from sparloom.operators.cleaning import cascade, issues, once, summary
from sparloom.sources.tables import table

_ONCE = "(select distinct block_id, project_id, file_name, page_num, content, block_type, cleaned_content from blocks)"


def _blocks(s, d):
    return once(table(s, d, "blocks")).where("content is not null")


def _one(rule):
    return lambda s, d: _blocks(s, d).select("block_id", F.md5(F.encode(rule(F.col("content")), "utf-8")).alias("cleaned_md5"))


def cln_06_issues(s, d):
    """CLN-06: issue rows of the cascade."""
    return issues(_blocks(s, d)).groupBy("block_id", "issue_type").agg(F.count("*").alias("n"))


def cln_07_summary(s, d):
    return summary(_blocks(s, d), "project_id")


def cln_06_cascade(s, d):
    return cascade(_blocks(s, d)).select("block_id", F.char_length("step_5").alias("chars"), (F.col("step_0") != F.col("step_5")).alias("changed"))


def cln_09_numeric_lines(s, d):
    """CLN-09: lines of digits only and long runs of digits out."""
    kept = F.filter(F.split("content", "\n"), lambda x: ~F.trim(x).rlike("^[0-9. ]+$"))
    return _blocks(s, d).select("block_id", F.char_length(F.regexp_replace(F.array_join(kept, "\n"), "[0-9]{6,}", "")).alias("chars"))


def cln_08_cells(s, d):
    """CLN-08: rows of piped tables with trimmed cells, empty rows dropped, width of the widest row."""
    rows = F.filter(F.transform(F.split("content", "\n"), lambda r: F.transform(F.split(r, r"\|"), lambda x: F.trim(x))), lambda r: F.array_join(r, "") != "")
    t = _blocks(s, d).where("block_type = 'table'").select("block_id", rows.alias("r"))
    return t.where(F.size("r") > 0).select("block_id", F.size("r").alias("n_rows"), F.array_max(F.transform("r", F.size)).alias("width"))


def cln_10_model_noise(s, d):
    return table(s, d, "qa_pairs").select("qa_id", "answer").distinct().where("answer is not null").select("qa_id", F.md5(F.encode(T.model_noise(F.col("answer")), "utf-8")).alias("m"))


def cln_12_identifiers(s, d):
    f = _blocks(s, d).select(F.explode("protocol_fields").alias("f")).select("f.field_name").where("field_name is not null").distinct()
    return f.select("field_name", T.identifier(F.col("field_name")).alias("upper_id"), T.squashed(F.col("field_name")).alias("squashed"), T.snake(F.col("field_name")).alias("snake"))


def cln_13_shortened(s, d):
    return _blocks(s, d).select("block_id", T.shortened(F.col("content"), 80).alias("short"))


QUERIES = {
    "cln_01_garbled": _one(T.garbled), "cln_02_decoding": _one(T.decoding), "cln_03_spacing": _one(T.spacing), "cln_04_table_rows": _one(T.table_rows), "cln_05_repeats": _one(T.repeats),
    "cln_06_issues": cln_06_issues, "cln_06_cascade": cln_06_cascade, "cln_07_summary": cln_07_summary, "cln_08_cells": cln_08_cells, "cln_09_numeric_lines": cln_09_numeric_lines,
    "cln_10_model_noise": cln_10_model_noise, "cln_12_identifiers": cln_12_identifiers, "cln_13_shortened": cln_13_shortened,
}

_B = f"select * from {_ONCE} where content is not null"
_STRIP = r"'^[\s\x{3000}]+|[\s\x{3000}]+$'"
SQL = {
    "cln_02_decoding": rf"select block_id, md5(regexp_replace(replace(replace(replace(replace(content, '锟斤拷', ''), '烫烫烫', ''), '屯屯屯', ''), chr(65533), ''), '[\x01-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')) as cleaned_md5 from ({_B})",
    "cln_03_spacing": rf"""select block_id, md5(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(replace(content, chr(9), '    '), ' {{2,}}', ' ', 'g'), '\n{{3,}}', E'\n\n', 'g'), E'\n'), lambda x: regexp_replace(x, {_STRIP}, '', 'g')), E'\n'), {_STRIP}, '', 'g')) as cleaned_md5 from ({_B})""",
    "cln_08_cells": rf"""with t as (select block_id, list_filter(list_transform(string_split(content, E'\n'), lambda r: list_transform(string_split(r, '|'), lambda x: trim(x))), lambda r: array_to_string(r, '') <> '') as r from ({_B}) where block_type = 'table')
      select block_id, len(r)::int as n_rows, list_max(list_transform(r, lambda x: len(x)))::int as width from t where len(r) > 0""",
    "cln_09_numeric_lines": rf"select block_id, length(regexp_replace(array_to_string(list_filter(string_split(content, E'\n'), lambda x: not regexp_full_match(trim(x), '[0-9. ]+')), E'\n'), '[0-9]{{6,}}', '', 'g'))::int as chars from ({_B})",
    "cln_10_model_noise": r"select qa_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(answer, '(?is)<think>.*?</think>', '', 'g'), '<\|[a-z_]+\|>', '', 'g'), '```[a-zA-Z]*\n?', '', 'g'), ' ')) as m from (select distinct qa_id, answer from qa_pairs) where answer is not null",
    "cln_12_identifiers": f"select distinct field_name, upper(trim(field_name)) as upper_id, regexp_replace(upper(field_name), '[^A-Z0-9]+', '', 'g') as squashed, regexp_replace(regexp_replace(lower(trim(field_name)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as snake from (select unnest(protocol_fields, recursive := true) from blocks) where field_name is not null",
    "cln_13_shortened": rf"select block_id, case when length(t) > 80 then rtrim(t[1:80]) || '...' else t end as short from (select block_id, trim(regexp_replace(content, '\s+', ' ', 'g')) as t from ({_B}))",
}
