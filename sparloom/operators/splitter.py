"""Recursive character splitter by file type, paragraphs, table stitching over pages and tree breadcrumbs."""

from __future__ import annotations

import re
import textwrap
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparloom.functions import similarity as Y

PROSE = ["\n\n", "\n", "。", "！", "？", ".", "!", "?", " ", ""]
#: Fixed values: (size, overlap, separators) per type, coarse separators first.
KINDS = {
    "py": (400, 50, ["\nclass ", "\ndef ", "\n\tdef ", "\n\n", "\n", " ", ""]), "java": (400, 50, ["\n\n"]), "cpp": (400, 50, ["\n\n"]), "js": (400, 50, ["\n\n"]),
    "md": (800, 100, ["\n## ", "\n### ", "\n#### ", "\n\n", "\n", " ", ""]), "json": (500, 50, ["\n"]), "yaml": (500, 50, ["\n"]), "xml": (500, 50, ["\n"]),
    "pdf": (1000, 100, ["\n\n", "\n", "。", "！", "？", ".", "!", "?", ";", "；", " ", ""]), "txt": (800, 80, PROSE), "docx": (800, 80, PROSE), "general": (500, 50, PROSE),
}
SAME = {"python": "py", "markdown": "md", "yml": "yaml", "htm": "xml", "html": "xml"}


def kind_of(name: str | None) -> str:
    """The splitter for a file name, by its ending."""
    end = (name or "").rsplit(".", 1)[-1].lower()
    end = SAME.get(end, end)
    return end if end in KINDS else "general"


def _packed(parts: list[str], size: int, overlap: int, glue: str) -> list[str]:
    """Parts put together greedily up to ``size``; each piece starts with the last parts of the one before, up to ``overlap``."""
    out, now, held = [], [], 0
    for p in parts:
        more = len(p) + (len(glue) if now else 0)
        if now and held + more > size:
            out.append(glue.join(now))
            while now and (held > overlap or held + len(p) + len(glue) > size):
                held -= len(now[0]) + (len(glue) if len(now) > 1 else 0)
                now.pop(0)
            more = len(p) + (len(glue) if now else 0)
        now.append(p)
        held += more
    if now:
        out.append(glue.join(now))
    return [x for x in map(str.strip, out) if x]


def pieces(text: str, size: int, overlap: int, separators: list[str] = PROSE) -> list[str]:
    """Recursive splitting: at the coarsest separator the text holds, whose parts are packed; a part over the size is split
    at the finer ones. Separators stay at the start of the part they precede; without a finer separator a part stays whole."""
    at = next((k for k, sep in enumerate(separators) if not sep or sep in text), len(separators) - 1)
    sep, finer = separators[at], separators[at + 1 :]
    if not sep:
        parts = list(text)
    else:
        cut = re.split(f"({re.escape(sep)})", text)
        parts = [p for p in [cut[0], *(a + b for a, b in zip(cut[1::2], cut[2::2]))] if p]
    out, small = [], []
    for p in parts:
        if len(p) < size:
            small.append(p)
            continue
        out += _packed(small, size, overlap, "")
        small = []
        out += pieces(p, size, overlap, finer) if finer else [p]
    return out + _packed(small, size, overlap, "")


def split_blocks(blocks: DataFrame, kind: str | None = None, over: int = 1000) -> DataFrame:
    """(block_id, chunk_index, total_chunks, content): blocks over a length in pieces, others whole. The splitter is that of
    ``kind`` or of the block's file name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, name, text in zip(*(c.to_pylist() for c in b.columns)):
                got = pieces(text, *KINDS[kind or kind_of(name)]) if len(text) > over else [text]
                rows += [(i, k, len(got), x) for k, x in enumerate(got)]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.string()))], names=["block_id", "chunk_index", "total_chunks", "content"])

    return blocks.where("content is not null").select("block_id", "file_name", "content").mapInArrow(run, "block_id bigint, chunk_index int, total_chunks int, content string")


def paragraphs(texts: DataFrame, key: str, width: int = 800) -> DataFrame:
    """(key, pos, paragraph): parts between blank lines, wrapped at words where they are longer than ``width``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, t in zip(*(c.to_pylist() for c in b.columns)):
                found = [x.strip() for x in re.split(r"\n\s*\n", (t or "").replace("\r\n", "\n")) if x.strip()]
                whole = [y for x in found for y in ([x] if len(x) <= width else textwrap.wrap(x, width, break_long_words=False, break_on_hyphens=False))]
                rows += [(k, i, x) for i, x in enumerate(whole)]
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.types[0]), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], names=[key, "pos", "paragraph"])

    t = texts.select(key, F.col("text").cast("string"))
    return t.mapInArrow(run, f"{key} {t.schema[0].dataType.simpleString()}, pos int, paragraph string")


def stitch_tables(blocks: DataFrame) -> DataFrame:
    """(project_id, file_name, block_id, table_no): tables continued on the next page share a number.

    A table goes on where it is the first block of the page after one whose last block is the table before, the column
    counts differ by one at most, and its first row repeats the first row of the whole table, or it is no header, the
    counts are equal and its cells have the shapes of the last row before: three quarters of them, or 0.6 after a row that
    is two fifths blank. What two neighbours say is worked out in columns; the fold follows only what the table so far adds.
    """
    page = Window.partitionBy("project_id", "file_name", "page_num")
    b = blocks.where("page_num is not null").select("project_id", "file_name", "block_id", "page_num", "block_type", "content", (F.min("block_id").over(page) == F.col("block_id")).alias("top"), (F.max("block_id").over(page) == F.col("block_id")).alias("bottom"))
    rows = F.transform(F.filter(F.split(F.coalesce("content", F.lit("")), "\n"), lambda x: F.contains(x, F.lit("|"))), lambda x: F.transform(F.split(x, r"\|"), lambda x: F.trim(x)))
    t = b.where("block_type = 'table'").withColumn("rows", rows)
    first, last = F.coalesce(F.get("rows", F.lit(0)), F.array().cast("array<string>")), F.coalesce(F.get("rows", F.size("rows") - 1), F.array().cast("array<string>"))
    head = F.array_join(F.filter(F.transform(first, F.lower), lambda x: x != ""), "|")
    t = t.select("project_id", "file_name", "block_id", "page_num", "top", "bottom", F.size(first).alias("cols"), F.when(head != "", F.xxhash64(head)).alias("head"), Y.header_row(first).alias("titled"), Y.row_shape(first).alias("first"), Y.row_shape(last).alias("last"), Y.blank_ratio(last).alias("blank"))
    w = Window.partitionBy("project_id", "file_name").orderBy("page_num", "block_id")
    like = Y.shape_similarity(F.lag("last").over(w), F.col("first"))
    shaped = ~F.col("titled") & ((like >= 0.75) | ((F.lag("blank").over(w) >= 0.4) & (like >= 0.6)))
    t = t.select("project_id", "file_name", "block_id", "page_num", "top", "bottom", "cols", "head", F.coalesce(shaped, F.lit(False)).alias("shaped"))

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_rows = pa.Table.from_batches(list(batches)).sort_by([("page_num", "ascending"), ("block_id", "ascending")])
        no, before, out = 0, None, []
        for page_num, top, bottom, cols, head, shaped in zip(*(all_rows.column(c).to_pylist() for c in ("page_num", "top", "bottom", "cols", "head", "shaped"))):
            near = before is not None and page_num == before[0] + 1 and before[1] and top and cols > 0 and before[2] > 0 and abs(cols - before[2]) <= 1
            again = near and head is not None and head == before[3]
            goes_on = again or (near and shaped and cols == before[2])
            no += not goes_on
            before = (page_num, bottom, max(cols, before[2]) if goes_on else cols, before[3] if goes_on else head)
            out.append(no)
        yield pa.RecordBatch.from_arrays([all_rows.column(c).combine_chunks() for c in ("project_id", "file_name", "block_id")] + [pa.array(out, pa.int32())], names=["project_id", "file_name", "block_id", "table_no"])

    return t.groupBy("project_id", "file_name").applyInArrow(run, "project_id string, file_name string, block_id bigint, table_no int")


def breadcrumbs(nodes: DataFrame) -> DataFrame:
    """(tree_id, path, crumb): titles from the root to each node, joined by ' > '. Paths name the ancestors, so one join does it."""
    n = nodes.select("tree_id", "path", F.coalesce("title", F.lit("")).alias("title"))
    up = n.select("tree_id", "path", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", r"\."))), lambda i: F.array_join(F.slice(F.split("path", r"\."), F.lit(1), i), "."))).alias("level", "anc"))
    j = up.join(n.select("tree_id", F.col("path").alias("anc"), F.col("title").alias("t")), ["tree_id", "anc"])
    return j.groupBy("tree_id", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", "t"))), lambda x: x["t"]), " > ").alias("crumb"))
