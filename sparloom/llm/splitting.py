"""Splitting oversized items at natural boundaries.

Recursive separator hierarchy: section, paragraph, line, sentence, word, then character. An item is cut at the coarsest
level; fragments over the budget are cut at the next finer one; fragments are then packed greedily. Each piece but the
first repeats exactly ``overlap`` characters before it, so a piece is ``[end of the last - overlap, own end)``.

Defined results
    * an item not longer than its limit gives no rows; null text or an unknown kind gives no rows.
    * no piece is longer than its limit; pieces without their overlap are disjoint and join to the whole text.
    * an overlap of the limit or more is cut to limit - 1; a negative one counts as 0; a limit under 1 gives no rows.
    * ends are never placed between a base character and its combining marks unless the budget is one character.
    * rows delivered twice count once; empty tables give no rows; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: From coarse to fine: (name, pattern whose match END is a boundary).
LEVELS = [
    ("section", re.compile(r"\n+(?=#{1,6} |\d+(?:\.\d+)+ +\S|(?:Section|Chapter|Abschnitt|Kapitel) \d|第[\d一二三四五六七八九十]+[章节])")),
    ("paragraph", re.compile(r"\n[ \t　]*\n\s*")),
    ("line", re.compile(r"\n+")),
    ("sentence", re.compile(r"[.!?…]+[\"')\]»”’]*\s+|[。！？；][”’」』）]*\s*")),
    ("word", re.compile(r"\s+|(?<=[,;:，、：])")),
]
SCHEMA = "table_name string, item_key string, piece int, start int, end int, boundary string, text string"


def boundaries(text: str, a: int, b: int, level: int) -> list[int]:
    """Boundary positions of a level strictly inside ``[a, b)``."""
    return [m.end() for m in LEVELS[level][1].finditer(text, a, b) if a < m.end() < b]


def units(text: str, budget: int) -> Iterator[tuple[int, str]]:
    """Ends of the fragments (with the level each ends at), none longer than the budget; iterative, so depth is no limit."""
    todo = [(0, len(text), 0, "end")]
    while todo:
        a, b, level, name = todo.pop()
        if b - a <= budget:
            yield b, name
        elif level < len(LEVELS):
            cuts = boundaries(text, a, b, level)
            ends = [(p, LEVELS[level][0]) for p in cuts] + [(b, name)]
            starts = [a, *cuts]
            todo.extend((s, e, level + 1, n) for s, (e, n) in reversed(list(zip(starts, ends))))
        else:
            s = a
            while b - s > budget:
                e = s + budget
                while e > s + 1 and unicodedata.combining(text[e]):
                    e -= 1
                yield e, "character"
                s = e
            yield b, name


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, boundary) of the pieces of a text; one piece when it fits the limit."""
    if limit < 1:
        return []
    if len(text) <= limit:
        return [(0, len(text), "end")]
    overlap = max(0, min(overlap, limit - 1))
    budget = limit - overlap
    pieces, begin, last, name = [], 0, 0, ""
    for end, level in units(text, budget):
        room = limit if begin == 0 else budget
        if end - begin > room:
            pieces.append((max(0, begin - overlap) if pieces else 0, last, name))
            begin = last
        last, name = end, level
    pieces.append((max(0, begin - overlap) if pieces else 0, last, name))
    return pieces


def oversized_items(blocks: DataFrame, chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """(table_name, item_key, text, max_chars, overlap_chars) of the items over their limit, each key once.

    ``limits`` has one row per kind (a handful), so it is broadcast. A chunk's text is its snapshot, or, where that is
    null or blank, the contents of its source blocks in list order.
    """
    lim = F.broadcast(limits.groupBy("item_kind").agg(F.min("max_chars").alias("max_chars"), F.min("overlap_chars").alias("overlap_chars")))
    over = F.char_length("text") > F.col("max_chars")
    cols = ["table_name", "item_key", "text", "max_chars", "overlap_chars"]
    b = (
        blocks.select(F.lit("blocks").alias("table_name"), F.col("block_id").cast("string").alias("item_key"), F.col("content").alias("text"), F.col("block_type").alias("item_kind"))
        .where("text is not null")
        .join(lim, "item_kind")
        .where(over)
        .select(*cols)
    )
    c = chunks.select("chunk_id", "content_snapshot", "source_block_ids", F.lit("chunk").alias("item_kind")).join(lim, "item_kind")
    blank = F.coalesce(F.col("content_snapshot"), F.lit("")).rlike(r"^[\s\p{Z}​﻿]*$")
    whole = c.where(~blank).select(F.lit("chunks").alias("table_name"), F.col("chunk_id").alias("item_key"), F.col("content_snapshot").alias("text"), "max_chars", "overlap_chars").where(over)
    bare = c.where(blank).dropDuplicates(["chunk_id"]).select("chunk_id", "max_chars", "overlap_chars", F.posexplode("source_block_ids").alias("pos", "block_id"))
    wanted = bare.select("block_id").distinct()
    source = blocks.where("content is not null").join(wanted, "block_id", "left_semi").groupBy("block_id").agg(F.max("content").alias("content"))
    joined = (
        bare.join(source, "block_id")
        .groupBy("chunk_id", "max_chars", "overlap_chars")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]), "\n").alias("text"))
        .select(F.lit("chunks").alias("table_name"), F.col("chunk_id").alias("item_key"), "text", "max_chars", "overlap_chars")
        .where(over)
    )
    return b.unionByName(whole).dropDuplicates(["table_name", "item_key"]).unionByName(joined)


def split_items(items: DataFrame) -> DataFrame:
    """One row per piece, in order, with its place in the item and the kind of boundary it ends at."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t, k, text, limit, overlap in zip(pdf.table_name, pdf.item_key, pdf.text, pdf.max_chars, pdf.overlap_chars):
                out += [(t, k, i, a, e, n, text[a:e]) for i, (a, e, n) in enumerate(split_text(text, int(limit), int(overlap)))]
            yield pd.DataFrame(out, columns=["table_name", "item_key", "piece", "start", "end", "boundary", "text"])

    return items.mapInPandas(run, SCHEMA)
