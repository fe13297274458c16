"""Evaluation passages leaking into training text, by template canonicalisation.

Words are maximal runs of letters or digits in lower case. Each word is canonicalised: numbers, names (the words the
evaluation texts write with capitals or digits throughout) and units become typed placeholders. Windows of ``WINDOW``
canonical words are hash-joined between evaluation items and documents; the slots (what the placeholders stand for)
travel as a second hash. Equal template and equal slots: the passage stands in the document word by word. Equal
template and other slots: a re-parameterised copy, if along an unbroken run of windows the slots map one to one; the run's
words are compared slot by slot.

Defined results
    * null or wordless texts give no windows; an item shorter than the window can't leak.
    * a pair counts once however often the passage stands there; empty tables give no rows.
    * items with null ids and documents with null ids are left out; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparloom.llm import bloom
from sparloom.session import cut, spread

WINDOW = 12
#: The item windows are sent to all executors up to this many rows (24 bytes each); beyond it the windows of documents that
#: pass a Bloom filter of the items' templates are shuffled. The rows are the same.
BROADCAST_ROWS = 2_000_000
#: A re-parameterised copy needs this many template words in one run; each window of it so many words that are no placeholders.
RUN, PLAIN = 24, 4
#: Words for units of measure in the three languages.
UNITS = frozenset(
    "bit bits byte bytes hz khz mhz ms s v mv w m km kg percent degrees degree kelvin radians metres meters metre knots volts millivolts "
    "millibars hectopascals decibels kilograms seconds second milliseconds minutes minute hours counts cycles frames words litres newton nautical miles "
    "sekunden millisekunden minuten stunden meter grad volt prozent".split()
)
WORD = re.compile(r"[^\W_]+")
U = np.uint64
_POW = np.array([pow(0x9E3779B97F4A7C15, WINDOW - 1 - j, 2**64) for j in range(WINDOW)], dtype=np.uint64)


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def name_words(items: DataFrame) -> DataFrame:
    """(word): words of the evaluation texts that never stand there in lower case (identifiers, codes, system names)."""
    w = items.select(F.explode(F.regexp_extract_all("text", F.lit(r"(\p{L}[\p{L}\p{N}]*)"), 1)).alias("w"))
    return w.groupBy(F.lower("w").alias("word")).agg(F.max((F.col("w") == F.lower("w")).cast("int")).alias("low"), F.max((F.col("w") == F.upper("w")).cast("int")).alias("up")).where("low = 0 and up = 1").select("word")


def canonical(word: str, is_name: bool) -> str:
    """The typed placeholder of a word, or the word; a function of the lower-case word alone."""
    if any(c.isdigit() for c in word):
        return "\x00name" if any(c.isalpha() for c in word) else "\x00number"
    if is_name:
        return "\x00name"
    return "\x00unit" if word in UNITS else word


class Codes(dict):
    """word -> (template code, slot code, is placeholder), computed once per worker. ``names``: Bloom filter of the name
    words, bounded in size however many items there are; a word let through by chance is a name in items and documents alike."""

    LIMIT = 1_000_000

    def __init__(self, names: np.ndarray):
        super().__init__()
        self.names = names.tobytes()

    def __missing__(self, w):
        c = canonical(w, bloom.one(self.names, xxhash.xxh64_intdigest(w, 42)))
        v = (xxhash.xxh64_intdigest(c), xxhash.xxh64_intdigest(w) if c is not w else 0, c is not w)
        if len(self) < self.LIMIT:
            self[w] = v
        return v


def _roll(codes: np.ndarray) -> np.ndarray:
    n = len(codes) - WINDOW + 1
    h = np.zeros(n, dtype=np.uint64)
    for j in range(WINDOW):
        h += codes[j : j + n] * _POW[j]
    return h ^ (h >> U(29))


def windows(texts: list, codes: Codes) -> tuple[np.ndarray, ...]:
    """(text index, position, template hash, slot hash, placeholders) of all windows of all texts."""
    owner, tcode, scode, slot = [], [], [], []
    for i, t in enumerate(texts):
        if t:
            got = [codes[w] for w in words(t)]
            if len(got) >= WINDOW:
                owner.append((i, len(got)))
                tcode += [g[0] for g in got]
                scode += [g[1] for g in got]
                slot += [g[2] for g in got]
    if not owner:
        return tuple(np.zeros(0, d) for d in (np.int64, np.int32, np.uint64, np.uint64, np.int32))
    lengths = np.array([n for _, n in owner])
    who = np.repeat(np.array([i for i, _ in owner]), lengths)
    pos = np.arange(len(who)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    left = np.repeat(lengths, lengths) - pos
    t, s = _roll(np.array(tcode, dtype=np.uint64)), _roll(np.array(scode, dtype=np.uint64))
    c = np.concatenate([[0], np.cumsum(np.array(slot, dtype=np.int32))])
    ok = left[: len(t)] >= WINDOW
    holes = (c[WINDOW:] - c[:-WINDOW]).astype(np.int32)
    return who[: len(t)][ok], pos[: len(t)][ok].astype(np.int32), t[ok], s[ok], holes[ok]


def window_rows(df: DataFrame, key: str, names: np.ndarray, wanted: np.ndarray | None = None, reps: int = 256) -> DataFrame:
    """(id, pos, tpl, slots, holes): one row per window of each text, of those whose template may be ``wanted`` (a Bloom filter)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(names)
        for b in batches:
            for i in range(0, b.num_rows, reps):
                s = b.slice(i, reps)
                who, pos, t, sl, holes = windows(s.column(1).to_pylist(), codes)
                if wanted is not None and len(t):
                    keep = bloom.maybe(wanted, t)
                    who, pos, t, sl, holes = who[keep], pos[keep], t[keep], sl[keep], holes[keep]
                ids = s.column(0).to_numpy(zero_copy_only=False)[who]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(pos), pa.array(t.view(np.int64)), pa.array(sl.view(np.int64)), pa.array(holes)], names=["id", "pos", "tpl", "slots", "holes"]
                )

    return spread(df.where(F.col(key).isNotNull() & F.col("text").isNotNull()).select(F.col(key).cast("bigint").alias("id"), "text")).mapInArrow(run, "id bigint, pos int, tpl bigint, slots bigint, holes int")


def _names(items: DataFrame) -> np.ndarray:
    return bloom.build(name_words(items).select(F.xxhash64("word")))


def _met(docs: DataFrame, side: DataFrame, names: np.ndarray, on: list[str]) -> DataFrame:
    """Windows of the documents joined with those of the items."""
    few = side.count() <= BROADCAST_ROWS
    doc = window_rows(docs, "doc_id", names, None if few else bloom.build(side.select("tpl").distinct())).withColumnRenamed("id", "doc_id")
    return doc.join(F.broadcast(side) if few else side.hint("merge"), on)


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents that hold WINDOW consecutive words of an item, word by word."""
    names = _names(items)
    side = window_rows(items, "item_id", names).select(F.col("id").alias("item_id"), "tpl", "slots").distinct()
    return _met(docs, side, names, ["tpl", "slots"]).select("doc_id", "item_id").distinct()


def one_to_one(ours: list[str], theirs: list[str], codes: Codes) -> bool:
    """Whether two runs have one template and their slots map one to one, with one slot changed at least."""
    there, back, changed = {}, {}, False
    for a, b in zip(ours, theirs):
        (ta, _, slot), (tb, *_) = codes[a], codes[b]
        if ta != tb or (slot and (there.setdefault(a, b) != b or back.setdefault(b, a) != a)):
            return False
        changed = changed or a != b
    return changed


def reparameterised(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, words): documents that hold a long run of an item's template with other slots, mapped one to one.

    Only windows with enough plain words are joined, a template of placeholders alone says nothing. Windows of a pair on
    one diagonal make a run as long as they touch, so that all words in between stand in one of them; a changed word ends
    the run and what follows is a run of its own. Runs of RUN words are compared slot by slot; the longest good one counts.
    """
    names = _names(items)
    plain = F.col("holes").between(0, WINDOW - PLAIN)
    side = window_rows(items, "item_id", names).where(plain).select(F.col("id").alias("item_id"), F.col("pos").alias("ipos"), "tpl")
    hit = _met(docs, side, names, ["tpl"]).select("doc_id", "item_id", (F.col("pos") - F.col("ipos")).alias("shift"), "ipos").distinct()
    line = Window.partitionBy("doc_id", "item_id", "shift").orderBy("ipos")
    parted = hit.withColumn("new", F.coalesce(F.col("ipos") - F.lag("ipos").over(line) > WINDOW, F.lit(False)).cast("int"))
    runs = parted.withColumn("run", F.sum("new").over(line)).groupBy("doc_id", "item_id", "shift", "run").agg(F.min("ipos").alias("a"), (F.max("ipos") + WINDOW).alias("z"))
    runs = cut(runs.where(F.col("z") - F.col("a") >= RUN).select("doc_id", "item_id", "shift", "a", "z"))
    texts = runs.hint("merge").join(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("theirs")), "doc_id")
    texts = texts.hint("merge").join(items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").alias("ours")), "item_id").where("theirs is not null and ours is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(names)
        for b in batches:
            out = []
            for doc, item, shift, a, z, ours, theirs in zip(*(c.to_pylist() for c in b.columns)):
                p, q = words(ours)[a:z], words(theirs)[a + shift : z + shift]
                if len(p) == len(q) == z - a and one_to_one(p, q, codes):
                    out.append((doc, item, z - a))
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32()))], names=["doc_id", "item_id", "words"])

    good = texts.select("doc_id", "item_id", "shift", "a", "z", "ours", "theirs").mapInArrow(run, "doc_id bigint, item_id bigint, words int")
    return good.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))
