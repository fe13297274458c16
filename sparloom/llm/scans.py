"""Noise in text from scanned pages: found per block and field, and repaired into continuous paragraphs.

1. Vocabulary: word counts over all blocks, pre-aggregated per partition; a word is known from KNOWN sightings, however
   large the input. The vocabulary stays distributed: words are looked up by joins, behind a Bloom filter of bounded size.
2. Misreads: every word shares character trigrams with known words that are much more frequent (inverted join of
   q-grams); gradient-boosted trees rank the candidates by look-alike cost, frequency and overlap, trained on known words
   corrupted with look-alike characters.
3. Line pairs: a hyphen at a line end (or where one was) is a break if the joined word is known, or is a misread of a
   known word, and the hyphenated form is no compound. Lines at the edges of pages are furniture by the file's and the
   corpus's statistics: how many pages of the file repeat the line (look-alike characters folded), how often such a line
   stands at page edges rather than in the body, and what it looks like.
4. Repair: furniture out, broken words joined, misread words replaced, lines of a paragraph joined.

Defined results
    * null and blank texts hold no noise and stay as they are; tables and code keep their lines.
    * a block without a page number is a page of its own; copies of a block come out once; null ids are left out.
    * empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparloom.llm import bloom
from sparloom.llm.boosting import Boosted
from sparloom.session import cut, spread

#: Sightings that make a word known.
KNOWN = 4
#: A replacement must be this many times as frequent as the word it replaces.
RATIO = 8
#: Known words used to train the ranker, at most; each is corrupted three times.
SAMPLE = 600
#: What is read as what.
LOOKALIKES = [
    ("m", "rn"), ("m", "in"), ("m", "nn"), ("n", "ri"), ("u", "ii"), ("d", "cl"), ("w", "vv"), ("v", "\\/"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("h", "li"), ("rn", "m"), ("in", "m"), ("ri", "n"), ("ii", "u"), ("cl", "d"),
    ("o", "0"), ("o", "6"), ("l", "1"), ("l", "|"), ("l", "i"), ("l", "t"), ("i", "1"), ("i", "l"), ("i", "|"), ("i", "j"), ("s", "5"), ("b", "6"), ("b", "8"), ("g", "9"), ("g", "q"), ("q", "g"), ("q", "9"), ("z", "2"), ("a", "4"), ("a", "@"), ("t", "7"), ("e", "3"), ("b", "h"), ("h", "b"),
    ("e", "c"), ("c", "e"), ("c", "o"), ("o", "c"), ("e", "o"), ("o", "e"), ("t", "f"), ("f", "t"), ("t", "l"), ("f", "l"), ("n", "u"), ("u", "n"), ("v", "y"), ("y", "v"), ("u", "v"), ("v", "u"), ("a", "o"), ("a", "à"), ("a", "á"), ("a", "ä"), ("e", "é"), ("e", "è"), ("e", "ê"), ("i", "í"), ("i", "ì"), ("o", "ó"), ("o", "ò"), ("o", "ö"), ("u", "ú"), ("u", "ü"), ("c", "ç"), ("n", "ñ"), ("ä", "a"), ("ö", "o"), ("ü", "u"), ("ß", "b"),
]
PAIRS = frozenset(LOOKALIKES)
HYPHENS = "-­‐‑‒–¬"
GAP = re.compile(rf"[{HYPHENS}](?:[ \t]*\n[ \t>]*|[ \t]+)|­")
PART = re.compile(r"(?:[^\W_]|\\/|\|)+")
COMPOUND = re.compile(r"[(\"']?([^\W\d_]{2,}-[^\W\d_]{2,})(?:-[^\W\d_]+)*[.,;:)\"']*$")
TAIL = re.compile(r"(?:[^\W_]|\\/|\|)+$")
TOKEN = re.compile(r"(?:[^\W_]|\\/|\||@)+")
HAN = re.compile(r"[㐀-鿿]")
ROMAN = r"(?=[ivxlc])(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
#: Printed page numbers with their dress; a bare one needs a gap when it stands inside a line.
DRESSED = rf"[-–—~] ?(?:\d{{1,4}}|{ROMAN}) ?[-–—~]|\[ ?(?:\d{{1,4}}|{ROMAN}) ?\]|\((?:\d{{1,4}}|{ROMAN})\)|(?:page|seite|pg\.?|p\.|s\.|bl\.|blatt|sheet)\s*(?:\d{{1,4}}|{ROMAN})(?:\s*(?:of|von|/)\s*\d{{1,4}})?|第\s*\d{{1,4}}\s*页(?:[\s,，/]*共\s*\d{{1,4}}\s*页)?|\d{{1,4}}\s*/\s*\d{{1,4}}|[A-Z]-\d{{1,3}}"
BARE = rf"\d{{1,4}}|{ROMAN}"
PURE = re.compile(rf"(?i)^\s*(?:{DRESSED}|{BARE})\s*$")
INSIDE = re.compile(rf"(?i)^\s*(?:(?P<a>{DRESSED}|{BARE})(?:\s{{2,}}|\s*[|·•]\s*|\s*\.{{3,}}\s*|\t+)(?P<x>\S.*)|(?P<y>.*?\S)(?:\s{{2,}}|\s*[|·•]\s*|\s*\.{{3,}}\s*|\t+)(?P<b>{DRESSED}|{BARE})|(?P<z>.*?\S)\s+(?P<c>{DRESSED})|(?P<d>{DRESSED})\s+(?P<w>\S.*))\s*$")
#: Without one of these a line holds no page number beside other text.
MARKS = re.compile(r"(?i)\s{2}|[|·•\[\]\t—–~页()]|\.{3}|- ?\w+ ?-|\b(?:page|seite|pg|p|s|bl|blatt|sheet)\b|\d\s*/\s*\d|\b[a-z]-\d{1,3}\b")
FOLD = {c: "e" for c in "ceo0q"} | {c: "i" for c in "iljt1|f!mnruvy7"} | {"s": "s", "5": "s", "b": "h", "h": "h", "6": "h", "8": "h", "g": "g", "9": "g", "d": "ei", "w": "i", "\\": "i", "/": "", "ﬁ": "i", "ﬂ": "i", "a": "a", "4": "a", "@": "a", "z": "z", "2": "z"}


def words_of(raw: str) -> list[str]:
    """The words of a blank-free string in lower case; identifiers, codes and Chinese give none."""
    if "_" in raw or HAN.search(raw):
        return []
    out = []
    for t in TOKEN.findall(raw):
        t = t.strip("|@").lower() if t[0] in "|@" and t[-1] in "|@" else t.lower()
        letters = sum(c.isalpha() for c in t)
        digits = sum(c.isdigit() for c in t)
        if letters >= 2 and len(t) <= 40 and digits <= 2 and digits < letters and (letters < len(t) or letters >= 3):
            out.append(t)
    return out


class Words(dict):
    """raw string -> its words, remembered per worker up to a bound."""

    def __missing__(self, raw):
        w = tuple(words_of(raw))
        if len(self) < 400_000:
            self[raw] = w
        return w


def breaks(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, left, right) of the hyphens that may break a word."""
    out, last = [], 0
    for m in GAP.finditer(text):
        right = PART.match(text, m.end())
        left = TAIL.search(text[max(last, m.start() - 40) : m.start()]) if right else None
        if left:
            x, y = left[0], right[0]
            start = m.start() - len(x)
            if not (x[-1].isdigit() and y[0].isdigit()) and text[start - 1 : start] != "_" and text[right.end() : right.end() + 1] != "_":
                out.append((start, right.end(), x, y))
                last = m.end()
    return out


def without(text: str, found: list[tuple[int, int, str, str]]) -> str:
    """The text without the broken words."""
    out, at = [], 0
    for a, b, _, _ in found:
        out.append(text[at : max(a, at)])
        at = max(at, b)
    return " ".join([*out, text[at:]])


def may_break(text: str) -> bool:
    return GAP.search(text) is not None


# ---- vocabulary -------------------------------------------------------------------------------------------------


def vocabulary(blocks: DataFrame) -> DataFrame:
    """(word, n): sightings of each word and hyphenated compound over all contents; words only ever seen broken have n = 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, count, joined = Words(), Counter(), set()

        def out():
            n = Counter()
            for raw, k in count.items():
                for w in memo[raw]:
                    n[w] += k
                if "-" in raw and (m := COMPOUND.match(raw)):
                    n[m[1].lower()] += k
            for w in joined:
                n[w] += 0
            count.clear()
            joined.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(n.keys()), pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for field, col in enumerate(b.columns):
                for t in col.to_pylist():
                    if not t:
                        continue
                    if may_break(t):
                        found = breaks(t)
                        for _, _, x, y in found:
                            joined.update(words_of(x + y))
                        if found and not field:
                            t = without(t, found)
                    if not field:
                        count.update(t.split())
            if len(count) > 300_000:
                yield out()
        yield out()

    return spread(blocks.select("content", "cleaned_content")).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


# ---- misreads ---------------------------------------------------------------------------------------------------


def look_cost(seen: str, true: str) -> float:
    """Cheapest way to read ``true`` as ``seen``: a fifth for look-alikes, one for anything else; ends cut off first."""
    a = 0
    while a < min(len(seen), len(true)) and seen[a] == true[a]:
        a += 1
    z = 0
    while z < min(len(seen), len(true)) - a and seen[-1 - z] == true[-1 - z]:
        z += 1
    lo, hi = max(0, a - 1), max(0, z - 1)
    s, t = seen[lo : len(seen) - hi], true[lo : len(true) - hi]
    if len(s) > 14 or abs(len(s) - len(t)) > 4:
        return 9.0
    best = np.full((len(s) + 1, len(t) + 1), 9.0)
    best[0, 0] = 0.0
    for i in range(len(s) + 1):
        for j in range(len(t) + 1):
            v = best[i, j]
            if v >= 3:
                continue
            if i < len(s) and j < len(t) and s[i] == t[j]:
                best[i + 1, j + 1] = min(best[i + 1, j + 1], v)
            for di in (1, 2):
                for dj in (1, 2):
                    if i + di <= len(s) and j + dj <= len(t) and (t[j : j + dj], s[i : i + di]) in PAIRS:
                        best[i + di, j + dj] = min(best[i + di, j + dj], v + 0.2)
            if i < len(s) and j < len(t):
                best[i + 1, j + 1] = min(best[i + 1, j + 1], v + 1)
            if i < len(s):
                best[i + 1, j] = min(best[i + 1, j], v + 1)
            if j < len(t):
                best[i, j + 1] = min(best[i, j + 1], v + 1)
    return float(best[len(s), len(t)])


def features(seen: str, true: str, n_seen: int, n_true: int, shared: int) -> list[float]:
    return [look_cost(seen, true), np.log1p(n_true) - np.log1p(n_seen), min(len(seen), len(true)), abs(len(seen) - len(true)), shared / max(1, len(true) + 1), float(any(not c.isalpha() for c in seen)), float(not seen.isascii())]


def corrupt(word: str, rng) -> str:
    """One or two look-alike replacements."""
    for _ in range(1 + int(rng.integers(2))):
        options = [(i, t, s) for t, s in LOOKALIKES for i in range(len(word)) if word.startswith(t, i)]
        if options:
            i, t, s = options[int(rng.integers(len(options)))]
            word = word[:i] + s + word[i + len(t) :]
    return word


def grams(w: str) -> list[str]:
    p = f"^{w}$"
    return list({p[i : i + 3] for i in range(len(p) - 2)})


def fit_ranker(sample: list[tuple[str, int]], seed: int = 3) -> Boosted:
    """Trained on known words, at most SAMPLE, corrupted with look-alikes (true) against their nearest other words and
    against random edits and fragments of words (false)."""
    rng = np.random.default_rng(seed)
    index: dict[str, set] = {}
    count = dict(sample)
    for w in count:
        for g in grams(w):
            index.setdefault(g, set()).add(w)
    x, y = [], []

    def rows(seen, truth, n_seen):
        near = Counter(o for g in grams(seen) for o in index.get(g, ()))
        if truth and truth not in near:
            near[truth] = 0
        for o, k in near.most_common(4) + ([(truth, near[truth])] if truth else []):
            if o != seen:
                x.append(features(seen, o, n_seen, count[o], k))
                y.append(float(o == truth))

    for w, n in sample:
        if len(w) < 3:
            continue
        for _ in range(3):
            c = corrupt(w, rng)
            if c != w and c not in count:
                rows(c, w, int(rng.integers(0, max(1, n // 20) + 1)))
        k = int(rng.integers(2, max(3, len(w) - 1)))
        rows(w[:k], None, 1)
        rows(w[k:] or w[:2], None, 1)
        edited = list(w)
        edited[int(rng.integers(len(w)))] = chr(97 + int(rng.integers(26)))
        e = "".join(edited)
        if e not in count and look_cost(e, w) >= 1:
            rows(e, None, 1)
    if not x or len(set(y)) < 2:
        x, y = [[0.2, 5, 5, 0, 0.5, 0, 0], [2.0, 1, 5, 2, 0.3, 0, 0]] * 4, [1.0, 0.0] * 4
    return Boosted().fit(np.array(x), np.array(y))


def corrections(vocab: DataFrame) -> DataFrame:
    """(word, right): misread words with the known word they stand for, by q-gram inverted join and boosted ranking.

    A candidate shares a quarter of its grams with the word, so one of its grams but the commonest quarter is shared:
    only those are posted, under gram and length, which keeps common grams short. Two look-alikes change the length by
    two at most."""
    sample = [(r["word"], r["n"]) for r in vocab.where(F.col("n") >= KNOWN).where(F.col("word").rlike(r"^\p{L}{3,}$")).orderBy(F.desc("n"), "word").limit(SAMPLE).collect()]
    model = fit_ranker(sample)
    gram = lambda c: F.expr(f"array_distinct(transform(sequence(1, char_length({c})), i -> substring(concat('^', {c}, '$'), i, 3)))")
    weak = vocab.select("word", F.col("n").alias("n_word"), F.explode(gram("word")).alias("g")).withColumn("size", F.explode(F.expr("sequence(greatest(1, char_length(word) - 2), char_length(word) + 2)")))
    known = vocab.where((F.col("n") >= KNOWN) & F.col("word").rlike(r"^\p{L}{2,}$")).select(F.col("word").alias("right"), F.col("n").alias("n_right"), gram("word").alias("grams"))
    each = known.select("right", "n_right", F.size("grams").alias("all"), F.explode("grams").alias("g"))
    each = each.join(each.groupBy("g").agg(F.count("*").alias("df")), "g").withColumn("at", F.row_number().over(Window.partitionBy("right").orderBy("df", "g")))
    need = F.greatest(F.lit(1), F.floor((F.char_length("right") + 2) / 4))
    posted = each.where(F.col("at") <= F.col("all") - need + 1).select("right", "n_right", "g", F.char_length("right").alias("size"))
    near = F.col("n_right") >= RATIO * F.greatest("n_word", F.lit(1))
    pairs = weak.join(posted, ["g", "size"]).where(near).select("word", "right", "n_word", "n_right").distinct()
    pairs = pairs.withColumn("shared", F.size(F.array_intersect(gram("word"), gram("right")))).where(F.col("shared") >= need)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns)))
            kept, x = [], []
            for word, right, nw, nr, k in rows:
                f = features(word, right, nw, nr, k)
                if 0 < f[0] < 1:
                    kept.append((word, right))
                    x.append(f)
            p = model.predict(np.array(x)) if x else np.zeros(0)
            # A replacement made of look-alikes alone is what is looked for; the model orders such candidates and drops unlikely ones.
            good = [(w, r, float(v)) for (w, r), v in zip(kept, p) if v >= 0.3]
            cols = list(zip(*good)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())], names=["word", "right", "p"])

    scored = pairs.select("word", "right", "n_word", "n_right", "shared").mapInArrow(run, "word string, right string, p double")
    return scored.groupBy("word").agg(F.max_by("right", F.struct("p", "right")).alias("right"))


# ---- line pairs ----

def join_features(x: str, y: str, known: dict[str, int]) -> list[float]:
    """Of the end of a line and the start of the next: sightings of the joined word, of the compound and of the parts."""
    a, b = x.lower(), y.lower()
    return [np.log1p(known.get(a + b, 0)), np.log1p(known.get(f"{a}-{b}", 0)), np.log1p(known.get(a, 0)), np.log1p(known.get(b, 0)), min(len(a), len(b))]


def strong_words(vocab: DataFrame, fixes: DataFrame) -> DataFrame:
    """(word, n): known words that are no misreads of others."""
    return vocab.where(F.col("n") >= KNOWN).join(fixes.select("word"), "word", "left_anti").select("word", "n")


def fit_joins(strong: DataFrame, seed: int = 5) -> Boosted:
    """Trained on at most SAMPLE known words cut anywhere (true), SAMPLE compounds at their hyphen and SAMPLE pairs of words (false)."""
    rng = np.random.default_rng(seed)
    some = lambda c: [r["word"] for r in strong.where(c).select("word").orderBy(F.xxhash64("word", F.lit(seed)), "word").limit(SAMPLE).collect()]
    words, compounds = some("word not like '%-%' and char_length(word) >= 5"), some("word like '%-%'")
    pairs = []
    for w in words:
        k = int(rng.integers(2, len(w) - 1))
        pairs.append((w[:k], w[k:], 1.0))
        pairs.append((w, words[int(rng.integers(len(words)))], 0.0))
    pairs += [(*c.split("-", 1), 0.0) for c in compounds]
    asked = sorted({w for a, b, _ in pairs for w in (a + b, f"{a}-{b}", a, b)})
    known = {r["word"]: r["n"] for r in strong.join(F.broadcast(strong.sparkSession.createDataFrame([(w,) for w in asked], "word string")), "word", "left_semi").collect()}
    pairs = [(a, b, v) for a, b, v in pairs if v or "-" in f"{a}{b}" or a + b not in known]
    x, y = [join_features(a, b, known) for a, b, _ in pairs], [v for *_, v in pairs]
    if len(set(y)) < 2:
        x, y = [[3.0, 0, 0, 0, 3], [0.0, 3, 3, 3, 3]] * 4, [1.0, 0.0] * 4
    return Boosted(rounds=12).fit(np.array(x), np.array(y))


def joins(rows: DataFrame, strong: DataFrame) -> DataFrame:
    """(word, line): the pairs of fragments that are one broken word. Each pair is asked once; what is known of it is looked
    up by joins. Found noise and repair both use this decision."""
    model = fit_joins(strong)
    pairs = rows.where("kind = 'h'").select("word", "line").distinct()
    asked = pairs.select("word", "line", F.posexplode(F.array(F.concat("word", "line"), F.concat_ws("-", "word", "line"), "word", "line")).alias("role", "w"))
    n = asked.join(strong.select(F.col("word").alias("w"), "n"), "w").groupBy("word", "line").agg(*[F.max(F.when(F.col("role") == i, F.col("n"))).alias(f"n{i}") for i in range(4)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                a, z, *counts = (c.to_pylist() for c in b.columns)
                x = np.array([[*(np.log1p(v or 0) for v in c), min(len(p), len(q))] for p, q, *c in zip(a, z, *counts)])
                keep = pa.array(model.predict(x) >= 0.5)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["word", "line"])

    return n.where("n0 is not null").select("word", "line", "n0", "n1", "n2", "n3").mapInArrow(run, "word string, line string")


class Suspects(dict):
    """raw string -> those of its words that may be misreads by the Bloom filter, remembered per worker up to a bound."""

    def __init__(self, bits: np.ndarray):
        super().__init__()
        self.bits = bits.tobytes()

    def maybe(self, word: str) -> bool:
        return bloom.one(self.bits, xxhash.xxh64_intdigest(word, 42))

    def __missing__(self, raw):
        w = tuple(x for x in words_of(raw) if self.maybe(x))
        if len(self) < 400_000:
            self[raw] = w
        return w


def fit_furniture(rows: list) -> Boosted | None:
    """Whether a line is furniture by its looks alone, trained on at most 4 * SAMPLE lines whose repetition tells: on three
    pages or more and hardly ever in the body (true), mostly in the body (false). None where both kinds don't occur."""
    x, y = [], []
    for r in rows:
        share = r["c_body"] / max(1, r["c_edge"] + r["c_body"])
        if r["pages"] >= 3 and share <= 0.05:
            x.append(looks(r))
            y.append(1.0)
        elif share >= 0.3:
            x.append(looks(r))
            y.append(0.0)
    return Boosted(rounds=12).fit(np.array(x), np.array(y)) if len(set(y)) == 2 else None


def looks(r) -> list[float]:
    return [float(r["titled"]), float(r["dated"]), float(r["n_words"]), float(r["chars"])]


# ---- blocks -----------------------------------------------------------------------------------------------------


FOLDING = str.maketrans(FOLD | {c: "" for c in " \t\u3000-–—.,:;|'\"()[]"})


def fold(text: str) -> str:
    """A running line with look-alike characters made equal, so that its misread copies have the same key."""
    t = text.lower()
    if not t.isascii():
        t = "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))
    return re.sub(r"i+", "i", t.translate(FOLDING))


def edge_line(line: str) -> tuple[str, bool, bool]:
    """(text, holds a page number, is nothing else) of a line at the edge of a page."""
    if len(line) <= 24 and PURE.match(line):
        return "", True, True
    m = INSIDE.match(line) if MARKS.search(line) else None
    if m:
        rest = m["x"] or m["y"] or m["z"] or m["w"]
        return rest.strip(" .|·•\t"), True, False
    return line.strip(), False, False


HEADING = re.compile(r"(?i)(?:figure|table|abbildung|tabelle|图|表)\s*\d|\d+\.\d+")
SENTENCE = re.compile(r"[.!?] +[^\W\d_]{2}|[。，；]")
LETTERS = re.compile(r"[^\W\d_]{2}")
CODE = re.compile(r":=|[=<>{};&]|^\s*(?:if|for|while)\b|\w_\w")


def looks_running(text: str) -> bool:
    """Short, no sentence, no table row, no heading number."""
    if not 3 <= len(text) <= 90 or text[-1] in ".。;；:：,，?!？！" or text.count("|") > 1 or SENTENCE.search(text):
        return False
    if len(text.split()) > 6 and not title_like(text):
        return False
    return not HEADING.match(text) and bool(LETTERS.search(text)) and not CODE.search(text)


def title_like(text: str) -> bool:
    """Words with capitals throughout, or a document code."""
    w = [x for x in re.findall(r"[^\W\d_][\w'-]*", text)]
    big = sum(x[0].isupper() for x in w)
    return bool(w) and len(w) <= 10 and big >= 0.75 * len(w) and (len(w) >= 2 or bool(re.search(r"[A-Z]{2,}-[A-Z]{2}-\d+", text)))


NOISE = "block_id bigint, field string, kind string, word string, file bigint, page int, top int, bottom int, fold bigint, pn boolean, pure boolean, shape boolean, title boolean, line string"


def edge_lines(text: str) -> list[tuple]:
    """(line, lines above it, lines below it, rest, holds a page number, is nothing else, looks running) of the lines at the edges
    that may be furniture. The first and last two filled lines are looked at, and further ones as long as every line outside
    of them may be furniture; the count of lines is null for an edge from which a line is not reached."""
    lines = [x for x in text.split("\n") if x.strip()]
    n = len(lines)
    seen, at = {}, ({}, {})
    for side in (0, 1):
        chain = True
        for d in range(n):
            if d >= 2 and not chain:
                break
            i = n - 1 - d if side else d
            if i not in seen:
                raw = lines[i]
                got = edge_line(raw) if len(raw) <= 120 else ("", False, False)
                seen[i] = (*got, len(raw) <= 120 and looks_running(got[0]))
            at[side][i] = d
            chain = chain and (seen[i][1] or seen[i][3])
    return [(lines[i].strip(), at[0].get(i), at[1].get(i), *got) for i, got in sorted(seen.items()) if got[1] or got[3]]


def scan_blocks(blocks: DataFrame, fixes: DataFrame) -> DataFrame:
    """One pass over the texts: possible word breaks (kind h, the fragments in word and line), words that may be misreads
    (kind u, b for broken ones), edge lines (kind e)."""
    sent = blocks.sparkSession.sparkContext.broadcast(bloom.build(fixes.select(F.xxhash64("word"))))
    names = ["block_id", "field", "kind", "word", "file", "page", "top", "bottom", "fold", "pn", "pure", "shape", "title", "line"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string()]
    blank = (None,) * 9

    def one(out, memo, bid, file, page, field, t):
        body = t
        if may_break(t):
            found = breaks(t)
            for x, y in {(x.lower(), y.lower()) for _, _, x, y in found}:
                out.append((bid, field, "h", x, *blank, y))
                for w in words_of(x + y):
                    if memo.maybe(w):
                        out.append((bid, field, "b", w, *blank, None))
            if found:
                body = without(t, found)
        for w in {w for raw in set(body.split()) for w in memo[raw]}:
            out.append((bid, field, "u", w, *blank, None))
        for raw, top, bottom, text, pn, pure, shape in edge_lines(t):
            out.append((bid, field, "e", None, file, page, top, bottom, xxhash.xxh64_intdigest(fold(text)) - (1 << 63) if shape else None, pn, pure, shape, shape and title_like(text), raw))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Suspects(sent.value)
        for b in batches:
            out = []
            for bid, file, page, content, cleaned in zip(*(c.to_pylist() for c in b.columns)):
                if content:
                    one(out, memo, bid, file, page, "content", content)
                if cleaned:
                    one(out, memo, bid, file, page, "cleaned_content", cleaned)
            cols = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    file = F.xxhash64("project_id", "file_name")
    return spread(blocks.where("block_id is not null").select("block_id", file.alias("file"), "page_num", "content", "cleaned_content")).mapInArrow(run, NOISE)


def furniture(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """(block_id, field, line, running, number, top, bottom): the edge lines that are furniture, and their lines from each edge.

    The two outer lines of a page edge stand for themselves; a line further in counts where all lines outside of it are
    furniture, and as a bare number where none of those is one."""
    page = F.coalesce(F.col("page_num").cast("bigint"), -F.col("block_id") - 1)
    texts = blocks.where("block_id is not null").select("block_id", F.xxhash64("project_id", "file_name").alias("file"), page.alias("page_key"), (F.trim(F.regexp_replace(F.coalesce("content", F.lit("")), r"[\s\p{Z}]", "")) != "").alias("has"))
    ends = texts.where("has").groupBy("file", "page_key").agg(F.min("block_id").alias("first_block"), F.max("block_id").alias("last_block"))
    e = edges.withColumn("page_key", F.coalesce(F.col("page").cast("bigint"), -F.col("block_id") - 1)).join(ends, ["file", "page_key"])
    first, last = F.col("block_id") == F.col("first_block"), F.col("block_id") == F.col("last_block")
    e = e.withColumn("shallow", F.coalesce((F.col("top") < 2), F.lit(False)) | F.coalesce((F.col("bottom") < 2), F.lit(False)))
    e = e.withColumn("top", F.when(first, F.col("top"))).withColumn("bottom", F.when(last, F.col("bottom")))
    e = e.withColumn("reached", F.col("top").isNotNull() | F.col("bottom").isNotNull()).withColumn("edge", F.coalesce(F.least("top", "bottom") < 2, F.lit(False)))
    own = e.where("field = 'content' and fold is not null")
    outer = lambda c: F.when(F.col("shallow"), c)
    per_file = own.groupBy("file", "fold").agg(
        F.count_distinct(F.when(F.col("edge"), F.col("page_key"))).alias("pages"), F.count_if(F.col("edge")).alias("n_edge"), F.count_if(F.col("shallow") & ~F.col("edge")).alias("n_body"),
        F.max(outer((F.col("pn") | F.col("line").rlike(r"[A-Z]{2,5}-[A-Z]{2}-\d{3,}")).cast("int"))).alias("dated"), F.max(outer(F.col("title").cast("int"))).alias("titled"),
        F.min(outer(F.size(F.split("line", r"\s+")))).alias("n_words"), F.min(outer(F.char_length("line"))).alias("chars"),
        F.count_distinct(F.when(F.col("reached"), F.col("page_key"))).alias("all_pages"), F.count_if(F.col("reached")).alias("all_edge"), F.count_if(~F.col("reached")).alias("all_body"),
    )
    corpus = per_file.groupBy("fold").agg(F.sum("n_edge").alias("c_edge"), F.sum("n_body").alias("c_body"), F.sum("all_edge").alias("d_edge"), F.sum("all_body").alias("d_body"), F.count_if(F.col("pages") > 1).alias("c_files"))
    stats = cut(per_file.join(corpus, "fold"))
    lone = F.col("c_body") <= 0.15 * (F.col("c_edge") + F.col("c_body"))
    inner = (F.col("all_pages") >= 3) & (F.col("d_body") <= 0.15 * (F.col("d_edge") + F.col("d_body")))
    model = fit_furniture(stats.where("n_edge + n_body > 0").orderBy(F.xxhash64("file", "fold"), "file", "fold").limit(4 * SAMPLE).collect())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            p = model.predict(np.array([looks(r) for r in rows])) if rows and model else np.zeros(len(rows))
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("fold"), pa.array(p)], names=["file", "fold", "p"])

    seen = (F.col("pages") >= 2) | (F.col("c_files") >= 3)
    sure = stats.where(lone & (seen | inner)).select("file", "fold")
    rest = stats.where(lone & ~seen & ~inner & (F.col("n_edge") >= 1)).select("file", "fold", "titled", "dated", "n_words", "chars")
    running = sure.unionByName(rest.mapInArrow(judge, "file bigint, fold bigint, p double").where("p >= 0.5").select("file", "fold")).withColumn("running", F.lit(True))
    marked = e.where("reached").join(running, ["file", "fold"], "left")
    run = F.coalesce("running", F.lit(False))
    number = F.col("pn") & (F.col("pure") | run)
    field = Window.partitionBy("block_id", "field")
    found = marked.select("block_id", "field", "line", "pure", "top", "bottom", run.alias("running"), number.alias("number")).where("running or number")
    for side in ("top", "bottom"):
        found = found.withColumn(f"{side}_all", F.collect_set(side).over(field)).withColumn(f"{side}_pure", F.min(F.when(F.col("pure"), F.col(side))).over(field))
    outside = lambda side: F.size(F.filter(f"{side}_all", lambda x: x < F.col(side))) == F.col(side)
    stands = lambda side: F.when((F.col(side) < 2) | (outside(side) & (~F.col("pure") | (F.col(f"{side}_pure") == F.col(side)))), F.col(side))
    kept = found.select("block_id", "field", "line", "running", "number", stands("top").alias("top"), stands("bottom").alias("bottom"))
    return kept.where("top is not null or bottom is not null")


def first_copies(blocks: DataFrame) -> DataFrame:
    """Blocks without their second deliveries: the copies differ in the load time only."""
    return blocks.select("block_id", "project_id", "file_name", "page_num", "content", "block_type", "cleaned_content")


def analyse(blocks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(noise rows, corrections, broken words, furniture); the first three are cut, as several results are drawn from them."""
    vocab = cut(vocabulary(blocks))
    fixes = cut(corrections(vocab))
    rows = cut(scan_blocks(blocks, fixes))
    return rows, fixes, cut(joins(rows, cut(strong_words(vocab, fixes)))), furniture(rows.where("kind = 'e'"), blocks)


def noise(blocks: DataFrame) -> DataFrame:
    """(block_id, field, noise): every kind of noise a field holds."""
    rows, fixes, broken, lines = analyse(first_copies(blocks))
    looked = rows.where("kind in ('u', 'b')").select("block_id", "field", "kind", "word").join(fixes, "word")
    misread = looked.select("block_id", "field", F.lit("misread").alias("noise"))
    cut_words = rows.where("kind = 'h'").select("block_id", "field", "word", "line").join(broken, ["word", "line"], "left_semi").select("block_id", "field")
    hyphen = looked.where("kind = 'b'").select("block_id", "field").unionByName(cut_words).withColumn("noise", F.lit("hyphenation"))
    head = lines.where("running").select("block_id", "field", F.lit("running_header").alias("noise"))
    number = lines.where("number").select("block_id", "field", F.lit("page_number").alias("noise"))
    return misread.unionByName(hyphen).unionByName(head).unionByName(number).distinct()


def repair_text(text: str, drop: set[int], fixes: dict[str, str], broken: set[tuple[str, str]], flow: bool) -> str:
    """Furniture out (filled lines, counted from 0 at the top and from -1 at the bottom), broken words (their fragments in ``broken``) joined, misread words replaced; in running text also the lines of a paragraph joined."""
    lines = text.split("\n")
    if drop:
        filled = [i for i, x in enumerate(lines) if x.strip()]
        out = {filled[k] for k in drop}
        lines = [x for i, x in enumerate(lines) if i not in out]
    t = "\n".join(lines)
    out, at = [], 0
    for a, b, x, y in breaks(t) if may_break(t) else []:
        j = (x + y).lower()
        if a >= at:
            out.append(t[at:a])
            out.append(x + y if (x.lower(), y.lower()) in broken or j in fixes else re.sub(rf"([{HYPHENS}])\s+", r"\1", t[a:b]))
            at = b
    t = "".join(out) + t[at:]
    if fixes:
        t = TOKEN.sub(lambda m: _cased(m[0], fixes[m[0].lower()]) if m[0].lower() in fixes else m[0], t)
    if flow:
        t = re.sub(r"(?<![.!?。！？:：\n])[ \t]*\n[ \t]*(?=[^\s#\-*•|\d])", lambda m: "" if HAN.match(t[m.end() : m.end() + 1]) else " ", t)
    return t.strip()


def _cased(seen: str, right: str) -> str:
    return right.upper() if seen.isupper() and len(seen) > 1 else right.capitalize() if seen[:1].isupper() or (not seen[:1].isalpha() and seen[1:2].isupper()) else right


def repaired(blocks: DataFrame) -> DataFrame:
    """(block_id, text): the content of every block as continuous, readable paragraphs."""
    src = first_copies(blocks)
    rows, fixes, broken, lines = analyse(src)
    per_word = rows.where("field = 'content' and kind in ('u', 'b')").join(fixes, "word").groupBy("block_id").agg(F.map_from_entries(F.collect_set(F.struct("word", "right"))).alias("fixes"))
    per_break = rows.where("field = 'content' and kind = 'h'").select("block_id", "word", "line").join(broken, ["word", "line"]).groupBy("block_id").agg(F.collect_set(F.struct("word", "line")).alias("broken"))
    per_line = lines.where("field = 'content'").groupBy("block_id").agg(F.collect_set(F.coalesce("top", -1 - F.col("bottom"))).alias("drop"))
    texts = src.where("block_id is not null").groupBy("block_id").agg(F.max(F.struct("content", "block_type")).alias("b")).select("block_id", "b.content", "b.block_type")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = []
            for _, t, k, f, d, h in zip(*(c.to_pylist() for c in b.columns)):
                new.append(None if t is None else repair_text(t, set(d or ()), dict(f or ()), {(x["word"], x["line"]) for x in h or ()}, k == "text"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(new, pa.string())], names=["block_id", "text"])

    joined = texts.join(per_word, "block_id", "left").join(per_line, "block_id", "left").join(per_break, "block_id", "left")
    return joined.select("block_id", "content", "block_type", "fixes", "drop", "broken").mapInArrow(run, "block_id bigint, text string")
