"""Broken prompt and response pairs: ordered rules, every triggered defect comes out.

Rules, in order: emptiness; refusal phrases in three languages; copied question; unclosed delimiters and broken JSON;
abrupt ending; language mismatch. An ending without a full stop is abrupt only where the corpus says so: over all answers
it is counted how often a sentence with the same opening and the same last words ends there and how often it goes on.
Only what such endings ask for is counted: their keys make a Bloom filter, every answer's sentences are counted behind it,
and the counts, exact whatever the size of the input, are joined back.

Defined results
    * a null or blank answer is empty and nothing else; a null question copies nothing and has no language.
    * refusals and copies that also break off are truncated too; a copy breaks off where an opened bracket, a quotation or
      JSON tells, as its end is that of the question; rows delivered twice come out once; rows with a null id are left out.
    * whole answers are read, however long; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparloom.llm import bloom
from sparloom.session import cut, spread

#: An answer of fewer characters is a value rather than a sentence.
SHORT = 25
#: An ending needs this many sightings to be judged by a key, and this share of them at a sentence end to be complete.
SEEN, COMPLETE = 3, 0.3
U = np.uint64

#: Words that say there is no value.
NO_VALUE = frozenset("na ka null none nil nan tbd tba todo undefined unknown empty blank noanswer notavailable notapplicable novalue nodata noresponse keineangabe keineangaben keineantwort nichtverfügbar entfällt leer unbekannt keine 无 暂无 空 未知 没有 无答案 暂无答案 无内容 不详 待定 待补充".split())
NAMES = re.compile(r"\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\b|\b[A-Z]{2}\d+\.\d+\b|\b[A-Z][A-Za-z]*-[A-Z0-9]+\b")
#: Refusal wordings.
REFUSAL = re.compile(
    r"(?i)\b(?:i|we)(?:['’]m| am|['’]re| are) (?:not (?:able|allowed|permitted|in a position)|unable) to\b"
    r"|\b(?:i|we) (?:cannot|can['’]t|can not|could not|won['’]t|will not) (?:be able to |really |possibly )?(?:help|assist|answer|provide|discuss|comment|share|give|offer|respond|reply|say|disclose|comply|do that|support|work that)"
    r"|\b(?:i|we) won['’]t be able to\b|\b(?:i|we) (?:must|have to|need to|would like to) (?:decline|refuse|pass)|\b(?:i|we) (?:decline|refuse) to\b|\bi(?:['’]d| would) (?:rather|prefer) not\b|\b(?:i|we) (?:don['’]t|do not) have (?:permission|access|the authori[sz]ation)"
    r"|\b(?:something|nothing) (?:that )?i (?:can['’]t|cannot|can|may not)\b|\b(?:outside|beyond) (?:of )?(?:what i|my (?:scope|abilit|remit|knowledge|capabilit))|\bno (?:reply|answer|response) (?:can|will) be (?:offered|given|provided)|\bnot (?:something )?i can (?:help|answer|provide|discuss)"
    r"|\b(?:kann|darf|möchte|werde|will) ich\b[^.!?]{0,60}\b(?:nicht|keine[nrs]?|nichts)\b|\bich (?:kann|darf|möchte|werde|will|bin)\b[^.!?]{0,60}\b(?:nicht|keine[nrs]?|nichts|außerstande)\b|\bist mir\b[^.!?]{0,50}\bnicht (?:möglich|gestattet|erlaubt)|\b(?:muss|möchte) ich\b[^.!?]{0,20}\b(?:passen|ablehnen)|\bich muss\b[^.!?]{0,30}\b(?:passen|ablehnen)|außerhalb (?:dessen|meine[rs])"
)
REFUSAL_HAN = re.compile(
    r"(?:无法|不能|不便|不可以|难以|没法)(?:为您|给您|向您)?(?:回答|提供|协助|对此|讨论|透露|评论|给出|处理这|帮助|回应|答复)|恕(?:我)?(?:不能|无法|难)|超出了?我的|我(?:没有|无)(?:权限|权)|拒绝回答"
)
#: Without one of these words no wording of the first list can stand there.
REFUSAL_CUE = re.compile(r"(?i)\b(?:i|we|ich|mir|no|not|beyond|outside|außerhalb)\b")
ASKS = {
    "en": re.compile(r"(?i)\b(?:in|into|auf|ins) (?:english|englisch)|\b(?:english|englische) (?:answer|reply|antwort)|用?英(?:文|语)"),
    "de": re.compile(r"(?i)\b(?:in|into|auf|ins) (?:german|deutsch)|\b(?:german|deutsche) (?:answer|reply|antwort)|用?德(?:文|语)"),
    "zh": re.compile(r"(?i)\b(?:in|into|auf|ins) (?:chinese|mandarin|chinesisch)|\b(?:chinese|chinesische) (?:answer|reply|antwort)|用?(?:中文|汉语|华语)"),
}
#: Function words by language.
WORDS = {
    "en": frozenset("the of a an is are was were and to in for by with on at from that which it its as be must shall not when whenever if while after before between because so this each every both only but than or".split()),
    "de": frozenset("der die das den dem des ein eine einer eines einem und ist sind wird werden mit von auf im zu zum zur bei nach vor für nicht ab um als wenn bis durch wie was solange sobald bevor über außerhalb".split()),
}
#: Words, marks and masks that make the frame of a sentence; for Chinese the characters that bind rather than name.
FRAME = WORDS["en"] | WORDS["de"] | frozenset("#@,，;；:：、的了在由并把被后前时会与和为是到若当则需须其每共随再先从将以及或不")
OPENERS, CLOSERS = "([{（【「『《〈", ")]}）】」』》〉"
SENTENCE_END = ".!?。！？"
TOKEN = re.compile(r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+|[A-Z]{2}\d+\.\d+|\d+(?:\.\d+)*|[㐀-鿿]|[^\W\d_㐀-鿿]+(?:[-'’][^\W\d_㐀-鿿]+)*|[.!?。！？]|[,，;；:：、]")
HAN = re.compile(r"[㐀-鿿]")


MARKS = re.compile(r"[\W_]+")


def bare(text: str | None) -> str:
    """Letters and digits only, in lower case."""
    return MARKS.sub("", (text or "").lower())


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    return len(answer.strip()) < 40 and (not (b := bare(answer)) or b in NO_VALUE) or not re.search(r"[^\W_]", answer)


def refuses(answer: str) -> bool:
    text = unicodedata.normalize("NFC", answer)
    return bool((REFUSAL_CUE.search(text) and REFUSAL.search(text)) or (HAN.search(text) and REFUSAL_HAN.search(text)))


def is_copy(question: str | None, answer: str) -> bool:
    """The question, once or several times, whole or its greater part, and next to nothing else."""
    q, a = bare(question), bare(answer)
    if len(q) < 8 or len(a) < 8:
        return False
    if q in a:
        return len(a.replace(q, "")) <= max(14, len(q) // 10)
    return a in q and len(a) >= max(30, len(q) // 2)


def body(answer: str) -> str:
    """The answer without code fences."""
    t = answer.strip().strip("﻿​")
    m = re.fullmatch(r"```[a-zA-Z]*\s*(.*?)\s*(?:```)?", t, re.S)
    return m.group(1) if m and t.startswith("```") else t


def is_json(text: str) -> bool | None:
    """True for readable JSON, False for broken JSON, None for other text."""
    if not re.match(r'^(?:\{\s*(?:["}]|$)|\[\s*(?:["{\]\d]|$))', text):
        return None
    try:
        json.loads(text)
        return True
    except (ValueError, RecursionError):
        return False


def unclosed(text: str) -> bool:
    """A bracket or quotation mark that opens and never closes."""
    stack = []
    for c in text:
        if c in OPENERS:
            stack.append(CLOSERS[OPENERS.index(c)])
        elif c in CLOSERS and stack and stack[-1] == c:
            stack.pop()
        elif c == "„":
            stack.append("“")
        elif c in "“”" and stack and stack[-1] in "“”":
            stack.pop()
        elif c == "“":
            stack.append("”")
    return bool(stack) or text.count('"') % 2 == 1


def tokens(text: str) -> list[str]:
    """Words in lower case, field names, codes and numbers masked, Han characters one by one, marks as they are."""
    out = []
    for t in TOKEN.findall(text):
        if t[0].isdigit():
            out.append("#")
        elif "_" in t or (t[-1].isdigit() and "." in t):
            out.append("@")
        else:
            out.append(t.lower())
    return out


def language(text: str) -> str | None:
    """en, de or zh by most sentences, None where nothing tells."""
    votes = {"en": 0, "de": 0, "zh": 0}
    some_han = HAN.search(text) is not None
    for s in re.split(r"(?<=[.!?])\s+|[。！？]|\n", NAMES.sub(" ", text)):
        han = len(HAN.findall(s)) if some_han else 0
        words = re.findall(r"[^\W\d_]+", (HAN.sub(" ", s) if han else s).lower())
        if han >= 4 and han >= 2 * len(words):
            votes["zh"] += han
            continue
        en, de = sum(map(WORDS["en"].__contains__, words)), sum(map(WORDS["de"].__contains__, words))
        most = max(en, de)
        if most >= 2 and most > 1.5 * min(en, de):
            votes["en" if en >= de else "de"] += len(s)
    best = max(votes, key=votes.get)
    return best if votes[best] and votes[best] > 0.6 * sum(votes.values()) else None


def wrong_language(question: str | None, answer: str, instruction: str | None) -> bool:
    q = language(question or "")
    a = language(answer) if q else None
    if not a or a == q:
        return False
    return not (ASKS[a].search(question or "") or ASKS[a].search(instruction or ""))


class Positions:
    """Keys of every position of the sentences of some texts, in columns.

    The frame of a position is what was said so far with each run of content words as one star, and the number of content
    words since; the keys are frame and word, frame alone, the last two words, the last word.
    """

    def __init__(self):
        self.codes: dict[str, int] = {}

    def code(self, w: str) -> int:
        """Hash of a token, the lowest bit set for words of the frame."""
        c = self.codes.get(w)
        if c is None:
            c = xxhash.xxh64_intdigest(w) & ~1 | (w in FRAME)
            if len(self.codes) < 500_000:
                self.codes[w] = c
        return c

    def keys(self, sents: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(positions x 4 keys, most specific first; position of each sentence's last token)."""
        sizes = np.array([len(x) for x in sents], dtype=np.int64)
        last = np.cumsum(sizes) - 1
        if not len(sents):
            return np.zeros((0, 4), np.uint64), last
        code = np.array([self.code(t) for x in sents for t in x], dtype=np.uint64)
        n = len(code)
        first = np.repeat(last + 1 - sizes, sizes)
        at = np.arange(n)
        frame = (code & U(1)).astype(bool)
        # Content words since the last frame word of the sentence.
        stop = np.maximum.accumulate(np.where(frame, at, -1))
        run = at - np.maximum(stop, first - 1)
        run[frame] = 0
        star = frame.copy()
        star[1:] &= run[:-1] > 0
        star[0] = False
        star &= at > first
        # Frames as polynomial hashes over frame words and stars, by sums within the sentence.
        place = np.cumsum(frame.astype(np.int64) + star)
        before = np.concatenate([[0], place])[first]
        power = np.cumprod(np.full(int((place - before).max()) + 2, 1000003, dtype=np.uint64))
        value = np.where(frame, code * power[place - before], U(0)) + np.where(star, U(0x9E3779B9) * power[place - before - 1], U(0))
        total = np.cumsum(value)
        prefix = total - np.concatenate([np.zeros(1, np.uint64), total])[first]
        f = prefix * U(31) + np.minimum(run, 6).astype(np.uint64)
        one = code * U(0x9E3779B97F4A7C15)
        prev = np.zeros_like(code)
        prev[1:] = code[:-1]
        prev[at == first] = 0
        two = one + prev * U(0xC2B2AE3D27D4EB4F)
        k = np.stack([f * U(0x165667B19E3779F9) + one, f * U(0x27D4EB2F165667C5) + U(1), two + U(3), one + U(4)], axis=1)
        k ^= k >> U(31)
        k *= U(0xBF58476D1CE4E5B9)
        return k ^ (k >> U(29)), last


def sentences(text: str) -> Iterator[tuple[list[str], bool]]:
    """(tokens, whether it is closed by a sentence end) of each sentence; a closing bracket at the end of a text closes too."""
    now: list[str] = []
    for t in tokens(text):
        if t in SENTENCE_END:
            if now:
                yield now, True
            now = []
        else:
            now.append(t)
    if now:
        yield now, text.rstrip()[-1:] in ")）]】"


def breaks_off(answer: str) -> bool | tuple[list[str], bool]:
    """Whether an answer breaks off by what stands in it, or its last sentence (and whether it is closed) where the corpus has to tell."""
    text = body(answer)
    known = is_json(text)
    if known is not None:
        return not known
    if unclosed(text):
        return True
    if re.search(r"(?:\.\.+|…|[,，、;；:：\-‐–—(（])$", text):
        return len(tokens(text)) >= 3
    # Marks of a sentence end before a blank are tokens of their own, so the text before the last but one is done with.
    stops = [m.end() for m in re.finditer(r"[.!?。！？](?=\s)", text)]
    last = None
    for last in sentences(text[stops[-2] :] if len(stops) > 1 else text):  # noqa: B007
        pass
    if last is None:
        return False
    sent, done = last
    if done and not (re.search(r"\d\.$", text) and len(sent) > 4 and sent[-1] == "#"):
        return False
    return (sent, done) if done or len(text) >= SHORT else False


def structural(answer: str) -> bool:
    """Breaks off inside a bracket, a quotation or JSON."""
    text = body(answer)
    known = is_json(text)
    return not known if known is not None else unclosed(text)


def abrupt(done: bool, worded: bool, ends: list[int], runs: list[int]) -> bool:
    """Whether a sentence may not end where it does; ``ends``, ``runs``: sightings of its four keys at an end and before one,
    ``worded``: its last token is a word of letters."""
    seen = [(e, e + r) for e, r in zip(ends, runs)]
    if not done and worded and seen[-1][1] < SEEN:
        return True
    complete = next((e >= COMPLETE * n for e, n in seen if n >= SEEN), None)
    if done:
        return complete is False and next((e / n for e, n in seen if n >= 20), 1.0) < 0.02
    return complete is not True


def defects(question: str | None, answer: str | None, instruction: str | None) -> tuple[list[str], tuple[list[str], bool] | None]:
    """The defects of a pair, in the order of the rules, and its last sentence where the corpus has to tell of one more."""
    if is_empty(answer):
        return ["empty_answer"], None
    out, ask = [], None
    prose = is_json(body(answer)) is None
    if prose and refuses(answer):
        out.append("refusal")
    copy = is_copy(question, answer)
    if copy:
        out.append("copies_question")
    ends = structural(answer) if copy else breaks_off(answer)
    if ends is True:
        out.append("truncated")
    elif ends:
        ask = ends
    if prose and wrong_language(question, answer, instruction):
        out.append("wrong_language")
    return out, ask


FOUND = "qa_id string, defect string, done boolean, worded boolean, keys array<bigint>"


def first_look(qa: DataFrame) -> DataFrame:
    """(qa_id, defect, ...): defects that the pair itself shows; rows without a defect ask for an ending by its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positions = Positions()
        for b in batches:
            out, asks = [], []
            for i, q, a, s in zip(*(c.to_pylist() for c in b.columns)):
                found, ask = defects(q, a, s)
                out += [(i, d, None, None, None) for d in found]
                if ask:
                    asks.append((i, *ask))
            k, last = positions.keys([x for _, x, _ in asks])
            for (i, sent, done), row in zip(asks, k[last].view(np.int64).tolist()):
                out.append((i, None, done, sent[-1].isascii() and sent[-1].isalpha(), row))
            cols = list(zip(*out)) or [()] * 5
            types = (pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["qa_id", "defect", "done", "worded", "keys"])

    return spread(qa.where("qa_id is not null").select("qa_id", "question", "answer", "instruction")).mapInArrow(run, FOUND)


def ending_counts(qa: DataFrame, keys: DataFrame, held: int = 1_000_000) -> DataFrame:
    """(key, ends, runs): sightings of the asked ``keys`` over all answers, summed per partition before they are shuffled."""
    sent = qa.sparkSession.sparkContext.broadcast(bloom.build(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positions, bits = Positions(), sent.value
        kept: list[list[np.ndarray]] = [[], []]

        def summed() -> pa.RecordBatch:
            end, go = (np.concatenate([*k, np.zeros(0, np.uint64)]) for k in kept)
            key, at = np.unique(np.concatenate([end, go]), return_inverse=True)
            for k in kept:
                k.clear()
            n = [np.bincount(x, minlength=len(key)) for x in (at[: len(end)], at[len(end) :])]
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n[0]), pa.array(n[1])], names=["key", "ends", "runs"])

        size = 0
        for b in batches:
            texts = b.column(0).to_pylist()
            for i in range(0, len(texts), 256):
                both = [x for t in texts[i : i + 256] if is_json(body(t)) is None for x in sentences(t)]
                k, last = positions.keys([x for x, _ in both])
                go = np.ones(len(k), dtype=bool)
                go[last] = False
                for into, part in zip(kept, (k[last[np.array([d for _, d in both], dtype=bool)]], k[go])):
                    part = part.ravel()
                    into.append(part[bloom.maybe(bits, part)])
                    size += len(into[-1])
                if size > held:
                    yield summed()
                    size = 0
        yield summed()

    rows = spread(qa.select("answer").where("answer is not null")).mapInArrow(run, "key bigint, ends bigint, runs bigint")
    return rows.groupBy("key").agg(F.sum("ends").alias("ends"), F.sum("runs").alias("runs"))


def broken_pairs(qa: DataFrame) -> DataFrame:
    """(qa_id, defect): every defect of every pair."""
    look = cut(first_look(qa))
    asked = look.where("defect is null").select("qa_id", "done", "worded", "keys").distinct()
    each = asked.select("*", F.posexplode("keys").alias("role", "key"))
    counts = ending_counts(qa, asked.select(F.explode("keys").alias("key")).distinct())
    n = lambda c: F.array(*[F.coalesce(F.max(F.when(F.col("role") == i, F.col(c))), F.lit(0)) for i in range(4)])
    told = each.join(counts, "key", "left").groupBy("qa_id", "done", "worded", "keys").agg(n("ends").alias("ends"), n("runs").alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = pa.array([abrupt(*row) for row in zip(*(b.column(c).to_pylist() for c in ("done", "worded", "ends", "runs")))], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("qa_id").filter(keep)], names=["qa_id"])

    late = told.select("qa_id", "done", "worded", "ends", "runs").mapInArrow(run, "qa_id string").withColumn("defect", F.lit("truncated"))
    return look.where("defect is not null").select("qa_id", "defect").unionByName(late).dropDuplicates(["qa_id", "defect"])
