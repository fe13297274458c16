"""Text cleaning as Column functions: everything runs in whole-stage code, no Python.

Null texts stay null. Patterns use Unicode classes, as the rules were made for.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of symbols taken for recognition garbage, alternatives in order.
GARBLED = (
    r"(?U)[#$%^&*]{3,}|[@#$%^&*]{4,}|[^\w\s一-鿿　-〿＀-￯.,;:!?'\"()\[\]{}\-–—…·]{5,}"
    r"|([#$%&*^@!~])\1{3,}|[|\\/]{4,}|[#@$%^&*()]{6,}"
)
#: Sequences wrong decoding leaves behind.
MOJIBAKE = ["锟斤拷", "烫烫烫", "屯屯屯", "�", "\u0000"]
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


def garbled(c: Column) -> Column:
    """Runs of symbols out, then blanks collapsed and three or more line ends made two; texts without any stay as they are."""
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, GARBLED, ""), " {2,}", " "), "\n{3,}", "\n\n")
    return F.when(c.rlike(GARBLED), F.regexp_replace(out, r"(?U)^\s+|\s+$", "")).otherwise(c)


def decoding(c: Column) -> Column:
    """Leftovers of wrong decoding and control characters out."""
    for wrong in MOJIBAKE[:-1]:
        c = F.replace(c, F.lit(wrong))
    return F.regexp_replace(c, CONTROL, "")


def spacing(c: Column) -> Column:
    """Tabs to four blanks, blank runs inside lines to one, three or more line ends to two, lines and whole trimmed; in that order."""
    c = F.replace(c, F.lit("\t"), F.lit("    "))
    c = F.regexp_replace(F.regexp_replace(c, "(?<!\n) {2,}", " "), "\n{3,}", "\n\n")
    lines = F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.regexp_replace(F.array_join(lines, "\n"), r"(?U)^\s+|\s+$", "")


def table_rows(c: Column) -> Column:
    """Rows of piped tables mended; each later rule starts from the original line again, and the last that fires wins."""
    has = c.rlike(r"\|.*\|") | c.rlike(r"[-+]{3,}")

    def one(line):
        t = F.trim(line)
        closed = F.when(t.startswith("|") & ~t.endswith("|"), F.concat(F.rtrim(line), F.lit(" |"))).otherwise(line)
        thin = F.when(line.rlike(r"\|{3,}"), F.regexp_replace(line, r"\|{3,}", "||")).otherwise(closed)
        middle = F.nullif(F.trim(F.regexp_extract(line, r"^\s*\|([\s\-:]+)\|\s*$", 1)), F.lit(""))
        return F.when(line.rlike(r"^\s*\|[\s\-:]+\|\s*$"), F.concat(F.lit("|"), F.coalesce(middle, F.lit("---")), F.lit("|"))).otherwise(thin)

    return F.when(has, F.array_join(F.transform(F.split(c, "\n"), one), "\n")).otherwise(c)


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, not once per use inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeats(c: Column) -> Column:
    """A line equal to the one before it out; then paragraphs with the first 100 characters of an earlier one out.

    Where nothing repeats the text stays as it is; else paragraphs are joined by one blank line.
    """

    def lines_kept(lines):
        before = F.concat(F.array(F.lit(None).cast("string")), lines)
        pairs = F.filter(F.arrays_zip(lines.alias("x"), before.alias("p")), lambda s: s["x"].isNotNull() & ((F.trim(s["x"]) == "") | s["p"].isNull() | (F.trim(s["x"]) != F.trim(s["p"]))))
        return F.transform(pairs, lambda s: s["x"])

    def first_paragraphs(paras):
        heads = F.transform(paras, lambda p: F.substring(F.trim(p), 1, 100))
        return bound(F.struct(paras.alias("p"), heads.alias("h")), lambda z: F.transform(
            F.filter(F.arrays_zip(z["p"].alias("p"), z["h"].alias("h"), F.sequence(F.lit(1), F.size(z["p"])).alias("i")), lambda s: (s["h"] == "") | (F.array_position(z["h"], s["h"]) == s["i"])), lambda s: s["p"]
        ))

    def whole(lines):
        def inner(kept):
            return bound(F.split(F.array_join(kept, "\n"), r"\n\s*\n"), lambda paras: bound(first_paragraphs(paras), lambda first: F.when((F.size(kept) < F.size(lines)) | (F.size(first) < F.size(paras)), F.array_join(first, "\n\n"))))

        return bound(lines_kept(lines), inner)

    return F.coalesce(bound(F.split(c, "\n"), whole), c)


#: The cascade, in its fixed order: rule name and function.
CASCADE = [("garbled", garbled), ("decoding", decoding), ("spacing", spacing), ("table_rows", table_rows), ("repeats", repeats)]


def tokens(c: Column) -> Column:
    """Estimated tokens: a third of the characters, rounded down."""
    return F.floor(F.char_length(F.coalesce(c, F.lit(""))) / 3).cast("bigint")


def shortened(c: Column, n: int) -> Column:
    """Blanks collapsed, cut to n characters with an ellipsis."""
    t = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.when(F.char_length(t) > n, F.concat(F.rtrim(F.substring(t, 1, n)), F.lit("..."))).otherwise(t)


def identifier(c: Column) -> Column:
    """Upper case without outer blanks."""
    return F.upper(F.trim(c))


def squashed(c: Column) -> Column:
    """Upper case letters and digits only."""
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]+", "")


def snake(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def model_noise(c: Column) -> Column:
    """Thinking tags, chat markers and code fences out."""
    c = F.regexp_replace(c, r"(?is)<think>.*?</think>", "")
    c = F.regexp_replace(c, r"<\|[a-z_]+\|>", "")
    return F.trim(F.regexp_replace(c, r"```[a-zA-Z]*\n?", ""))
