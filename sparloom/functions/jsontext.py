"""JSON inside other text."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

CLOSES = {"}": "{", "]": "["}
FENCE = re.compile(r"(?is)```(?:json)?\s*(.*?)```")
TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]]', re.S)


def balanced(text: str) -> list[str]:
    """The outermost balanced objects and arrays of a text; brackets in quotes don't count, a wrong one starts anew."""
    out, open_, start = [], [], 0
    for m in TOKEN.finditer(text):
        c = m[0]
        if c in "{[":
            if not open_:
                start = m.start()
            open_.append(c)
        elif c in CLOSES and open_:
            if open_.pop() != CLOSES[c]:
                open_ = []
            elif not open_:
                out.append(text[start : m.end()])
    return out


def found(text: str | None, prefer: str | None = None) -> str | None:
    """The first readable JSON object or array: of the whole text, its code fences, its balanced parts; those that start
    with ``prefer`` before others."""
    if not text or not re.search(r"[{\[]", text):
        return None
    parts = [x.strip() for x in [text, *FENCE.findall(text), *balanced(text)]]
    for p in sorted(dict.fromkeys(parts), key=lambda x: prefer is not None and not x.startswith(prefer)):
        if p[:1] in "{[" and p:
            try:
                return json.dumps(json.loads(p), ensure_ascii=False)
            except (ValueError, RecursionError):
                continue
    return None


@F.pandas_udf(StringType())
def first_json(text: pd.Series) -> pd.Series:
    return pd.Series([found(t) for t in text], dtype="object")
