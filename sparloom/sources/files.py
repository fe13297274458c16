"""Files as blocks: text, HTML, DOCX, XLSX, XML definitions, JSON envelopes. Binary files are read by Spark's binaryFile
source and parsed in Python workers, file by file; nothing passes through the driver.

Defined results: a file that can't be read gives one row of type ``unreadable`` with the reason, never an error;
empty files give no blocks. PDF needs a parser that is not part of this environment and comes out as unreadable.
"""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Accepted file types and the ones read as text; limits of the upload gate.
ACCEPTED = ("pdf", "docx", "doc", "xlsx", "xls", "txt", "md", "csv", "json", "xml", "html", "htm", "yaml", "yml")
TEXT_TYPES = ("txt", "md", "csv", "json", "xml", "html", "htm", "yaml", "yml")
MAX_BYTES, MIN_CHARS = 50 * 1024 * 1024, 20

BLOCKS = "path string, page int, position int, block_type string, content string"
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def extension(c):
    return F.lower(F.regexp_extract(c, r"\.([A-Za-z0-9]+)$", 1))


def docx_blocks(data: bytes) -> Iterator[tuple[str, str]]:
    """Paragraphs and tables of a document in body order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{W}t")).strip()
    for e in body if body is not None else []:
        if e.tag == f"{W}p" and text(e):
            yield "text", text(e)
        elif e.tag == f"{W}tbl":
            rows = [" | ".join(text(c) for c in r.findall(f"{W}tc")) for r in e.findall(f"{W}tr")]
            if any(r.strip(" |") for r in rows):
                yield "table", "\n".join(rows)


def xlsx_blocks(data: bytes) -> Iterator[tuple[str, str]]:
    """One block per sheet: a sheet of one column is text, others are tables."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        for name in sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1])):
            rows = []
            for r in ElementTree.fromstring(z.read(name)).iter(f"{S}row"):
                cells = {}
                for c in r.findall(f"{S}c"):
                    v = c.find(f"{S}v")
                    inline = "".join(t.text or "" for t in c.iter(f"{S}t"))
                    value = shared[int(v.text)] if c.get("t") == "s" and v is not None else inline or (v.text if v is not None else "")
                    col = 0
                    for ch in re.sub(r"\d", "", c.get("r", "A")):
                        col = col * 26 + ord(ch) - 64
                    cells[col or len(cells) + 1] = (value or "").strip()
                if any(cells.values()):
                    rows.append([cells.get(i, "") for i in range(1, max(cells) + 1)])
            if rows:
                width = max(map(len, rows))
                yield ("text" if width == 1 else "table"), "\n".join(" | ".join(r + [""] * (width - len(r))) for r in rows)


def html_text(text: str) -> str:
    """Markup out, entities resolved, block ends as line ends."""
    text = re.sub(r"(?is)<(script|style)\b.*?</\1>", "", text)
    text = re.sub(r"(?i)<(?:br|/p|/div|/tr|/li|/h[1-6])\b[^>]*>", "\n", text)
    return re.sub(r"\n{3,}", "\n\n", html.unescape(re.sub(r"<[^>]+>", "", text))).strip()


def parse_file(path: str, data: bytes) -> list[tuple]:
    """Blocks of one file."""
    ext = path.rsplit(".", 1)[-1].lower()
    try:
        if len(data) > MAX_BYTES:
            raise ValueError("too large")
        if ext == "docx":
            found = list(docx_blocks(data))
        elif ext == "xlsx":
            found = list(xlsx_blocks(data))
        elif ext in ("html", "htm"):
            found = [("text", html_text(data.decode("utf-8", "ignore")))]
        elif ext in TEXT_TYPES:
            found = [("text", data.decode("utf-8", "ignore"))]
        else:
            raise ValueError(f"no reader for {ext}")
    except Exception as e:  # noqa: BLE001
        return [(path, 0, 0, "unreadable", f"{type(e).__name__}: {e}"[:200])]
    return [(path, i + 1, i, kind, text) for i, (kind, text) in enumerate(found) if text.strip()]


def read_documents(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Blocks of all files of a folder: (path, page, position, block_type, content)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, c in zip(pdf.path, pdf.content):
                yield pd.DataFrame(parse_file(p, bytes(c)), columns=["path", "page", "position", "block_type", "content"])

    return files.select("path", "content").mapInPandas(run, BLOCKS)


def looks_like_text(content):
    """No NUL byte, not blank, and at least 85 % of the first 4096 bytes printable; broken UTF-8 counts as not printable."""
    head = F.make_valid_utf8(F.substring(content, 1, 4096).cast("string"))
    kept = F.char_length(F.regexp_replace(head, r"[\p{Cc}\p{Cs}\p{Co}\p{Cn}\x{FFFD}&&[^\t\n\r]]", ""))
    return ~F.contains(F.substring(content, 1, 4096), F.unhex(F.lit("00"))) & (F.trim(F.regexp_replace(head, r"\s", "")) != "") & (kept >= 0.85 * F.char_length(head))


def gate(files: DataFrame) -> DataFrame:
    """Five checks per file (path, length, content): extension, size, authenticity, readability, completeness; valid when
    all hold. Bytes that are no UTF-8 are skipped, never an error."""
    ext = extension(F.col("path"))
    starts = lambda h: F.startswith(F.col("content"), F.unhex(F.lit(h)))
    member = lambda name: F.contains(F.col("content"), F.lit(name).cast("binary"))
    real = (
        F.when(ext == "pdf", F.startswith(F.col("content"), F.lit("%PDF").cast("binary")))
        .when(ext == "docx", starts("504B0304") & member("word/document.xml"))
        .when(ext == "xlsx", starts("504B0304") & member("xl/workbook.xml"))
        .when(ext.isin("doc", "xls"), starts("D0CF11E0"))
        .when(ext.isin(*TEXT_TYPES), looks_like_text(F.col("content")))
        .otherwise(F.lit(False))
    )
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), r"[\s\x{FFFD}]", "")
    readable = F.when(ext.isin(*TEXT_TYPES), F.char_length(text) >= MIN_CHARS).otherwise(real)
    checks = {"extension": ext.isin(*ACCEPTED), "size": F.col("length") <= MAX_BYTES, "authenticity": real, "readability": readable, "completeness": F.col("length") > 0}
    issues = F.array_sort(F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()]), lambda x: x.isNotNull()))
    return files.select("path", *[F.coalesce(c, F.lit(False)).alias(k) for k, c in checks.items()], F.array_join(issues, ",").alias("issues")).withColumn("valid", F.col("issues") == "")


def file_gate(spark: SparkSession, folder: str) -> DataFrame:
    """The gate over all files of a folder."""
    return gate(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder))


# ---- message definitions in XML ---------------------------------------------------------------------------------

FIELDS = "path string, field_path string, name string, tag string, bit_length int, default_value string, level int, ordinal int, bit_offset int"


def definition_fields(path: str, text: str) -> list[tuple]:
    """Leaves of a definition in order with cumulative bit offsets; groups repeat their leaves ``count`` times."""
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError:
        return []
    out: list[tuple] = []
    offset = 0

    def walk(e, prefix, level):
        nonlocal offset
        name = e.get("name") or ""
        here = f"{prefix}/{name or e.tag}" if prefix else (name or e.tag)
        children = list(e)
        if not children and e.tag not in ("NameSpace", "Group"):
            raw = (e.get("bit_length") or e.get("bitLength") or (e.text or "")).strip()
            bits = int(raw) if raw.isdigit() else 0
            out.append((path, here, name, e.tag, bits, e.get("defaultValue"), level, len(out), offset))
            offset += bits
            return
        times = int(e.get("count", "1")) if e.get("count", "1").isdigit() else 1
        for i in range(times):
            for c in children:
                walk(c, f"{here}[{i}]" if times > 1 else here, level + 1)

    walk(root, "", 0)
    return out


def read_definitions(spark: SparkSession, folder: str) -> DataFrame:
    """All message definitions of a folder as a flat table of fields."""
    files = spark.read.text(f"{folder}/*.xml", wholetext=True).select(F.input_file_name().alias("path"), "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.split()[0] for c in FIELDS.split(", ")]
        for pdf in batches:
            for p, v in zip(pdf.path, pdf.value):
                yield pd.DataFrame(definition_fields(p, v), columns=cols)

    return files.mapInPandas(run, FIELDS)


def read_envelope(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Rows of a JSON envelope ``{name: [...], total_name: n}``, or of a JSON-lines file."""
    df = spark.read.option("multiLine", "true").json(path)
    return df.select(F.explode(name).alias("r")).select("r.*") if name in df.columns else spark.read.json(path)


def read_training(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A training set in JSON lines; columns that are missing raise, rows with a null required value are dropped."""
    df = spark.read.json(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df.dropna(subset=required)
