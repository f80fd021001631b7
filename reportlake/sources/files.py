"""Files of a folder as report texts: text, Word, Excel, sheets; what cannot be read as a row that says why."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files above are not opened but named in ``problem``.
MAX_BYTES = 25 << 20
# Endings and how they are read.
KINDS = {"docx": "word", "xlsx": "excel", "csv": "sheet", "png": "image", "jpg": "image", "jpeg": "image", "tif": "image", "tiff": "image", "bmp": "image", "webp": "image", "pdf": "pdf"}
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def plain_text(data: bytes) -> str:
    """UTF-8 with or without mark, else Windows-1252, else Latin-1."""
    for encoding in ("utf-8-sig", "cp1252"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def word_text(data: bytes) -> str:
    """Paragraphs of a Word file, then the cells of its tables row by row; blank ones left out."""
    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    text = lambda p: "".join("\t" if t.tag == f"{_W}tab" else "\n" if t.tag == f"{_W}br" else t.text or "" for t in p.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))
    lines = [text(p) for p in body if p.tag == f"{_W}p"]
    for table in body.iter(f"{_W}tbl"):
        for row in table.iter(f"{_W}tr"):
            cells = ["\n".join(text(p) for p in cell.iter(f"{_W}p")).strip() for cell in row.iter(f"{_W}tc")]
            lines += [c for c in cells if c]
    return "\n".join(line for line in lines if line.strip())


def excel_rows(data: bytes) -> list[list[str]]:
    """Cells of a workbook's active sheet as text."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = set(z.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
    book = ET.fromstring(z.read("xl/workbook.xml"))
    view = next(book.iter(f"{_S}workbookView"), None)
    active = int(view.get("activeTab", "0")) if view is not None else 0
    sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    out = []
    for row in ET.fromstring(z.read(sheets[min(active, len(sheets) - 1)])).iter(f"{_S}row"):
        cells: dict[int, str] = {}
        for k, c in enumerate(row.iter(f"{_S}c")):
            letters = re.match(r"[A-Z]+", c.get("r", ""))
            at = k if not letters else sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters.group()))) - 1
            value = c.find(f"{_S}v")
            if c.get("t") == "s" and value is not None:
                cells[at] = shared[int(value.text)]
            else:
                cells[at] = "".join(t.text or "" for t in c.iter(f"{_S}t")) if c.get("t") == "inlineStr" else (value.text or "" if value is not None else "")
        out.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
    return out


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """``path, kind, text, rows, problem`` of every file: text of documents, rows of
    workbooks.  Images need recognition, PDF and broken or too large files a tool or a
    look: they come out with ``problem`` set, none is dropped."""
    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= MAX_BYTES).select("path", "content")
    large = files.where(F.col("length") > MAX_BYTES).select("path", F.lit(None).cast("binary").alias("content"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, c in zip(b["path"], b["content"], strict=True):
                kind, text, rows, problem = KINDS.get(p.rsplit(".", 1)[-1].lower(), "text"), None, None, None
                try:
                    if c is None:
                        problem = "larger than 25 MiB"
                    elif kind in ("image", "pdf"):
                        problem = "needs recognition"
                    elif kind == "word":
                        text = word_text(bytes(c))
                    elif kind == "excel":
                        rows = excel_rows(bytes(c))
                    else:
                        text = plain_text(bytes(c))
                except (zipfile.BadZipFile, KeyError, ET.ParseError, IndexError, ValueError) as e:
                    problem = f"cannot be read: {type(e).__name__}"
                out.append((p, kind, text, rows, problem))
            yield pd.DataFrame(out, columns=["path", "kind", "text", "rows", "problem"])

    return small.unionByName(large).mapInPandas(read, "path string, kind string, text string, rows array<array<string>>, problem string")


def sheet_items(files: DataFrame) -> DataFrame:
    """``path, row_no, patient, patient_id, age_sex, study, text`` of the workbooks among
    ``read_any``'s rows: columns by the known header spellings, rows without text left out."""
    from reportlake.sources.intake import ALIASES

    canon = lambda c: F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9/]", "_"), "^_+|_+$", "")
    rows = files.where("kind = 'excel' and size(rows) > 1").select("path", F.transform(F.get("rows", F.lit(0)), canon).alias("head"), F.posexplode("rows").alias("row_no", "cells")).where("row_no > 0")
    at = lambda names: F.get(F.filter(F.transform(F.array(*map(F.lit, names)), lambda n: F.array_position("head", n)), lambda i: i > 0), F.lit(0))
    cell = lambda names: F.coalesce(F.trim(F.get("cells", (at(names) - 1).cast("int"))), F.lit(""))
    return rows.select("path", "row_no", *(cell(names).alias(k) for k, names in ALIASES.items())).where("text <> ''")
