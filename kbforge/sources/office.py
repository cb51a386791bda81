"""Text of DOCX, XLSX and PDF bodies: binaryFile rows in, (title, content) out. A body that can't be read gives nulls."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbforge.sources import pdf

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Sheets of a workbook and rows of a sheet that are read.
SHEETS, ROWS = 10, 500


def docx_text(body: bytes) -> str:
    """Paragraphs that aren't blank, then table rows with their cells side by side."""
    with zipfile.ZipFile(io.BytesIO(body)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    text = lambda e: "".join(t.text or "" for t in e.iter(_W + "t")).strip()
    main = root.find(_W + "body")
    out = [t for p in main.findall(_W + "p") if (t := text(p))]
    for row in (r for table in main.findall(_W + "tbl") for r in table.findall(_W + "tr")):
        cells = [t for c in row.findall(_W + "tc") if (t := text(c))]
        if cells:
            out.append(" | ".join(cells))
    return "\n".join(out)


def xlsx_text(body: bytes) -> str:
    """Of the first sheets, their name and the first rows."""
    with zipfile.ZipFile(io.BytesIO(body)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in e.iter(_S + "t")) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(_S + "si")]
        targets = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in list(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(_S + "sheet"))[:SHEETS]:
            target = targets[sheet.get(_R)].lstrip("/")
            root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else "xl/" + target))
            out.append(f"[工作表] {sheet.get('name')}")
            for row in list(root.iter(_S + "row"))[:ROWS]:
                cells = [v for c in row.findall(_S + "c") if (v := _cell(c, shared))]
                if cells:
                    out.append(" | ".join(cells))
    return "\n".join(out)


def _cell(c: ElementTree.Element, shared: list[str]) -> str:
    if c.get("t") == "inlineStr":
        return "".join(t.text or "" for t in c.iter(_S + "t")).strip()
    v = c.find(_S + "v")
    if v is None or v.text is None:
        return ""
    return (shared[int(v.text)] if c.get("t") == "s" else v.text).strip()


def pdf_text(body: bytes) -> str:
    """Pages that aren't blank, each under its number."""
    return "\n\n".join(f"第 {i} 页\n{t}" for i, t in enumerate(pdf.pages(bytes(body)), 1) if t)


READERS = {"docx": (docx_text, "DOCX"), "xlsx": (xlsx_text, "XLSX"), "pdf": (pdf_text, "PDF")}


@F.pandas_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("content", T.StringType())]))
def office_extract(kind: pd.Series, url: pd.Series, body: pd.Series) -> pd.DataFrame:
    rows = []
    for k, u, b in zip(kind, url, body):
        try:
            read, name = READERS[k]
            rows.append((re.split("/", u or "")[-1] or name, read(b)))
        except Exception:  # any damage makes the body unreadable; the caller logs <kind>_parse_failed
            rows.append((None, None))
    return pd.DataFrame(rows, columns=["title", "content"])
