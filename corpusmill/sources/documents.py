"""Uploads and binary documents: kind checks, DOCX text with the standard library, PDF text through a provider."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from corpusmill.functions.text import PAGE_BREAK, TABLE_CLOSE, TABLE_OPEN, is_pdf, marked_pages, py_strip
from corpusmill.operators.chat import upload_status

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def is_docx_bytes(content: bytes | None) -> bool:
    """Whether bytes are a zip archive with a content types part."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            return "[Content_Types].xml" in z.namelist()
    except (zipfile.BadZipFile, OSError):
        return False


@F.pandas_udf(BooleanType())
def is_docx(content: pd.Series) -> pd.Series:
    return content.map(is_docx_bytes)


def _words(node) -> str:
    return "".join(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" if t.tag == f"{_W}br" else "" for t in node.iter())


def _markdown(rows: list[list[str]]) -> str:
    wide = max(map(len, rows), default=0)
    lines = ["| " + " | ".join([*r, *[""] * (wide - len(r))]) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * wide) + " |", *lines[1:]]) if rows and wide else ""


def docx_text(content: bytes) -> str:
    """Paragraphs and tables in body order; tables as Markdown in their marks, bars and line ends in cells made blanks."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    parts = []
    for node in body if body is not None else ():
        if node.tag == f"{_W}p" and (said := _words(node).strip()):
            parts.append(said)
        elif node.tag == f"{_W}tbl":
            rows = [[" ".join("\n".join(_words(p) for p in c.iter(f"{_W}p")).translate({9: 32, 10: 32, 124: 32}).split(" ")).strip() for c in r.findall(f"{_W}tc")] for r in node.findall(f"{_W}tr")]
            if table := _markdown(rows):
                parts.append(f"{TABLE_OPEN}\n{table}\n{TABLE_CLOSE}")
    return "\n".join(parts)


def checked_uploads(files: DataFrame, name_col: str = "file_name", content_col: str = "content") -> DataFrame:
    """Files with status (200 or why not) and content_hash."""
    c = F.col(content_col)
    status = upload_status(F.col(name_col), F.octet_length(c), is_pdf(c), is_docx(c))
    return files.withColumn("status", status).withColumn("content_hash", F.sha2(c, 256))


# How statuses of the conversion log begin.
CONVERTED, EMPTY, FAILED = "УСПЕХ", "ВНИМАНИЕ", "ОШИБКА"


def converted(files: DataFrame, pdf_pages: Callable[[bytes], list[str]], name_col: str = "file_name", content_col: str = "content") -> DataFrame:
    """file_name, text_name, text, pages and status of each PDF: marked page texts without blank pages, and the log's line.

    ``pdf_pages`` gives a PDF's page texts. A file without text, or that can't be read, has a null
    text and fails no other.
    """

    def run(batches):
        for pdf in batches:
            pages, errors = [], []
            for content in pdf["content"]:
                try:
                    pages.append(list(pdf_pages(content or b"")))
                    errors.append(None)
                except Exception as e:  # any decoder's
                    pages.append(None)
                    errors.append(f"{type(e).__name__} {e}")
            yield pd.DataFrame({"file_name": pdf["file_name"], "found": pages, "error": errors})

    two = files.select(F.col(name_col).alias("file_name"), F.col(content_col).alias("content"))
    read = two.mapInPandas(run, "file_name string, found array<string>, error string")
    kept = F.filter("found", lambda p: py_strip(p) != "")
    name = F.concat(F.regexp_replace("file_name", r"(?<=.)\.[^.]*$", ""), F.lit(".txt"))
    status = (
        F.when(F.col("error").isNotNull(), F.concat(F.lit(f"{FAILED}: "), F.col("file_name"), F.lit(" - "), F.col("error")))
        .when(F.size(kept) == 0, F.concat(F.lit(f"{EMPTY}: "), F.col("file_name")))
        .otherwise(F.concat(F.lit(f"{CONVERTED}: "), F.col("file_name"), F.lit(" -> "), name, F.lit(" ("), F.size(kept).cast("string"), F.lit(")")))
    )
    return read.select("file_name", name.alias("text_name"), F.when(F.size(kept) > 0, marked_pages(F.col("found"))).alias("text"), F.greatest(F.size(kept), F.lit(0)).alias("pages"), status.alias("status"))


def extracted(files: DataFrame, pdf_pages: Callable[[bytes], list[str]] | None = None, name_col: str = "file_name", content_col: str = "content") -> DataFrame:
    """file_name, text, status of each file: ``OK``, ``WARN`` for no text, ``ERROR`` with the reason. One bad file fails no other.

    ``pdf_pages`` gives a PDF's page texts; without it PDFs are errors.
    """

    def one(name: str | None, content: bytes | None) -> tuple[str | None, str]:
        try:
            if (name or "").lower().endswith(".docx"):
                said = docx_text(content or b"")
            elif pdf_pages is None:
                return None, "ERROR no PDF reader"
            else:
                said = f"\n{PAGE_BREAK}\n".join(pdf_pages(content or b""))
        except Exception as e:  # any decoder's
            return None, f"ERROR {type(e).__name__}"
        return said, "OK" if said.strip() else "WARN no text"

    def run(batches):
        for pdf in batches:
            found = [one(n, c) for n, c in zip(pdf["file_name"], pdf["content"])]
            yield pd.DataFrame({"file_name": pdf["file_name"], "text": [t for t, _ in found], "status": [s for _, s in found]})

    two = files.select(F.col(name_col).alias("file_name"), F.col(content_col).alias("content"))
    return two.mapInPandas(run, "file_name string, text string, status string")
