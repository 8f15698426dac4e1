"""Readers of files that a corpus is built from: JSON lines, index files, text and DOCX."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines under a schema; blank and broken lines are left out, unknown fields dropped, missing ones null."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_index(spark: SparkSession, path: str, documents: str, chunks: str) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks of a JSON index file {documents: [...], chunks: [...]}, each under a DDL schema."""
    df = spark.read.schema(f"documents array<struct<{documents}>>, chunks array<struct<{chunks}>>").option("multiLine", True).json(path)
    return df.select(F.inline("documents")), df.select(F.inline("chunks"))


def document_id(path, identity) -> F.Column:
    """The first 16 hex digits of sha1(name:identity)."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    return F.substring(F.sha1(F.concat_ws(":", name, identity)), 1, 16)


def read_folder(spark: SparkSession, path: str, pattern: str = "*.{txt,md,docx}") -> DataFrame:
    """(path, name, doc_id, content) of the files under a folder; doc_id is the content's."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return df.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), document_id(F.col("path"), F.sha2("content", 256)).alias("doc_id"), "content")


def plain_text(raw: bytes) -> str:
    """UTF-8, or else Latin-1; without a leading source line, wiki markup, lines of punctuation and runs of blank lines."""
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        text = raw.decode("latin-1")
    lines = text.splitlines()
    if lines and lines[0].startswith("Source:"):
        lines = lines[1:]
    out: list[str] = []
    for line in lines:
        line = re.sub(r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]|'{2,}|<[^>]{1,80}>", lambda m: m[1] or "", line).rstrip()
        if line and not re.search(r"\w", line):
            continue
        if line or (out and out[-1]):
            out.append(line)
    return "\n".join(out).strip()


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(raw: bytes) -> str:
    """Paragraphs of a DOCX file as Markdown: headings by style, tabs and breaks kept, tables as rows of pipes."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")).find(f"{_W}body")

    def paragraph(p) -> str:
        parts = {f"{_W}t": lambda e: e.text or "", f"{_W}tab": lambda e: "\t", f"{_W}br": lambda e: "\n"}
        text = "".join(parts[e.tag](e) for e in p.iter() if e.tag in parts)
        style = p.find(f"{_W}pPr/{_W}pStyle")
        level = re.fullmatch(r"Heading ?(\d)", style.get(f"{_W}val", "")) if style is not None else None
        return f"{'#' * int(level[1])} {text}" if level and text.strip() else text

    out = []
    for e in body if body is not None else []:
        if e.tag == f"{_W}p":
            out.append(paragraph(e))
        elif e.tag == f"{_W}tbl":
            rows = [["\n".join(map(paragraph, c.iter(f"{_W}p"))).replace("\n", " ") for c in r.iter(f"{_W}tc")] for r in e.iter(f"{_W}tr")]
            out.append("\n".join("| " + " | ".join(r) + " |" for r in rows))
    return "\n\n".join(x for x in out if x.strip())


def extract(files: DataFrame) -> DataFrame:
    """(doc_id, name, text, error) of read_folder(); a file that can't be read has a null text and its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, n, raw in zip(pdf["doc_id"], pdf["name"], pdf["content"], strict=True):
                try:
                    rows.append((d, n, docx_text(bytes(raw)) if n.lower().endswith(".docx") else plain_text(bytes(raw)), None))
                except Exception as e:
                    rows.append((d, n, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc_id", "name", "text", "error"])

    return files.select("doc_id", "name", "content").mapInPandas(run, "doc_id string, name string, text string, error string")
