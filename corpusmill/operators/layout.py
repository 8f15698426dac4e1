"""From the visual lines of a printed rule book to its blocks, and from its contents pages to entries.

What a line is shows in columns of its own: its kind by type, its depth by indent, its labels by pattern. Only how lines
hang together depends on what came before; that is carried along the lines of a document, which are streamed in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Indents of the levels in points and how far off they may be set, gaps between lines, sizes of type.
RUNGS = ((72.0, 0), (93.6, 1), (108.0, 1), (115.2, 2), (136.8, 3), (158.4, 4), (180.0, 5), (201.6, 6), (223.2, 7))
OFF, EDGE = 4.0, 1.5
PARAGRAPH_GAP, HEADING_GAP = 17.0, 18.5
CHAPTER_SIZE, SUBCHAPTER_SIZE = 17.0, 13.0

RULE = r"^Rule\s+\d+\.\d+[A-Z]?\b"
SUBCHAPTER = r"^Subchapter\s+\d+\.\d+"
LABEL = r"\((?:[A-Z]{1,2}|[a-z]{1,2}|\d{1,2}|[ivxl]{1,6})\)"


def kind_of_line(bold: Column, size: Column, x: Column, text: Column) -> Column:
    """chapter, subchapter, front_matter (set like a subchapter, without its number), rule, more_title or body, by type."""
    small = F.when(text.rlike(RULE), "rule").when(F.abs(x - RUNGS[0][0]) <= EDGE, "more_title").otherwise("body")
    middle = F.when(text.rlike(SUBCHAPTER), "subchapter").otherwise("front_matter")
    return F.when(~F.coalesce(bold, F.lit(False)), "body").when(size >= CHAPTER_SIZE, "chapter").when(size >= SUBCHAPTER_SIZE, middle).otherwise(small)


def depth_of_indent(x: Column) -> Column:
    """The level of the nearest rung, or null for what is set on none."""
    rungs = F.array(*[F.struct(F.round(F.abs(x - at), 6).alias("off"), F.lit(d).alias("depth")) for at, d in RUNGS])
    near = F.array_min(rungs)
    return F.when(near["off"] <= OFF, near["depth"])


def labels(text: Column) -> Column:
    """The labels a line begins with, three at most, without brackets: '(1)(a) The' has 1 and a."""
    run = F.regexp_extract(text, rf"^((?:{LABEL}){{1,3}})", 1)
    return F.regexp_extract_all(run, F.lit(r"\(([^)]*)\)"), F.lit(1))


def spaced_labels(text: Column) -> Column:
    """A text with a blank after the labels it begins with."""
    return F.regexp_replace(text, rf"^((?:{LABEL}){{1,3}})(?=[^\s(])", "$1 ")


@dataclass
class Open:
    """The block that lines still may be added to."""

    kind: str
    page: int
    page_end: int
    y: float
    depth: int | None
    marker: str | None
    first_depth: int | None
    parts: list[str] = field(default_factory=list)

    def text(self) -> str:
        out = ""
        for p in self.parts:
            out += p if not out or out.endswith("-") else f" {p}"
        return out


def _goes_on(block: Open | None, kind: str, page: int, y: float, depth: int | None, marked: bool) -> bool:
    """Whether a line belongs to the block before it."""
    if block is None:
        return False
    gap = y - block.y if page == block.page_end else None
    if kind == "more_title":
        return block.kind == "rule" and gap is not None and gap <= HEADING_GAP
    if kind == "front_matter":
        return block.kind == "subchapter" and gap is not None and gap <= HEADING_GAP
    if kind != "body" or block.kind != "body":
        return False
    if gap is None:  # over a page's end: unless it is an item or further out
        return not marked and (99 if depth is None else depth) >= (99 if block.first_depth is None else block.first_depth)
    return gap < PARAGRAPH_GAP


def blocks_from_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, block, kind, text, page, page_end, depth, marker) of lines (doc_id, page, line, y, x, size, bold, text).

    Lines without text or place are left out. Wrapped titles are joined to their heading; a label only begins a block
    where the gap before it says so; a paragraph goes on over a page's end unless the next line is an item or stands
    further out. Of several labels the last is the marker and each one before it a level.
    """
    t = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    rows = lines.where("doc_id IS NOT NULL AND page IS NOT NULL AND y IS NOT NULL AND x IS NOT NULL").select("doc_id", "page", "line", "y", kind_of_line(F.col("bold"), F.col("size"), F.col("x"), t).alias("kind"), depth_of_indent(F.col("x")).alias("depth"), labels(t).alias("labels"), spaced_labels(t).alias("spaced"), t.alias("text")).where("text <> ''")
    schema = "doc_id string, block int, kind string, text string, page int, page_end int, depth int, marker string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, block, n, out = None, None, 0, []

        def close() -> None:
            if block is not None:
                out.append((doc, n, block.kind, block.text(), block.page, block.page_end, block.depth, block.marker))

        for pdf in batches:
            for d, page, y, kind, depth, found, spaced, text in pdf[["doc_id", "page", "y", "kind", "depth", "labels", "spaced", "text"]].itertuples(index=False):
                depth = None if pd.isna(depth) else int(depth)
                found = list(found) if kind in ("body", "more_title") and depth else []
                if d != doc:
                    close()
                    doc, block, n = d, None, 0
                if _goes_on(block, kind, page, y, depth, bool(found)):
                    block.parts.append(text)
                    block.y, block.page_end = y, page
                    continue
                close()
                n += block is not None
                level = depth if depth is None else depth + max(0, len(found) - 1)
                block = Open("body" if kind == "more_title" else kind, page, page, y, level, found[-1] if found else None, depth, [spaced if found else text])
            yield pd.DataFrame(out, columns=["doc_id", "block", "kind", "text", "page", "page_end", "depth", "marker"])
            out = []
        close()
        yield pd.DataFrame(out, columns=["doc_id", "block", "kind", "text", "page", "page_end", "depth", "marker"])

    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "page", "line").mapInPandas(run, schema)


def guards(blocks: DataFrame) -> DataFrame:
    """blocks with opens_list and verbatim: unmarked blocks that stay where they are.

    One whose next block is marked and deeper opens a list; a run of unmarked ones of which any is on no rung is verbatim.
    """
    from pyspark.sql.window import Window as W

    w = W.partitionBy("doc_id").orderBy("block")
    plain = (F.col("kind") == "body") & F.col("marker").isNull()
    nxt = F.lead(F.struct("kind", "marker", "depth")).over(w)
    rows = blocks.withColumn("opens_list", F.coalesce(plain & (nxt["kind"] == "body") & nxt["marker"].isNotNull() & (nxt["depth"] > F.col("depth")), F.lit(False)))
    rows = rows.withColumn("island", F.sum(F.when(plain, 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    off = F.bool_or(plain & F.col("depth").isNull()).over(W.partitionBy("doc_id", "island"))
    return rows.withColumn("verbatim", plain & off).drop("island")


ENTRY = re.compile(r"(?P<kind>Chapter|Subchapter|Rule)\s+(?P<num>[\d.]+[A-Z]?)\s*(?P<title>.*)", re.S)
LEADERS = re.compile(r"\s*\.{2,}\s*(\d{1,4})$")
PLAIN_PAGE = re.compile(r"\s(\d{1,3})$")
FOLIO = re.compile(r"[ivxlcdm]+|\d+")
LONG, ENDLESS = 85, 400  # characters of an entry that needs no leaders; beyond which nothing closes it


def entries(lines: list[str]) -> list[tuple[str, str, str, int]]:
    """(kind, number, title, page) of the lines of contents pages.

    An entry begins at its kind and runs over lines until its page number ends it: after leaders, on a line of its own,
    or, if it is long, after a blank. What belongs to none (running heads, folios, dates of revision) is dropped.
    """
    out: list[tuple[str, str, str, int]] = []
    held = ""

    def close(text: str, page: str) -> str:
        m = ENTRY.match(text)
        if m:
            out.append((m["kind"].lower(), m["num"].rstrip("."), re.sub(r"\s*\.{2,}\s*$", "", " ".join(m["title"].split())), int(page)))
        return ""

    for line in (x.strip() for x in lines):
        if not line or line.startswith(("Table of Contents", "Updated")):
            continue
        if FOLIO.fullmatch(line):
            held = close(held, line) if held and line.isdigit() else held
            continue
        held = line if ENTRY.match(line) else f"{held} {line}" if held else ""
        end = LEADERS.search(held) or (PLAIN_PAGE.search(held) if len(held) >= LONG else None)
        if end:
            held = close(held[: end.start()], end[1])
        elif len(held) > ENDLESS:
            held = ""
    return out


def contents(pages: DataFrame) -> DataFrame:
    """(doc_id, kind, num, title, printed_page) of contents pages (doc_id, page, text); null pages and texts are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, lines, out = None, [], []
        for pdf in batches:
            for d, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                if d != doc:
                    out += [(doc, *e) for e in entries(lines)]
                    doc, lines = d, []
                lines += text.splitlines()
            yield pd.DataFrame(out, columns=["doc_id", "kind", "num", "title", "printed_page"])
            out = []
        yield pd.DataFrame([(doc, *e) for e in entries(lines)], columns=["doc_id", "kind", "num", "title", "printed_page"])

    rows = pages.where("doc_id IS NOT NULL AND page IS NOT NULL AND text IS NOT NULL").select("doc_id", "page", "text")
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "page").mapInPandas(run, "doc_id string, kind string, num string, title string, printed_page int")


def reconciled(toc: DataFrame, blocks: DataFrame, slack: int = 1) -> DataFrame:
    """(doc_id, num, finding) for every rule of contents() or of blocks_from_lines(): only_printed, only_body, page, title or agrees."""
    key = lambda c: F.lower(F.regexp_replace(c, r"[^A-Za-z0-9]+", " "))
    said = toc.where("kind = 'rule'").select("doc_id", "num", F.col("title").alias("printed_title"), "printed_page")
    body = blocks.where("kind = 'rule'").select("doc_id", F.regexp_extract("text", r"^Rule\s+(\d+\.\d+[A-Z]?)", 1).alias("num"), F.regexp_extract("text", r"^Rule\s+\d+\.\d+[A-Z]?\s*(.*)$", 1).alias("title"), "page")
    both = said.join(body, ["doc_id", "num"], "full_outer")
    finding = F.when(F.col("page").isNull(), "only_printed").when(F.col("printed_page").isNull(), "only_body").when(F.abs(F.col("page") - F.col("printed_page")) > slack, "page").when(key(F.col("title")) != key(F.col("printed_title")), "title").otherwise("agrees")
    return both.select("doc_id", "num", finding.alias("finding"))
