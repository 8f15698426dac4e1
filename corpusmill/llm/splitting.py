"""Splitting oversized items at natural boundaries (problem 4).

A text over the limit is cut into pieces of at most `limit` characters. The unit of cutting is the coarsest of which
every one fits: paragraphs, lines, sentences, words, or none. Where the pieces end is chosen by lexical cohesion: the
words in a block before a boundary are compared with those in a block after it, a valley of that similarity marks a
change of topic, and of the boundaries a piece may end at the one with the deepest valley is taken. Each piece but the
first then repeats the last `overlap` characters of the piece before.

All work is on one row at a time. Only texts over the limit leave the scan; they are shuffled once, so that repeated rows
come out once.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINE_END = re.compile(r"\r\n|\n|\r")
BLANK_LINES = re.compile(r"(?>\r\n|\n|\r)(?:[ \t]*(?>\r\n|\n|\r))+")
SENTENCE_END = re.compile(r"(?<=[.?!;])\s+")
CJK_SENTENCE_END = re.compile(r"(?<=[。！？；])(?=[^。！？；\s])")
SPACE = re.compile(r"\s+")
WORDS = re.compile(r"[^\W\d_]{3,}")
UNITS = ("paragraph", "line", "sentence", "word")
WORD = UNITS.index("word")


def _spans(text: str, separator: re.Pattern, within: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of each span between the separator's matches, as spans; empty parts are left out."""
    out = []
    for a, b in within:
        at = a
        for m in separator.finditer(text, a, b):
            if m.start() > at:
                out.append((at, m.start()))
            at = m.end()
        if b > at:
            out.append((at, b))
    return out


def units(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the paragraphs, lines, sentences and words of a text.

    A line of blanks ends a paragraph; CRLF is one line end; a sentence is a part of a line.
    """
    paragraphs = _spans(text, BLANK_LINES, [(0, len(text))])
    lines = _spans(text, LINE_END, paragraphs)
    sentences = _spans(text, SENTENCE_END, lines)
    return {"paragraph": paragraphs, "line": lines, "sentence": sentences, "word": _spans(text, SPACE, sentences)}


def cut_level(text: str, limit: int, spans: dict[str, list[tuple[int, int]]] | None = None) -> str:
    """The coarsest unit of which every one in the text has at most `limit` characters, or 'none'."""
    spans = spans or units(text)
    for unit in UNITS:
        if all(b - a <= limit for a, b in spans[unit]):
            return unit
    return "none"


def cohesion_depths(bags: list[Counter], block: int = 3) -> list[float]:
    """How deep a valley of lexical similarity lies at each boundary between neighbouring units; n - 1 numbers.

    The similarity at a boundary is the cosine of the word counts of the `block` units before and after it; the depth
    is how far it lies below the peaks reached by climbing to either side.
    """
    n = len(bags)
    before, after = Counter(), Counter()
    for b in bags[1 : 1 + block]:
        after.update(b)
    similar = []
    for i in range(n - 1):
        before.update(bags[i])
        if i >= block:
            before.subtract(bags[i - block])
        if i:
            after.subtract(bags[i])
            if i + block < n:
                after.update(bags[i + block])
        dot = sum(c * after[w] for w, c in before.items() if c)
        norm = sum(c * c for c in before.values()) * sum(c * c for c in after.values())
        similar.append(dot / norm**0.5 if norm else 0.0)

    # the peak to either side: similarity climbs as long as it does not fall again
    left, right = similar[:], similar[:]
    for i in range(1, len(similar)):
        if similar[i - 1] >= similar[i]:
            left[i] = left[i - 1]
    for i in range(len(similar) - 2, -1, -1):
        if similar[i + 1] >= similar[i]:
            right[i] = right[i + 1]
    return [left[i] + right[i] - 2 * s for i, s in enumerate(similar)]


def split(text: str, limit: int, overlap: int, least: float = 0.4) -> tuple[str, list[tuple[int, int, str]]]:
    """The cut level of a text and its pieces (start, end, boundary at the end), new text only, without the overlap.

    The first piece holds up to `limit` characters, the others up to limit - overlap. A piece ends at the deepest
    valley between `least` of its room and all of it, paragraph ends before line ends before sentence ends where there
    are any in that window, else at the last such end before it, else at a word end; a unit longer than the room is cut at the next finer boundary, and
    a word longer than that is cut anywhere. White space between pieces stays with the piece before it. The pieces
    joined are the text.
    """
    spans = units(text)
    level = cut_level(text, limit, spans)
    n, pieces, at = len(text), [], 0
    # a boundary is where a unit begins; depth by the units of the coarsest kind that has it
    marks: dict[int, tuple[int, float]] = {}
    for rank, unit in reversed(list(enumerate(UNITS))):
        s = spans[unit]
        if unit == "word":
            depths = [0.0] * max(0, len(s) - 1)
        else:
            depths = cohesion_depths([Counter(w.lower() for w in WORDS.findall(text, a, b)) for a, b in s]) if len(s) > 1 else []
        for (a, _), d in zip(s[1:], depths, strict=True):
            marks[a] = (rank, d)
    # ends of sentences without white space after them are no unit of the cut level but natural places to cut
    for m in CJK_SENTENCE_END.finditer(text):
        marks.setdefault(m.start(), (2, 0.0))
    cuts = sorted(marks)
    cut_from = lambda x: bisect.bisect_left(cuts, x)
    while n - at > (room := limit if not pieces else limit - overlap):
        lo, hi = at + max(1, int(room * least)), at + room
        window = cuts[cut_from(lo) : cut_from(hi + 1)]
        if all(marks[c][0] == WORD for c in window):  # before a unit is cut, the last of the coarsest ends ahead of the window
            early = [c for c in cuts[cut_from(at + 1) : cut_from(lo)] if marks[c][0] < WORD]
            window = [min(early, key=lambda c: (marks[c][0], -c))] if early else window or cuts[cut_from(at + 1) : cut_from(hi + 1)]
        if window:
            end = min(window, key=lambda c: (marks[c][0], -marks[c][1], -c))
            pieces.append((at, end, UNITS[marks[end][0]]))
        else:
            end = hi
            pieces.append((at, end, "none"))
        at = end
    if at < n or not pieces:
        pieces.append((at, n, "end"))
    return level, pieces


PIECE = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("cut_at", T.StringType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("n_pieces", T.IntegerType()),
        T.StructField("boundary", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("heading_path", T.ArrayType(T.StringType())),
        T.StructField("page_start", T.IntegerType()),
        T.StructField("text", T.StringType()),
    ]
)


def split_oversized(chunks: DataFrame, limit: int = 1500, overlap: int = 150) -> DataFrame:
    """Ordered pieces of the rows of chunks whose text has more than `limit` characters (code points).

    chunks: chunk_id, text, heading_path, page_start; other columns are not read. Gives (chunk_id, cut_at, piece from 1,
    n_pieces, boundary at the piece's end, start of the piece's new text, heading_path, page_start, text with the
    overlap). Texts within the limit and null texts give no rows, repeated rows with the same text, heading_path and
    page_start come out once, null heading_path and page_start are kept, a text of blanks alone is cut anywhere.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be smaller than limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("chunk_id", pa.string()), ("cut_at", pa.string()), ("piece", pa.int32()), ("n_pieces", pa.int32()), ("boundary", pa.string()), ("start", pa.int32()), ("heading_path", pa.list_(pa.string())), ("page_start", pa.int32()), ("text", pa.string())]
        )
        for b in batches:
            rows = []
            for r in b.to_pylist():
                text = r["text"]
                level, pieces = split(text, limit, overlap)
                for i, (start, end, boundary) in enumerate(pieces):
                    rows.append((r["chunk_id"], level, i + 1, len(pieces), boundary, start, r["heading_path"], r["page_start"], text[max(0, start - overlap) if i else start : end]))
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    long = chunks.select("chunk_id", "heading_path", "page_start", "text").where(F.length("text") > limit)
    return long.distinct().mapInArrow(run, PIECE)


def cut_levels(pieces: DataFrame) -> DataFrame:
    """(chunk_id, cut_at) of the pieces of split_oversized()."""
    return pieces.select("chunk_id", "cut_at").distinct()
