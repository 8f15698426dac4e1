"""Column functions that put passages, citations and prompts together."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(c: Column, limit: int) -> Column:
    """A text of at most `limit` characters, cut at its last blank, with dots where it is cut."""
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, limit), r"\s+\S*$", ""), F.lit(" …")))


def page_span(first: Column, last: Column) -> Column:
    """'p. 3' or 'pp. 3–5'; null for page 0, which is unknown."""
    return F.when(F.coalesce(first, F.lit(0)) < 1, None).when(F.coalesce(last, first) <= first, F.concat(F.lit("p. "), first.cast("string"))).otherwise(F.concat(F.lit("pp. "), first.cast("string"), F.lit("–"), last.cast("string")))


def without_reasoning(c: Column) -> Column:
    """An answer without what is between think tags; of a tag that is never closed all is dropped but what follows a marker of the answer."""
    closed = F.regexp_replace(c, r"(?is)<think>.*?</think>\s*", "")
    tail = F.regexp_extract(closed, r"(?is)<think>.*?\b(?:final answer|answer)\s*:\s*(.*)$", 1)
    return F.trim(F.when(closed.rlike("(?i)<think>"), F.concat(F.regexp_replace(closed, r"(?is)<think>.*$", ""), tail)).otherwise(closed))


def once_in_a_row(c: Column) -> Column:
    """Sentences of a text without those that repeat the one before them."""
    parts = F.split(F.coalesce(c, F.lit("")), r"(?<=[.!?])\s+")
    return F.filter(parts, lambda x, i: (i == 0) | (x != F.get(parts, i - 1)))


def flexible(phrase: Column) -> Column:
    """A pattern for a phrase in any letter case, with any white space between its words; what is no letter or digit stands for itself."""
    return F.concat(F.lit("(?i)"), F.regexp_replace(F.regexp_replace(F.trim(phrase), r"([^\w\s])", r"\\$1"), r"\s+", r"\\s+"))


def content_words(c: Column, stop: tuple[str, ...]) -> Column:
    """Distinct words of more than three letters that are no stop words."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z]+)"), F.lit(1)), lambda w: (F.length(w) > 3) & ~w.isin(*stop)))


def echo(query: Column, passage: Column, stop: tuple[str, ...]) -> Column:
    """The share of a query's content words that the passage has; 0 without any."""
    q = content_words(query, stop)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, content_words(passage, stop))) / F.size(q))
