"""Column functions on text. All are built-in expressions that stay in the JVM, unless the name ends in _udf."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The stop words of the analyser.
STOPWORDS = """a an and are as at be by for from has have he in is it its of on that the
to was were will with this these those or not but if then else when while we
you your they their our his her she them i me my than into over under out up
down can could should would may might must do does did done about above below
after before between through during without within across also which who whom
whose what where why how all any both each few more most other some such only
own same so too very s t can just don now""".split()

WORD = r"[\p{L}\p{N}_]+"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def tokens(c: Column) -> Column:
    """Words in small letters, without words of one character and stop words; empty for null."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS))


def estimated_tokens(c: Column) -> Column:
    """floor(1.32 x words) + 1."""
    return F.floor(F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")) * 1.32).cast("long") + 1


def clean(c: Column) -> Column:
    """Converted text without control characters, tags, table pipes, stray underscores and runs of blanks."""
    s = F.coalesce(c, F.lit(""))
    for pattern, to in (
        (r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), (r"(?i)<br\s*/?>", "\n"), (r"</?[a-zA-Z][^>]*>", ""), (r"\u00A0", " "), (r"\|+", " "), (r"_+", " "), (r"[ \t]+", " "),
        (r"[ \t]+([.,;:)\]])", "$1"), (r"([•·▪‣])[ \t]*\n+[ \t]*", "$1 "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n"), (r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$", ""),
    ):
        s = F.regexp_replace(s, pattern, to)
    return s


def dehyphenate(c: Column) -> Column:
    """Words hyphenated across a line break, joined where a small letter follows."""
    return F.regexp_replace(c, r"([A-Za-z])-\s*\n\s*([a-z])", "$1$2")


@F.pandas_udf(StringType())
def nfkc_udf(s: pd.Series) -> pd.Series:
    """Unicode compatibility normal form, which has no built-in; null stays null."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def _let(value: Column, body) -> Column:
    """body(value), value being worked out once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def chars_of(c: Column, kept: str) -> Column:
    """How many characters of c are in the class `kept`."""
    return F.length(F.regexp_replace(c, f"[^{kept}]", ""))


def looks_garbled(c: Column) -> Column:
    """Whether a text layer looks broken: lost characters, no blanks, few letters, words far too long or too short."""

    def judge(x: Column) -> Column:
        n, words = x["n"], x["words"]
        mean = F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w)) / F.size(words)
        return (
            F.when(n < 40, False)
            .when(x["lost"] / n > 0.02, True)
            .when((n > 200) & (x["blanks"] / n < 0.02), True)
            .when((x["letters"] / n < 0.5) & (x["blanks"] / n < 0.06), True)
            .when(x["letters"] / n < 0.2, True)
            .when((F.size(words) > 0) & (mean > 18), True)
            .when((F.size(words) >= 12) & (mean < 1.6), True)
            .otherwise(False)
        )

    def measure(t: Column) -> Column:
        words = F.filter(F.regexp_extract_all(t, F.lit(r"([^\s|]+)"), F.lit(1)), lambda w: w.rlike(r"[\p{L}\p{N}]"))
        of = lambda kept: chars_of(t, kept)
        return F.struct(F.length(t).alias("n"), of(" ").alias("blanks"), of(r"\p{L}").alias("letters"), of("\uFFFD").alias("lost"), words.alias("words"))

    return _let(_let(strip(F.coalesce(c, F.lit(""))), measure), judge)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of words [0-9a-z]+ in small letters; 1 if both are empty, 0 if one is."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([0-9a-z]+)"), F.lit(1)))
    x, y = words(a), words(b)
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def guess_language(c: Column, least: float = 0.12) -> Column:
    """'en' if stop words are at least that share of the words, else 'unknown'."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z]+)"), F.lit(1))
    return _let(words, lambda w: F.when((F.size(w) > 0) & (F.size(F.filter(w, lambda x: x.isin(STOPWORDS))) / F.size(w) >= least), "en").otherwise("unknown"))


def summary(c: Column, limit: int = 320) -> Column:
    """The first paragraph that is no heading or table row, cut to `limit` characters; empty if there is none."""
    paragraphs = F.transform(F.split(F.coalesce(c, F.lit("")), r"\n\s*\n"), strip)
    prose = F.filter(paragraphs, lambda p: (p != "") & ~p.startswith("#") & ~p.startswith("|"))
    return F.substring(F.coalesce(F.get(prose, F.lit(0)), F.lit("")), 1, limit)


def first_term_snippet(text: Column, terms: Column, width: int = 240) -> Column:
    """`width` characters of the text around the earliest of the terms, with dots where it is cut."""
    flat = strip(F.regexp_replace(F.regexp_replace(text, r"(?i)<br\s*/?>", " "), r"[\s|]+", " "))
    at = F.array_min(F.filter(F.transform(terms, lambda t: F.expr("0") + F.instr(F.lower(flat), t)), lambda i: i > 0))
    start = F.greatest(F.lit(1), F.coalesce(at, F.lit(1)) - width // 3)
    body = F.substr(flat, start, F.lit(width))
    return F.concat(F.when(start > 1, "… ").otherwise(""), body, F.when(start + width <= F.length(flat), " …").otherwise(""))
