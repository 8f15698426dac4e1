"""Documents as a whole: kinds, facets, metadata, terms that tell them apart, hashed vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusmill.functions import text as T


def kinds(docs: DataFrame, signals: list[tuple[str, str, float]], least: float = 0.34, margin: float = 0.08) -> DataFrame:
    """(id, kind, confidence): the kind whose signals weigh most in a text. signals: (kind, pattern, weight).

    The confidence is the kind's weight over that of the four best. A document is 'other' if that is below `least`, no
    more than `margin` ahead of the next, or if no signal is there. One pass over the texts: each kind's weight is a
    column, and nothing is joined.
    """
    names = sorted({s[0] for s in signals})
    score = lambda k: sum((F.when(F.col("text").rlike(p), F.lit(float(w))).otherwise(0.0) for n, p, w in signals if n == k), F.lit(0.0))
    scored = docs.select("id", F.array(*[F.struct((-score(k)).alias("w"), F.lit(k).alias("kind")) for k in names]).alias("all"))
    best = scored.select("id", F.slice(F.array_sort("all"), 1, 4).alias("best"))
    total = F.aggregate("best", F.lit(0.0), lambda a, x: a - x["w"])
    share = lambda i: F.coalesce(F.try_divide(-F.get(F.col("best"), F.lit(i))["w"], total), F.lit(0.0))
    sure = (share(0) >= least) & (share(0) - share(1) >= margin)
    return best.select("id", F.when(sure, F.col("best")[0]["kind"]).otherwise("other").alias("kind"), F.round(share(0), 4).alias("confidence"))


def first_keyword(c: Column, keywords: list[tuple[str, str]], default: str) -> Column:
    """The value of the first pattern, in their order, that the text has."""
    out = F.when(c.rlike(keywords[0][1]), keywords[0][0])
    for value, pattern in keywords[1:]:
        out = out.when(c.rlike(pattern), value)
    return out.otherwise(default)


def distinctive_terms(docs: DataFrame, k: int = 24, most: float = 0.6) -> DataFrame:
    """(id, term, score, rank): the terms of each document (id, text) by tf x ln(N / df).

    Terms of two letters or in more than max(2, most x N) documents are left out; ties go to the smaller term.
    """
    terms = docs.select("id", F.explode(T.tokens(F.col("text"))).alias("term")).where("length(term) > 2")
    tf = terms.groupBy("id", "term").agg(F.count("*").alias("tf"))
    n = docs.agg(F.count("*").alias("all"), F.lit(1).alias("one"))  # one row
    df = tf.groupBy("term").agg(F.count("*").alias("df"), F.lit(1).alias("one")).join(F.broadcast(n), "one").where(F.col("df") <= F.greatest(F.lit(2), F.floor(F.col("all") * most)))
    scored = tf.join(df, "term").select("id", "term", F.round(F.col("tf") * F.log(F.col("all") / F.col("df")), 6).alias("score"))
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "term"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def hashed_vectors(docs: DataFrame, dim: int = 256) -> DataFrame:
    """(id, bucket, value): the vector of each text (id, text) by feature hashing, its entries other than zero, of unit length.

    Features are tokens and the trigrams of each between blanks. The first four bytes of a feature's md5, the lowest
    first, are its number; the highest bit is its sign, the rest of the division by `dim` its bucket.
    """
    words = docs.select("id", F.explode(T.tokens(F.col("text"))).alias("w"))
    padded = F.concat(F.lit(" "), F.col("w"), F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.substr(padded, i, F.lit(3)))
    features = words.select("id", F.explode(F.concat(F.array("w"), grams)).alias("f")).groupBy("id", "f").agg(F.count("*").alias("n"))
    h = F.md5("f")
    number = F.conv(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("long")
    sums = features.select("id", "n", number.alias("h")).select("id", (F.col("h") % dim).cast("int").alias("bucket"), F.when(F.col("h") >= 2**31, -F.col("n")).otherwise(F.col("n")).alias("v"))
    sums = sums.groupBy("id", "bucket").agg(F.sum("v").alias("v")).where("v <> 0")
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(W.partitionBy("id")))
    return sums.select("id", "bucket", F.round(F.col("v") / norm, 6).alias("value"))
