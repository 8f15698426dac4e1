"""Searches as a user asks for them: full-text predicates, citation routing, and the whole path from facets to hits."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types
from pyspark.sql.window import Window as W

from corpusmill.functions import citations as C
from corpusmill.functions import stem as S
from corpusmill.operators import retrieval as R

CLAUSES = types.ArrayType(types.ArrayType(types.StructType([types.StructField("neg", types.BooleanType()), types.StructField("phrase", types.StringType())])))
PART = re.compile(r'(-?)"([^"]*)"|(\S+)')
WORD = re.compile(r"[^\W_]+(?:_+[^\W_]+)*|[^\W]+")


def parse_query(text: str | None) -> list[list[tuple[bool, str]]]:
    """A query as clauses that all have to hold, each a list of which one has to: words, "phrases", -what must not be, joined by or."""
    out: list[list[tuple[bool, str]]] = []
    joined = False
    for m in PART.finditer(text or ""):
        word = m[3]
        if word is not None and word.lower() == "or":
            joined = bool(out)
            continue
        neg, said = (m[1] == "-", m[2]) if word is None else (word.startswith("-"), word.lstrip("-"))
        phrase = " ".join(WORD.findall(said.lower()))
        if not phrase:
            continue
        if joined:
            out[-1].append((neg, phrase))
        else:
            out.append([(neg, phrase)])
        joined = False
    return out


@F.pandas_udf(CLAUSES)
def parsed_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [[{"neg": n, "phrase": p} for n, p in c] for c in parse_query(t)])


def plain_words(c: Column) -> Column:
    """The words of a text in small letters, with blanks between and around them."""
    return F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), " "), F.lit(" "))


def full_text(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, id): documents (id, text) for which a query (query_id, query_text) holds.

    Words and phrases are matched as they are, in any letter case. A query is looked up by the words of one clause without
    a negation (the one with the fewest ways), so documents are joined by words and never by all queries; one in which
    everything is negated or that is blank holds for none. The queries are broadcast, whatever size is estimated for
    either side: a text is held against its queries where it is read, and only ids move.
    """
    asked = queries.select("query_id", parsed_udf(F.col("query_text")).alias("clauses"))
    sure = F.filter("clauses", lambda c: F.forall(c, lambda x: ~x["neg"]))
    key = F.array_sort(F.transform(sure, lambda c: F.struct(F.size(c).alias("n"), F.transform(c, lambda x: F.element_at(F.split(x["phrase"], " "), 1)).alias("words"))))
    asked = asked.where(F.size(sure) > 0).select("query_id", "clauses", F.explode(F.array_distinct(key[0]["words"])).alias("word"))
    words = docs.select("id", plain_words(F.col("text")).alias("plain"))
    hit = words.select("id", "plain", F.explode(F.array_distinct(F.split(F.trim("plain"), " "))).alias("word")).join(F.broadcast(asked), "word")
    has = lambda x: F.contains(F.col("plain"), F.concat(F.lit(" "), x["phrase"], F.lit(" ")))
    holds = F.forall("clauses", lambda c: F.exists(c, lambda x: has(x) != x["neg"]))
    return hit.where(holds).select("query_id", "id").distinct()


def stemmed_bm25(queries: DataFrame, docs: DataFrame, pool: int) -> DataFrame:
    """As bm25() over the stems of words, on both sides. The distinct words are stemmed, not their occurrences.

    Only words whose stem a query has are kept, so postings of others never move.
    """
    asked = S.stemmed(R.query_terms(queries)).groupBy("query_id", "term").agg(F.sum("weight").alias("weight"))
    return R.bm25_by_scope(asked, docs, pool, vocabulary=lambda words: words.withColumn("stem", S.stem_udf(F.col("term"))).join(asked.select(F.col("term").alias("stem")).distinct(), "stem", "left_semi"))


def route(queries: DataFrame, chunks: DataFrame, lettered: list[str]) -> DataFrame:
    """(query_id, citation, id, step): the chunk that a citation named by a query leads to.

    queries: query_id, query_text; chunks: id, citations, in order of id. The query's first citation is written out; then
    the first chunk that lists it, or else its bare rule, or else any citation under that rule (the first one's of the
    first chunk), is taken. lettered: the numbers of rules that end in a letter.
    """
    text = C.canonical_udf(lettered)(F.col("query_text"))
    rule, groups = F.regexp_extract(text, C.ASKED_CITE, 1), F.regexp_replace(F.regexp_extract(text, C.ASKED_CITE, 2), r"\s+", "")
    cited = queries.select("query_id", rule.alias("rule"), groups.alias("groups")).where("rule <> ''")
    want = cited.select("query_id", F.inline(F.array(*[F.struct(F.lit(i).alias("step"), k.alias("key")) for i, k in enumerate((F.concat(F.lit("MCR "), "rule", "groups"), F.concat(F.lit("MCR "), "rule"), F.concat(F.lit("MCR "), F.col("rule"), F.lit("("))))])))
    listed = chunks.where("id IS NOT NULL").select("id", F.posexplode("citations").alias("n", "citation")).where("citation IS NOT NULL")
    exact = listed.groupBy(F.col("citation").alias("key")).agg(F.min(F.struct("id", "n", "citation")).alias("b"))
    under = listed.groupBy(F.concat(F.regexp_extract("citation", r"^([^(]*)\(", 1), F.lit("(")).alias("key")).agg(F.min(F.struct("id", "n", "citation")).alias("b")).where("key <> '('")
    best = want.join(exact.unionByName(under), "key").groupBy("query_id").agg(F.min(F.struct("step", "b")).alias("x"))
    return best.select("query_id", F.col("x.b.citation").alias("citation"), F.col("x.b.id").alias("id"), F.col("x.step").alias("step"))


def placed_first(routed: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """Hits (query_id, id, score, rank) with the routed id of each query before them, its score 1, up to k."""
    first = routed.select("query_id", "id", F.lit(1.0).alias("score"), F.lit(0).alias("rank"))
    rest = hits.select("query_id", "id", "score", "rank").join(routed.select("query_id", "id"), ["query_id", "id"], "left_anti")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    return first.unionByName(rest).withColumn("rank", rank).where(F.col("rank") <= k)


def pool_size(k: int, narrowed: bool, rerank: bool = False) -> int:
    """How many hits a lane gives: more where some of them will be dropped."""
    n = max(4 * k, 20)
    n = max(n, 8 * k, 80) if narrowed else n
    return max(n, 6 * k, 40) if rerank else n


def search(queries: DataFrame, docs: DataFrame, k: int, *, facets: tuple[str, ...] = (), group: str | None = None, dense_weight: float = 1.0, verified: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, lane, rank): the whole search over docs (scope, id, text, heading, vector, facets, group).

    queries: query_id, query_text, vector, and of each facet the value asked for (null asks for none). A lexical lane (BM25
    and trigrams by reciprocal ranks) and a dense one are fused by reciprocal ranks; then what is not of the facets, or not
    among `verified` (id), goes; of each group the best stays. Lanes are named by whose pool holds a hit. Blank queries
    have no hits. All is done for all queries at once.
    """
    queries = queries.where(F.trim(F.coalesce("query_text", F.lit(""))) != "")
    pool = pool_size(k, bool(facets) or group is not None or verified is not None)
    headed = docs.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.coalesce("heading", F.lit(""))))
    bm25 = R.bm25(R.query_terms(queries), docs, pool)
    lexical = R.fuse({"bm25": (bm25, 1.0), "grams": (R.char_grams(queries, headed, pool), 0.6)}, pool)
    dense = R.dense(queries, docs.select("id", "vector"), pool)
    rows = lexical.select("query_id", "id", "rank", F.lit("bm25").alias("lane"), F.lit(1.0).alias("w")).unionByName(dense.select("query_id", "id", "rank", F.lit("dense").alias("lane"), F.lit(dense_weight).alias("w")))
    fused = rows.groupBy("query_id", "id").agg(F.round(F.sum(F.col("w") / (60 + F.col("rank"))), 9).alias("score"), F.when(F.count("*") == 2, "hybrid").otherwise(F.max("lane")).alias("lane"))
    fused = R.top(fused, pool)
    keep = list(facets) + ([group] if group and group not in facets else [])
    if keep:
        fused = fused.join(docs.select("id", *keep), "id")
    for f in facets:
        fused = fused.join(queries.select("query_id", F.col(f).alias("wanted")), "query_id").where(F.col("wanted").isNull() | (F.col("wanted") == F.col(f))).drop("wanted")
    if verified is not None:
        fused = fused.join(verified.select("id").distinct(), "id", "left_semi")
    if group:
        best = F.row_number().over(W.partitionBy("query_id", group).orderBy("rank"))
        fused = fused.withColumn("g", best).where("g = 1")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    return fused.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", "score", "lane", "rank")
