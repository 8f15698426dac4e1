"""Retrieval and evaluation queries over the chunks of the policy side, and the SQL of each."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import evaluation as E
from corpusmill.operators import retrieval as R
from corpusmill.sources.tables import table

K = 10
POOL = 40

# An invented lexicon of forms that stand for each other.
LEXICON = [("g1", "hearing"), ("g1", "proceeding"), ("g1", "conference"), ("g2", "motion"), ("g2", "petition"), ("g3", "guardian"), ("g3", "custodian"), ("g3", "relative")]


def kb(s: SparkSession, d: str) -> DataFrame:
    """(scope, id, text, heading, doc_id, ordinal): the last delivery of each chunk of the policy side."""
    rows = R.latest(table(s, d, "kb_chunks"), "chunk_id", "loaded_at", "text", "heading_path", "doc_id", "ordinal")
    return rows.select(F.lit("kb").alias("scope"), F.col("chunk_id").alias("id"), "text", F.array_join(F.coalesce("heading_path", F.array().cast("array<string>")), " ").alias("heading"), "doc_id", "ordinal")


def with_heading(docs: DataFrame) -> DataFrame:
    """Text and heading as one text."""
    return docs.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.coalesce("heading", F.lit(""))))


def rule_chunks(s: SparkSession, d: str) -> DataFrame:
    rows = R.latest(table(s, d, "chunks"), "chunk_id", "loaded_at", "text", "rule_title", "rule", "deleted_at").where("deleted_at IS NULL")
    return rows.select(F.lit("rules").alias("scope"), F.col("chunk_id").alias("id"), "text", F.coalesce("rule_title", F.lit("")).alias("heading"), "rule")


def asked(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "eval_queries").select("query_id", "query_text", "query_type", "arm")


def vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def vector_queries(s: SparkSession, d: str) -> DataFrame:
    return vectors(s, d).where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector", "label")


def token_stats(s: SparkSession, d: str) -> DataFrame:
    t = T.tokens(F.col("text"))
    return kb(s, d).select(F.col("id").alias("chunk_id"), F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"), T.estimated_tokens(F.col("text")).alias("estimate"))


def term_df(s: SparkSession, d: str) -> DataFrame:
    terms = kb(s, d).select("id", F.explode(T.tokens(F.col("text"))).alias("term"))
    return terms.groupBy("term").agg(F.countDistinct("id").alias("df"), F.count("*").alias("n"))


def _bm25(s: SparkSession, d: str, terms: DataFrame | None = None) -> DataFrame:
    return R.bm25(terms if terms is not None else R.query_terms(asked(s, d)), kb(s, d), POOL)


def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    return _bm25(s, d).where(F.col("rank") <= K).select("query_id", F.col("id").alias("chunk_id"), "score", "rank")


def bm25_synonyms(s: SparkSession, d: str) -> DataFrame:
    terms = R.with_synonyms(R.query_terms(asked(s, d)), s.createDataFrame(LEXICON, "group_id string, form string"))
    return _bm25(s, d, terms).where(F.col("rank") <= K).select("query_id", F.col("id").alias("chunk_id"), "score", "rank")


def bm25_feedback(s: SparkSession, d: str) -> DataFrame:
    terms = R.query_terms(asked(s, d))
    more = R.with_feedback(terms, _bm25(s, d, terms), kb(s, d))
    return _bm25(s, d, more).where(F.col("rank") <= K).select("query_id", F.col("id").alias("chunk_id"), "score", "rank")


def bm25_by_document(s: SparkSession, d: str) -> DataFrame:
    """Statistics within each rule: the scope is what is searched."""
    docs = rule_chunks(s, d).where("rule IS NOT NULL").withColumn("scope", F.col("rule"))
    hits = R.bm25_by_scope(R.query_terms(asked(s, d)), docs, 1)
    return hits.select("query_id", F.col("scope").alias("rule"), F.col("id").alias("chunk_id"), "score")


def char_gram_topk(s: SparkSession, d: str) -> DataFrame:
    return R.char_grams(asked(s, d), with_heading(kb(s, d)), K).select("query_id", F.col("id").alias("chunk_id"), "score", "rank")


def _lexical(s: SparkSession, d: str) -> DataFrame:
    return R.fuse({"bm25": (_bm25(s, d), 1.0), "grams": (R.char_grams(asked(s, d), with_heading(kb(s, d)), POOL), 0.6)}, POOL)


def hybrid_rrf(s: SparkSession, d: str) -> DataFrame:
    return _lexical(s, d).where(F.col("rank") <= K).select("query_id", F.col("id").alias("chunk_id"), "score", "lane", "rank")


def hybrid_by_document(s: SparkSession, d: str) -> DataFrame:
    """The best chunk of each document."""
    hits = R.first_of_group(_lexical(s, d).join(kb(s, d).select("id", "doc_id"), "id"), "doc_id")
    return hits.where(F.col("rank") <= 5).select("query_id", "doc_id", F.col("id").alias("chunk_id"), "rank")


def collection_fusion(s: SparkSession, d: str) -> DataFrame:
    """Both corpora, each ranked on its own, fused by rank."""
    terms = R.query_terms(asked(s, d))
    both = {n: (R.bm25(terms, c, POOL), 1.0) for n, c in (("kb", kb(s, d)), ("rules", rule_chunks(s, d)))}
    return R.fuse(both, K).select("query_id", F.col("id").alias("chunk_id"), "lane", "score", "rank")


def rerank_blend(s: SparkSession, d: str) -> DataFrame:
    """Word overlap with the query stands in for a reranker's score."""
    hits = _bm25(s, d).join(kb(s, d).select("id", "text"), "id").join(asked(s, d).select("query_id", "query_text"), "query_id")
    given = hits.withColumn("given", F.round(T.jaccard(F.col("text"), F.col("query_text")), 6))
    return R.rerank_blend(given, "given").where(F.col("rank") <= K).select("query_id", F.col("id").alias("chunk_id"), "score", "rank")


def _dense(s: SparkSession, d: str, dims: int | None = None) -> DataFrame:
    hits = R.dense(vector_queries(s, d), vectors(s, d), POOL + 1, dims).where("query_id <> id")
    return R.top(hits.drop("rank"), POOL)


def dense_topk(s: SparkSession, d: str, dims: int | None = None) -> DataFrame:
    return _dense(s, d, dims).where(F.col("rank") <= K).select("query_id", F.col("id").alias("vec_id"), "score", "rank")


def _gold(s: SparkSession, d: str) -> DataFrame:
    q = vector_queries(s, d).select("query_id", "label")
    return vectors(s, d).select("id", "label").join(q, "label").where("id <> query_id").select("query_id", "id")


def _ranks(s: SparkSession, d: str, dims: int | None = None) -> DataFrame:
    return E.first_relevant(_dense(s, d, dims), _gold(s, d), vector_queries(s, d))


def retrieval_metrics(s: SparkSession, d: str) -> DataFrame:
    return E.recall_mrr(_ranks(s, d))


def metrics_by_slice(s: SparkSession, d: str) -> DataFrame:
    """For all queries, for each label, and for each parity of the id: grouping sets in one pass."""
    slices = vector_queries(s, d).select("query_id", F.col("label").cast("int"), (F.floor(F.col("query_id") / 100) % 2).cast("int").alias("half"))
    return E.recall_mrr(_ranks(s, d).join(slices, "query_id"), by=["label", "half"])


def ndcg_at_10(s: SparkSession, d: str) -> DataFrame:
    return E.ndcg(_dense(s, d), _gold(s, d), vector_queries(s, d), K)


def mcnemar_truncation(s: SparkSession, d: str) -> DataFrame:
    return E.mcnemar(_ranks(s, d), _ranks(s, d, 8), 1)


def bootstrap_truncation(s: SparkSession, d: str) -> DataFrame:
    one = lambda c, n: F.coalesce(1 / F.col(c), F.lit(0.0)).alias(n)
    pairs = _ranks(s, d).select("query_id", one("rank", "a")).join(_ranks(s, d, 8).select("query_id", one("rank", "b")), "query_id")
    return E.bootstrap(pairs)


def token_budget(s: SparkSession, d: str) -> DataFrame:
    """What of the best 24 hits fits 4,096 tokens."""
    hits = _bm25(s, d).where(F.col("rank") <= 24).join(kb(s, d).select("id", T.estimated_tokens(F.col("text")).alias("n")), "id")
    return R.budget(hits, "n", 4096).select("query_id", F.col("id").alias("chunk_id"), "rank", "n", "spent")


def neighbour_window(s: SparkSession, d: str) -> DataFrame:
    rows = R.neighbours(kb(s, d), "doc_id", "ordinal", "text", 1, 1)
    return rows.select(F.col("id").alias("chunk_id"), F.length("window_text").cast("long").alias("n_chars"), F.md5("window_text").alias("hash"))


def snippets(s: SparkSession, d: str) -> DataFrame:
    terms = asked(s, d).select("query_id", F.array_distinct(T.tokens(F.col("query_text"))).alias("terms"))
    hits = _bm25(s, d).where(F.col("rank") <= 3).join(kb(s, d).select("id", "text"), "id").join(terms, "query_id")
    return hits.select("query_id", F.col("id").alias("chunk_id"), T.first_term_snippet(F.col("text"), F.col("terms")).alias("snippet"))


QUERIES = {
    "token_stats": token_stats, "term_df": term_df, "bm25_topk": bm25_topk, "bm25_synonyms": bm25_synonyms, "bm25_feedback": bm25_feedback, "bm25_by_rule": bm25_by_document,
    "char_gram_topk": char_gram_topk, "hybrid_rrf": hybrid_rrf, "hybrid_by_document": hybrid_by_document, "collection_fusion": collection_fusion, "rerank_blend": rerank_blend,
    "dense_topk": dense_topk, "dense_truncated": partial(dense_topk, dims=16), "retrieval_metrics": retrieval_metrics, "metrics_by_slice": metrics_by_slice, "ndcg_at_10": ndcg_at_10,
    "mcnemar_truncation": mcnemar_truncation, "bootstrap_truncation": bootstrap_truncation, "token_budget": token_budget, "neighbour_window": neighbour_window, "snippets": snippets,
}

_STOP = "[" + ", ".join(f"'{w}'" for w in sorted(set(T.STOPWORDS))) + "]"


def _toks(c: str) -> str:
    return rf"list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[\pL\pN_]+'), lambda w: length(w) > 1 AND NOT list_contains({_STOP}, w))"


_KB = f"""
kb0 AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at DESC NULLS LAST, text DESC NULLS LAST) AS rn FROM kb_chunks WHERE chunk_id IS NOT NULL),
kb AS (SELECT chunk_id AS id, doc_id, ordinal, text, coalesce(array_to_string(heading_path, ' '), '') AS heading, list_concat({_toks("text")}, list_concat({_toks("array_to_string(heading_path, ' ')")}, {_toks("array_to_string(heading_path, ' ')")})) AS toks FROM kb0 WHERE rn = 1),
rules1 AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at DESC NULLS LAST, text DESC NULLS LAST, rule_title DESC NULLS LAST, rule DESC NULLS LAST, deleted_at DESC NULLS LAST) AS rn FROM chunks WHERE chunk_id IS NOT NULL),
rules0 AS (SELECT * FROM rules1 WHERE deleted_at IS NULL),
qt AS (SELECT query_id, term, count(*)::DOUBLE AS weight FROM (SELECT query_id, unnest({_toks("query_text")}) AS term FROM eval_queries) GROUP BY ALL)"""


def _bm25_sql(out: str, terms: str, docs: str, pool: int = POOL, scope: str = "'x'") -> str:
    """CTEs that end in `out` (query_id, sc, id, score, rank) over docs (id, toks, and what scope needs)."""
    return f"""
{out}_d AS (SELECT {scope} AS sc, id, len(toks) AS dl, toks FROM {docs}),
{out}_s AS (SELECT sc, count(*) AS n, avg(dl) AS avgdl FROM {out}_d GROUP BY sc),
{out}_tf AS (SELECT sc, id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT sc, id, dl, unnest(toks) AS term FROM {out}_d) GROUP BY sc, id, term),
{out}_df AS (SELECT sc, term, count(*) AS df FROM {out}_tf GROUP BY sc, term),
{out}_sc AS (SELECT q.query_id, t.sc, t.id, round(sum(q.weight * ln(1 + (s.n - f.df + 0.5) / (f.df + 0.5)) * t.tf * 2.5 / (t.tf + 1.5 * (0.25 + 0.75 * t.dl / s.avgdl))), 6) AS score
  FROM {terms} q JOIN {out}_tf t USING (term) JOIN {out}_df f ON f.sc = t.sc AND f.term = t.term JOIN {out}_s s ON s.sc = t.sc GROUP BY ALL),
{out} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, sc ORDER BY score DESC, id) AS rank FROM {out}_sc WHERE score > 0) WHERE rank <= {pool})"""


def _grams_sql(out: str, pool: int = POOL) -> str:
    words = lambda c: f"list_filter(string_split(trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')"
    grams = lambda c: f"flatten(list_transform({words(c)}, lambda w: list_transform(range(1, length(w) + 1), lambda i: substr(' ' || w || ' ', i, 3))))"
    return f"""
{out}_q0 AS (SELECT query_id, g, count(*) AS n FROM (SELECT query_id, unnest({grams("query_text")}) AS g FROM eval_queries) GROUP BY ALL),
{out}_q AS (SELECT query_id, g, n / sqrt(sum(n * n) OVER (PARTITION BY query_id)) AS w FROM {out}_q0),
{out}_d0 AS (SELECT id, g, count(*) AS n FROM (SELECT id, unnest({grams("text || ' ' || heading")}) AS g FROM kb) GROUP BY ALL),
{out}_d AS (SELECT id, g, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS w FROM {out}_d0),
{out} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, round(sum(a.w * b.w), 6) AS score FROM {out}_q a JOIN {out}_d b USING (g) GROUP BY ALL) WHERE score > 0) WHERE rank <= {pool})"""


_LEX = f"""WITH {_KB}, {_bm25_sql("b", "qt", "kb")}, {_grams_sql("g")},
fu AS (SELECT query_id, id, round(coalesce(1.0 / (60 + b.rank), 0) + coalesce(0.6 / (60 + g.rank), 0), 9) AS score,
  CASE WHEN b.rank IS NULL THEN 'grams' WHEN g.rank IS NULL THEN 'bm25' ELSE 'bm25+grams' END AS lane FROM b FULL OUTER JOIN g USING (query_id, id)),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fu) WHERE rank <= {POOL})"""


def _dense_sql(out: str, dims: int = 64) -> str:
    cut = lambda c: f"list_transform({c}[1:{dims}], lambda x: x::DOUBLE)"
    return f"""
{out}_v AS (SELECT vec_id AS id, label, {cut("embedding")} AS v FROM embeddings),
{out}_p AS (SELECT a.id AS query_id, b.id, round(list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))), 6) AS score, a.label = b.label AS gold
  FROM {out}_v a, {out}_v b WHERE a.id % 100 = 0 AND a.id <> b.id),
{out} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {out}_p WHERE score > 0) WHERE rank <= {POOL}),
{out}_r AS (SELECT q.query_id, min(d.rank) AS rank FROM (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 100 = 0) q LEFT JOIN {out} d ON d.query_id = q.query_id AND d.gold GROUP BY q.query_id)"""


_MEASURES = "count(*) AS n, round(avg((coalesce(rank, 999) <= 1)::INT), 6) AS r_at_1, round(avg((coalesce(rank, 999) <= 3)::INT), 6) AS r_at_3, round(avg((coalesce(rank, 999) <= 10)::INT), 6) AS r_at_10, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr"
_HITS = f"SELECT query_id, id AS chunk_id, score, rank FROM b WHERE rank <= {K}"
_LEXICON_SQL = ", ".join(f"('{g}', '{f}')" for g, f in LEXICON)
_JACCARD = "CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1.0 WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) END"
_ALNUM = lambda c: f"list_distinct(regexp_extract_all(lower(coalesce({c}, '')), '[0-9a-z]+'))"
_EST = lambda c: rf"floor(len(list_filter(regexp_split_to_array(coalesce({c}, ''), '[ \t\n\r\f\x0B]+'), lambda w: w <> '')) * 1.32)::BIGINT + 1"

ORACLE = {
    "token_stats": f"WITH {_KB} SELECT id AS chunk_id, len({_toks('text')}) AS n_tokens, len(list_distinct({_toks('text')})) AS n_distinct, {_EST('text')} AS estimate FROM kb",
    "term_df": f"WITH {_KB} SELECT term, count(DISTINCT id) AS df, count(*) AS n FROM (SELECT id, unnest({_toks('text')}) AS term FROM kb) GROUP BY term",
    "bm25_topk": f"WITH {_KB}, {_bm25_sql('b', 'qt', 'kb')} {_HITS}",
    "bm25_synonyms": f"""WITH {_KB}, lx(group_id, form) AS (VALUES {_LEXICON_SQL}),
qs AS (SELECT * FROM qt UNION ALL SELECT DISTINCT q.query_id, b.form, 0.5 FROM qt q JOIN lx a ON a.form = q.term JOIN lx b USING (group_id) WHERE NOT EXISTS (SELECT 1 FROM qt z WHERE z.query_id = q.query_id AND z.term = b.form)),
{_bm25_sql("b", "qs", "kb")} {_HITS}""",
    "bm25_feedback": f"""WITH {_KB}, {_bm25_sql("f", "qt", "kb")},
w AS (SELECT query_id, term, count(*) AS n FROM (SELECT f.query_id, unnest({_toks("kb.text")}) AS term FROM f JOIN kb USING (id) WHERE f.rank <= 5) GROUP BY ALL),
w2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, term) AS r FROM w WHERE NOT EXISTS (SELECT 1 FROM qt z WHERE z.query_id = w.query_id AND z.term = w.term)),
qs AS (SELECT * FROM qt UNION ALL SELECT query_id, term, 0.3 FROM w2 WHERE r <= 8), {_bm25_sql("b", "qs", "kb")} {_HITS}""",
    "bm25_by_rule": f"WITH {_KB}, rc AS (SELECT chunk_id AS id, rule, list_concat({_toks('text')}, list_concat({_toks('rule_title')}, {_toks('rule_title')})) AS toks FROM rules0 WHERE rn = 1 AND rule IS NOT NULL), {_bm25_sql('b', 'qt', 'rc', 1, 'rule')} SELECT query_id, sc AS rule, id AS chunk_id, score FROM b",
    "char_gram_topk": f"WITH {_KB}, {_grams_sql('g', K)} SELECT query_id, id AS chunk_id, score, rank FROM g",
    "hybrid_rrf": f"{_LEX} SELECT query_id, id AS chunk_id, score, lane, rank FROM lex WHERE rank <= {K}",
    "hybrid_by_document": f"{_LEX}, x AS (SELECT query_id, doc_id, id, lex.rank, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY lex.rank) AS g FROM lex JOIN kb USING (id)), y AS (SELECT query_id, doc_id, id AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM x WHERE g = 1) SELECT * FROM y WHERE rank <= 5",
    "collection_fusion": f"""WITH {_KB}, rc AS (SELECT chunk_id AS id, list_concat({_toks("text")}, list_concat({_toks("rule_title")}, {_toks("rule_title")})) AS toks FROM rules0 WHERE rn = 1), {_bm25_sql("b", "qt", "kb")}, {_bm25_sql("c", "qt", "rc")},
u AS (SELECT query_id, id, 'kb' AS lane, round(1.0 / (60 + rank), 9) AS score FROM b UNION ALL SELECT query_id, id, 'rules', round(1.0 / (60 + rank), 9) FROM c)
SELECT * FROM (SELECT query_id, id AS chunk_id, lane, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM u) WHERE rank <= {K}""",
    "rerank_blend": f"""WITH {_KB}, {_bm25_sql("b", "qt", "kb")},
j0 AS (SELECT b.query_id, b.id, b.rank, {_ALNUM("kb.text")} AS x, {_ALNUM("q.query_text")} AS y FROM b JOIN kb USING (id) JOIN eval_queries q USING (query_id)),
j1 AS (SELECT *, round({_JACCARD}, 6) AS given FROM j0), j2 AS (SELECT *, max(given) OVER (PARTITION BY query_id) AS best FROM j1),
j3 AS (SELECT query_id, id, round(0.5 * CASE WHEN best > 0 THEN given / best ELSE 0 END + 0.5 / rank, 6) AS score FROM j2)
SELECT * FROM (SELECT query_id, id AS chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM j3) WHERE rank <= {K}""",
    "dense_topk": f"WITH {_dense_sql('e')} SELECT query_id, id AS vec_id, score, rank FROM e WHERE rank <= {K}",
    "dense_truncated": f"WITH {_dense_sql('e', 16)} SELECT query_id, id AS vec_id, score, rank FROM e WHERE rank <= {K}",
    "retrieval_metrics": f"WITH {_dense_sql('e')} SELECT {_MEASURES} FROM e_r",
    "metrics_by_slice": f"""WITH {_dense_sql("e")}, m AS (SELECT r.query_id, r.rank, v.label::INT AS label, (floor(r.query_id / 100) % 2)::INT AS half FROM e_r r JOIN e_v v ON v.id = r.query_id)
SELECT NULL::INT AS label, NULL::INT AS half, {_MEASURES} FROM m UNION ALL SELECT label, NULL, {_MEASURES} FROM m GROUP BY label UNION ALL SELECT NULL, half, {_MEASURES} FROM m GROUP BY half""",
    "ndcg_at_10": f"""WITH {_dense_sql("e")}, g AS (SELECT query_id, count(*) AS relevant FROM e_p WHERE gold GROUP BY query_id),
h AS (SELECT query_id, count(*) AS found, sum(1 / log2(rank + 1)) AS dcg FROM e WHERE gold AND rank <= {K} GROUP BY query_id)
SELECT query_id, round(coalesce(found, 0) / relevant, 6) AS recall, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(relevant, {K}) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM g LEFT JOIN h USING (query_id)""",
    "mcnemar_truncation": f"""WITH {_dense_sql("e")}, {_dense_sql("f", 8)},
c AS (SELECT count(*) AS n, count(*) FILTER (WHERE coalesce(a.rank, 99) <= 1 AND coalesce(b.rank, 99) > 1) AS only_a, count(*) FILTER (WHERE coalesce(a.rank, 99) > 1 AND coalesce(b.rank, 99) <= 1) AS only_b FROM e_r a JOIN f_r b USING (query_id))
SELECT n, only_a, only_b, CASE WHEN only_a + only_b = 0 THEN 1.0 ELSE round(least(1.0, 2 * list_sum(list_transform(range(0, least(only_a, only_b) + 1), lambda i: factorial((only_a + only_b)::INT)::DOUBLE / (factorial(i::INT)::DOUBLE * factorial((only_a + only_b - i)::INT)::DOUBLE))) / pow(2, only_a + only_b)), 6) END AS p_value FROM c""",
    "token_budget": f"""WITH {_KB}, {_bm25_sql("b", "qt", "kb")}, n AS (SELECT id, {_EST("text")} AS n FROM kb),
t AS (SELECT query_id, id AS chunk_id, rank, n, sum(n) OVER (PARTITION BY query_id ORDER BY rank)::BIGINT AS spent FROM b JOIN n USING (id) WHERE rank <= 24) SELECT * FROM t WHERE rank = 1 OR spent <= 4096""",
    "neighbour_window": f"""WITH {_KB}, w AS (SELECT id, string_agg(text, chr(10) || chr(10)) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS t FROM kb) SELECT id AS chunk_id, length(coalesce(t, '')) AS n_chars, md5(coalesce(t, '')) AS hash FROM w""",
}
