"""Searches over both corpora, and the SQL of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import evaluation as E
from corpusmill.operators import retrieval as R
from corpusmill.operators import search as S
from corpusmill.plans.retrieval import _KB, _bm25_sql, _grams_sql, _toks, asked, kb
from corpusmill.session import materialise
from corpusmill.sources.tables import table

K = 10
# Queries in the syntax of the full-text predicate: all words, a phrase, alternatives, what must not be.
ASKED = [
    ("t1", "guardian notice"), ("t2", '"business days" petition'), ("t3", "subpoena or affidavit"), ("t4", "motion -hearing"), ("t5", '"shall first" order or petition -"calendar days"'), ("t6", "-motion"), ("t7", "  "), ("t8", "guardian and notice"),
]


def full_text(s: SparkSession, d: str) -> DataFrame:
    queries = s.createDataFrame(ASKED, "query_id string, query_text string")
    return S.full_text(queries, kb(s, d)).select("query_id", F.col("id").alias("chunk_id"))


def full_text_ranked(s: SparkSession, d: str) -> DataFrame:
    """The matches of each full-text query by BM25 over its words."""
    queries = s.createDataFrame([(q, t) for q, t in ASKED if "-" not in t], "query_id string, query_text string")
    scores = R.bm25(R.query_terms(queries), kb(s, d), None)
    hits = scores.join(S.full_text(queries, kb(s, d)), ["query_id", "id"], "left_semi")
    return R.top(hits, K).select("query_id", F.col("id").alias("chunk_id"), "score", "rank")


def indexed(s: SparkSession, d: str) -> DataFrame:
    """The rule corpus as an index: the last delivery of each chunk that is still there."""
    rows = R.latest(table(s, d, "chunks"), "chunk_id", "loaded_at", "text", "rule_title", "rule", "deleted_at", "chapter", "embedding", "citations").where("deleted_at IS NULL")
    return rows.select(F.lit("rules").alias("scope"), F.col("chunk_id").alias("id"), "text", F.coalesce("rule_title", F.lit("")).alias("heading"), F.coalesce("rule", F.lit("")).alias("rule"), "chapter", F.col("embedding").alias("vector"), "citations")


def index_of(s: SparkSession, d: str) -> DataFrame:
    """The index written once: a search reads it several times, and the last deliveries would be sorted out anew each time."""
    return materialise(indexed(s, d), "index")


def index_queries(docs: DataFrame) -> DataFrame:
    """One chunk in a hundred by its id: its title as words, its vector; every other one asks for its chapter."""
    h = F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("long")
    good = F.expr("size(vector) = 64 AND NOT exists(vector, x -> x IS NULL OR isnan(x)) AND exists(vector, x -> x <> 0)")
    return docs.where((h % 100 == 0) & good).select(F.col("id").alias("query_id"), F.col("heading").alias("query_text"), "vector", F.when(h % 200 == 0, F.col("chapter")).alias("chapter"))


def index_search(s: SparkSession, d: str) -> DataFrame:
    """Facets, both lanes, fusion, and the best chunk of each rule."""
    docs = index_of(s, d)
    return S.search(index_queries(docs), docs, K, facets=("chapter",), group="rule").withColumnRenamed("id", "chunk_id")


def verified_search(s: SparkSession, d: str) -> DataFrame:
    """As index_search, over chunks of runs whose contents were reconciled, chunk by chunk."""
    runs = table(s, d, "parse_runs").where("toc_reconciled").select("run_id")
    good = table(s, d, "chunks").where("chunk_id IS NOT NULL").join(runs, "run_id", "left_semi").select(F.col("chunk_id").alias("id"))
    docs = index_of(s, d)
    return S.search(index_queries(docs), docs, K, verified=good).withColumnRenamed("id", "chunk_id")


def hybrid_search(s: SparkSession, d: str) -> DataFrame:
    """Vectors and words, forty of each, by reciprocal ranks."""
    docs = index_of(s, d)
    q = index_queries(docs)
    lanes = {"lex": (R.bm25(R.query_terms(q), docs, 40), 1.0), "vec": (R.dense(q, docs.select("id", "vector"), 40), 1.0)}
    return R.fuse(lanes, K).select("query_id", F.col("id").alias("chunk_id"), "score", "lane", "rank")


def _cited(s: SparkSession, d: str) -> DataFrame:
    """Questions that name citations of the corpus in several ways: as they are, run together, one level too deep, by the bare rule."""
    rows = indexed(s, d).where("size(citations) > 0").select("id", F.get("citations", F.lit(0)).alias("c"), (F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("long") % 4).alias("form"))
    c = F.col("c")
    text = F.when(F.col("form") == 0, F.concat(F.lit("what does "), c, F.lit(" say"))).when(F.col("form") == 1, F.concat(F.lit("explain "), F.lower(F.regexp_replace(c, " ", "")), F.lit("?"))).when(F.col("form") == 2, F.concat(c, F.lit("(z9) please"))).otherwise(F.concat(F.lit("is rule "), F.regexp_extract(c, r"(\d+\.\d+)", 1), F.lit(" in force")))
    return rows.select(F.col("id").alias("query_id"), text.alias("query_text"))


def citation_router(s: SparkSession, d: str) -> DataFrame:
    return S.route(_cited(s, d), indexed(s, d), []).select("query_id", "citation", F.col("id").alias("chunk_id"), "step")


def engine_search(s: SparkSession, d: str) -> DataFrame:
    """The routed chunk first, then both lanes of sixty by reciprocal ranks. Every query also names its first citation."""
    docs = index_of(s, d)
    q = index_queries(docs)
    first = docs.where("size(citations) > 0").select(F.col("id").alias("query_id"), F.get("citations", F.lit(0)).alias("c"))
    q = q.join(first, "query_id").withColumn("query_text", F.concat("c", F.lit(" "), "query_text"))
    lanes = {"bm25": (R.bm25(R.query_terms(q), docs, 60), 1.0), "dense": (R.dense(q, docs.select("id", "vector"), 60), 1.0)}
    return S.placed_first(S.route(q, docs, []), R.fuse(lanes, 60), 8).select("query_id", F.col("id").alias("chunk_id"), "score", "rank")


def stemmed_topk(s: SparkSession, d: str) -> DataFrame:
    return S.stemmed_bm25(asked(s, d), kb(s, d), K).select("query_id", F.col("id").alias("chunk_id"), "score", "rank")


def of_one_rule(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the pairs (query_id, id) that are two chunks of one rule. Only pairs that were hit are looked at, never all pairs of a rule."""
    rules = docs.where("rule <> ''").select("id", "rule")
    asked = rules.join(F.broadcast(pairs.select(F.col("query_id").alias("id")).distinct()), "id", "left_semi").select(F.col("id").alias("query_id"), F.col("rule").alias("asked"))
    return pairs.where("id <> query_id").join(rules, "id").join(asked, "query_id").where("rule = asked").select("query_id", "id")


def lane_comparison(s: SparkSession, d: str) -> DataFrame:
    """How often each lane alone, and both together, find another chunk of the query's rule among the first ten: an ablation."""
    docs = index_of(s, d)
    q = index_queries(docs).drop("chapter")
    lex, vec = materialise(R.bm25(R.query_terms(q), docs, 40), "lex"), materialise(R.dense(q, docs.select("id", "vector"), 40), "vec")
    gold = of_one_rule(lex.select("query_id", "id").unionByName(vec.select("query_id", "id")).distinct(), docs)
    out = None
    for name, hits in (("bm25", lex), ("dense", vec), ("both", R.fuse({"a": (lex, 1.0), "b": (vec, 1.0)}, 40)), ("both_half", R.fuse({"a": (lex, 0.5), "b": (vec, 1.0)}, 40))):
        part = E.recall_mrr(E.first_relevant(hits.where("id <> query_id"), gold, q)).withColumn("lane", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {f.__name__: f for f in (full_text, full_text_ranked, index_search, verified_search, hybrid_search, citation_router, engine_search, stemmed_topk, lane_comparison)}

_P = "' ' || array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[\\pL\\pN_]+'), ' ') || ' '"
_HAS = lambda w: f"contains(p, ' {w} ')"
_HOLDS = {
    "t1": f"{_HAS('guardian')} AND {_HAS('notice')}", "t2": f"{_HAS('business days')} AND {_HAS('petition')}", "t3": f"({_HAS('subpoena')} OR {_HAS('affidavit')})", "t4": f"{_HAS('motion')} AND NOT {_HAS('hearing')}",
    "t5": f"{_HAS('shall first')} AND ({_HAS('order')} OR {_HAS('petition')}) AND NOT {_HAS('calendar days')}", "t8": f"{_HAS('guardian')} AND {_HAS('and')} AND {_HAS('notice')}",
}
_FULL = "ft AS (" + " UNION ALL ".join(f"SELECT '{q}' AS query_id, id FROM (SELECT id, {_P} AS p FROM kb) WHERE {c}" for q, c in _HOLDS.items()) + ")"
_USABLE = "coalesce(len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false)"
_FINITE = "coalesce(len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0, false)"
_HASH = "('0x' || left(md5(id), 8))::BIGINT"
_INDEX = f"""
ix0 AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at DESC NULLS LAST, text DESC NULLS LAST, rule_title DESC NULLS LAST, rule DESC NULLS LAST, deleted_at DESC NULLS LAST, chapter DESC NULLS LAST, embedding DESC NULLS LAST) AS rn FROM chunks WHERE chunk_id IS NOT NULL),
ix AS (SELECT chunk_id AS id, text, coalesce(rule_title, '') AS heading, coalesce(rule, '') AS rule, chapter, citations, embedding, {_FINITE} AS finite, {_USABLE} AS usable, list_transform(embedding, lambda x: x::DOUBLE) AS v, list_concat({_toks("text")}, list_concat({_toks("rule_title")}, {_toks("rule_title")})) AS toks FROM ix0 WHERE rn = 1 AND deleted_at IS NULL),
iq AS (SELECT id AS query_id, heading AS query_text, v, CASE WHEN {_HASH} % 200 = 0 THEN chapter END AS chapter FROM ix WHERE {_HASH} % 100 = 0 AND usable)"""
_IQT = f"SELECT query_id, term, count(*)::DOUBLE AS weight FROM (SELECT query_id, unnest({_toks('query_text')}) AS term FROM iq) GROUP BY ALL"
_VEC = lambda out, pool: f"""
{out} AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT q.query_id, d.id, round(list_inner_product(q.v, d.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(d.v, d.v))), 6) AS score FROM iq q, ix d WHERE d.usable) WHERE score > 0) WHERE rank <= {pool})"""  # noqa: E731


def _searched(pool: int) -> str:
    """CTEs that end in fu (query_id, id, score, lane, rank)."""
    grams = _grams_sql("g", pool).replace("FROM eval_queries)", "FROM iq)").replace("FROM kb)", "FROM ix)")
    return f"""{_INDEX}, iqt AS ({_IQT}), {_bm25_sql("b", "iqt", "ix", pool)}, {grams}, {_VEC("e", pool)},
l0 AS (SELECT query_id, id, round(coalesce(1.0 / (60 + b.rank), 0) + coalesce(0.6 / (60 + g.rank), 0), 9) AS score FROM b FULL OUTER JOIN g USING (query_id, id)),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM l0) WHERE rank <= {pool}),
f0 AS (SELECT query_id, id, round(coalesce(1.0 / (60 + l.rank), 0) + coalesce(1.0 / (60 + e.rank), 0), 9) AS score, CASE WHEN l.rank IS NULL THEN 'dense' WHEN e.rank IS NULL THEN 'bm25' ELSE 'hybrid' END AS lane FROM l FULL OUTER JOIN e USING (query_id, id)),
fu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f0) WHERE rank <= {pool})"""


_RRF = lambda out, a, b, n, wa=1.0: f"""{out} AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM
 (SELECT query_id, id, round(coalesce({wa} / (60 + {a}.rank), 0) + coalesce(1.0 / (60 + {b}.rank), 0), 9) AS score FROM {a} FULL OUTER JOIN {b} USING (query_id, id))) WHERE rank <= {n})"""  # noqa: E731
_ROUTE = lambda q: rf"""lst AS (SELECT id, unnest(citations) AS citation, unnest(range(len(citations))) AS n FROM ix), rt0 AS (SELECT query_id, regexp_extract(c, '(\d+\.\d+[A-Za-z]?)', 1) AS r, regexp_extract(c, '(\(.*)$', 1) AS g FROM {q}),
rt1 AS (SELECT query_id, 0 AS step, 'MCR ' || r || g AS k, r FROM rt0 UNION ALL SELECT query_id, 1, 'MCR ' || r, r FROM rt0 UNION ALL SELECT query_id, 2, NULL, r FROM rt0),
rt2 AS (SELECT query_id, step, l.citation, l.id, l.n FROM rt1 JOIN lst l ON (step < 2 AND l.citation = k) OR (step = 2 AND starts_with(l.citation, 'MCR ' || r || '('))),
rt AS (SELECT query_id, citation, id, step FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY step, id, n) AS x FROM rt2) WHERE x = 1)"""  # noqa: E731

ORACLE = {
    "full_text": f"WITH {_KB}, {_FULL} SELECT query_id, id AS chunk_id FROM ft",
    "full_text_ranked": f"""WITH {_KB}, {_FULL}, aq(query_id, query_text) AS (VALUES {", ".join(f"('{q}', '{t}')" for q, t in ASKED if "-" not in t)}), aterms AS (SELECT query_id, term, count(*)::DOUBLE AS weight FROM (SELECT query_id, unnest({_toks("query_text")}) AS term FROM aq) GROUP BY ALL),
{_bm25_sql("b", "aterms", "kb", 1_000_000)} SELECT * FROM (SELECT query_id, id AS chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b JOIN ft USING (query_id, id)) WHERE rank <= {K}""",
    "index_search": f"""WITH {_searched(80)}, k AS (SELECT fu.*, ix.rule FROM fu JOIN ix USING (id) JOIN iq USING (query_id) WHERE iq.chapter IS NULL OR iq.chapter = ix.chapter), g1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, rule ORDER BY rank) AS gg FROM k)
SELECT * FROM (SELECT query_id, id AS chunk_id, score, lane, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM g1 WHERE gg = 1) WHERE rank <= {K}""",
    "verified_search": f"""WITH {_searched(80)}, ok AS (SELECT DISTINCT chunk_id FROM chunks WHERE run_id IN (SELECT run_id FROM parse_runs WHERE toc_reconciled))
SELECT * FROM (SELECT query_id, id AS chunk_id, score, lane, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM fu WHERE id IN (SELECT chunk_id FROM ok WHERE chunk_id IS NOT NULL)) WHERE rank <= {K}""",
    "hybrid_search": f"""WITH {_INDEX}, iqt AS ({_IQT}), {_bm25_sql("b", "iqt", "ix", 40)}, {_VEC("e", 40)}, f0 AS (SELECT query_id, id, round(coalesce(1.0 / (60 + b.rank), 0) + coalesce(1.0 / (60 + e.rank), 0), 9) AS score, CASE WHEN b.rank IS NULL THEN 'vec' WHEN e.rank IS NULL THEN 'lex' ELSE 'lex+vec' END AS lane FROM b FULL OUTER JOIN e USING (query_id, id))
SELECT * FROM (SELECT query_id, id AS chunk_id, score, lane, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f0) WHERE rank <= {K}""",
    "citation_router": rf"""WITH {_INDEX}, cq AS (SELECT id AS query_id, CASE {_HASH} % 4 WHEN 2 THEN citations[1] || '(z9)' WHEN 3 THEN 'MCR ' || regexp_extract(citations[1], '(\d+\.\d+)', 1) WHEN 1 THEN 'MCR ' || regexp_extract(citations[1], '(\d+\.\d+)', 1) || lower(regexp_extract(citations[1], '(\(.*)$', 1)) ELSE citations[1] END AS c FROM ix WHERE len(citations) > 0),
{_ROUTE("cq")} SELECT query_id, citation, id AS chunk_id, step FROM rt""",
    "engine_search": f"""WITH {_INDEX.replace("iq AS (", "iq00 AS (")}, iq AS (SELECT query_id, citations[1] || ' ' || query_text AS query_text, iq00.v, citations[1] AS c FROM iq00 JOIN ix ON ix.id = iq00.query_id WHERE len(citations) > 0), iqt AS ({_IQT}), {_bm25_sql("b", "iqt", "ix", 60)}, {_VEC("e", 60)}, {_RRF("f", "b", "e", 60)}, {_ROUTE("iq")},
u AS (SELECT query_id, id, 1.0 AS score, 0 AS rank FROM rt UNION ALL SELECT query_id, id, score, rank FROM f WHERE NOT EXISTS (SELECT 1 FROM rt WHERE rt.query_id = f.query_id AND rt.id = f.id))
SELECT * FROM (SELECT query_id, id AS chunk_id, score::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY u.rank) AS rank FROM u) WHERE rank <= 8""",
    "lane_comparison": f"""WITH {_INDEX}, iqt AS ({_IQT}), {_bm25_sql("b", "iqt", "ix", 40)}, {_VEC("e", 40)}, {_RRF("f", "b", "e", 40)}, {_RRF("h", "b", "e", 40, 0.5)}, gold AS (SELECT a.id AS query_id, c.id FROM ix a JOIN ix c USING (rule) WHERE rule <> '' AND a.id <> c.id),
u AS (SELECT 'bm25' AS lane, query_id, id, rank FROM b UNION ALL SELECT 'dense', query_id, id, rank FROM e UNION ALL SELECT 'both', query_id, id, rank FROM f UNION ALL SELECT 'both_half', query_id, id, rank FROM h),
r AS (SELECT n.lane, q.query_id, min(u.rank) AS rank FROM iq q CROSS JOIN (SELECT DISTINCT lane FROM u) n LEFT JOIN (SELECT u.* FROM u SEMI JOIN gold g ON g.query_id = u.query_id AND g.id = u.id) u ON u.query_id = q.query_id AND u.lane = n.lane GROUP BY ALL)
SELECT lane, count(*) AS n, round(avg((coalesce(rank, 999) <= 1)::INT), 6) AS r_at_1, round(avg((coalesce(rank, 999) <= 3)::INT), 6) AS r_at_3, round(avg((coalesce(rank, 999) <= 10)::INT), 6) AS r_at_10, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM r GROUP BY lane""",
}
