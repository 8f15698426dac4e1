"""Structure, chunking, stems and relational queries, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusmill.functions import citations as C
from corpusmill.functions import stem as S
from corpusmill.functions import text as T
from corpusmill.operators import layout as L
from corpusmill.operators import retrieval as R
from corpusmill.operators import structure as Q
from corpusmill.plans.retrieval import _KB, POOL, _bm25_sql, _toks, asked, kb
from corpusmill.sources.tables import table


def _body(s: SparkSession, d: str) -> DataFrame:
    rows = R.latest(table(s, d, "blocks"), "block_id", "loaded_at", "rule", "marker", "depth", "subpath", "text", "kind", "deleted_at").where("kind = 'body' AND deleted_at IS NULL")
    return rows.withColumn("rule", F.regexp_replace("rule", r"[^0-9.A-Za-z]|(?i:mcr|rule)", "")).withColumn("tokens", T.estimated_tokens(F.col("text")))


def block_paths(s: SparkSession, d: str) -> DataFrame:
    return Q.assign_paths(_body(s, d))


def rule_chunks(s: SparkSession, d: str) -> DataFrame:
    return Q.chunk_rules(_body(s, d))


def markdown_chunks(s: SparkSession, d: str) -> DataFrame:
    return Q.chunk_markdown(table(s, d, "documents"))


def running_headers(s: SparkSession, d: str) -> DataFrame:
    """Pages stand for the chunks of a manual."""
    pages = table(s, d, "kb_chunks").select("doc_id", F.col("ordinal").alias("page"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL").distinct()
    return Q.running_headers(pages)


def frequent_edges(s: SparkSession, d: str) -> DataFrame:
    """First and last lines that a fiftieth of a manual's chunks share."""
    pages = table(s, d, "kb_chunks").select("doc_id", F.col("ordinal").alias("page"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL").distinct()
    return Q.running_headers(pages, 0.02)


def stems(s: SparkSession, d: str) -> DataFrame:
    terms = kb(s, d).select("id", F.explode(T.tokens(F.col("text"))).alias("term"))
    return S.stemmed(terms).groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("id").alias("df"))


def distinct_hits(s: SparkSession, d: str) -> DataFrame:
    """The ten best chunks of each query without near-duplicates among them."""
    hits = R.bm25(R.query_terms(asked(s, d)), kb(s, d), POOL).join(kb(s, d).select("id", "text"), "id")
    return Q.without_near_duplicates(hits, 10)


def compatible_text(s: SparkSession, d: str) -> DataFrame:
    """Documents that compatibility normalisation changes."""
    c = T.nfkc_udf(F.col("text"))
    return table(s, d, "documents").select("doc_id", "text", c.alias("c")).where("text <> c").select("doc_id", F.md5("c").alias("hash"))


def id_remap(s: SparkSession, d: str) -> DataFrame:
    """Passages under new chunk ids; those without one keep the old."""
    ids = table(s, d, "chunks").where("chunk_id IS NOT NULL").select("chunk_id").distinct().select("chunk_id", F.concat(F.lit("c-"), F.substring(F.sha1("chunk_id"), 1, 16)).alias("new_id"))
    rows = table(s, d, "answer_passages").join(ids, "chunk_id", "left")
    return rows.groupBy(F.coalesce("new_id", "chunk_id").alias("id")).agg(F.count("*").alias("n"))


def rechunked(s: SparkSession, d: str) -> DataFrame:
    return Q.rechunk(table(s, d, "documents"))


def canonical_questions(s: SparkSession, d: str) -> DataFrame:
    """Questions whose citation is written in another form than the corpus's."""
    rules = [r.rule for r in table(s, d, "blocks").where("kind = 'rule' AND rule RLIKE '[A-Za-z]$'").select("rule").distinct().collect()]  # numbers of rules that end in a letter
    c = C.canonical_udf(rules)(F.col("question"))
    return table(s, d, "answers").where("question IS NOT NULL").select("answer_id", "question", c.alias("canonical")).where("question <> canonical").distinct()


def variant_search(s: SparkSession, d: str) -> DataFrame:
    """Each query in two wordings, as it is and by its gold text, fused by the best score."""
    q = table(s, d, "eval_queries")
    words = F.col("gold_text")
    both = q.select("query_id", F.lit("asked").alias("variant"), "query_text").unionByName(q.select("query_id", F.lit("gold").alias("variant"), words.alias("query_text")))
    keyed = both.withColumn("query_id", F.concat_ws("|", "query_id", "variant"))
    hits = R.bm25(R.query_terms(keyed), kb(s, d), POOL)
    parts = F.split("query_id", r"\|")
    return R.fuse_variants(hits.select(parts[0].alias("query_id"), parts[1].alias("variant"), "id", "score"), 10).select("query_id", F.col("id").alias("chunk_id"), "score", "variants", "rank")


def pricing_summary(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(price), 2).alias("net"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count("*").alias("n"))


def order_lineage(s: SparkSession, d: str) -> DataFrame:
    """Seven tables: revenue by the regions of the customer and of the supplier."""
    t = lambda n: table(s, d, n)
    place = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    c, v = place.select(F.col("n_nationkey").alias("cn"), F.col("r_name").alias("customer_region")), place.select(F.col("n_nationkey").alias("sn"), F.col("r_name").alias("supplier_region"))
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.join(c, F.col("c_nationkey") == F.col("cn")).join(v, F.col("s_nationkey") == F.col("sn"))
    return rows.groupBy("customer_region", "supplier_region").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("net"), F.countDistinct("o_orderkey").alias("orders"))


def parsed_lines(s: SparkSession, d: str) -> DataFrame:
    """Blocks set as lines of a page, by type and indent, and parsed back: how many of each kind, depth and marker."""
    rows = R.latest(table(s, d, "blocks"), "block_id", "loaded_at", "kind", "chapter", "depth", "marker", "text").where("text RLIKE '[A-Za-z]' AND chapter IS NOT NULL AND kind IN ('chapter', 'rule', 'body')").where(F.col("marker").isNull() | F.col("marker").rlike(rf"^{L.LABEL}$"))
    flat = F.regexp_replace(F.regexp_replace("text", r"[\s\p{Z}]+", " "), r"^[ (]+", "")
    c = F.col("kind")
    text = F.when(c == "rule", F.concat(F.lit("Rule 1.100 "), flat)).when((c == "body") & F.col("marker").isNotNull(), F.concat("marker", F.lit(" "), flat)).otherwise(flat)
    place = F.row_number().over(W.partitionBy("chapter").orderBy("block_id"))
    x = F.element_at(F.array(*[F.lit(v) for v in (72.0, 93.6, 115.2, 136.8, 158.4)]), F.when(c == "body", F.greatest(F.least(F.coalesce("depth", F.lit(0)), F.lit(4)), F.lit(0)) + 1).otherwise(1))
    lines = rows.select(F.col("chapter").alias("doc_id"), F.lit(1).alias("page"), place.alias("line"), (place * 20.0).alias("y"), x.alias("x"), F.when(c == "chapter", 18.0).otherwise(12.0).alias("size"), (c != "body").alias("bold"), text.alias("text"))
    return L.blocks_from_lines(lines).groupBy(F.col("doc_id").alias("chapter"), "kind", "depth", "marker").agg(F.count("*").alias("n"), F.sum(F.length(F.regexp_replace("text", " ", ""))).alias("chars"))


QUERIES = {f.__name__: f for f in (block_paths, parsed_lines, rule_chunks, markdown_chunks, running_headers, frequent_edges, stems, distinct_hits, compatible_text, id_remap, rechunked, canonical_questions, variant_search, pricing_summary, order_lineage)}

ORACLE = {
    "parsed_lines": r"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY loaded_at DESC NULLS LAST, kind DESC NULLS LAST, chapter DESC NULLS LAST, depth DESC NULLS LAST, marker DESC NULLS LAST, text DESC NULLS LAST) AS rn FROM blocks WHERE block_id IS NOT NULL),
x AS (SELECT chapter, kind, CASE WHEN kind = 'body' THEN least(coalesce(depth, 0), 4) ELSE 0 END AS depth, marker, regexp_replace(regexp_replace(text, '[\s\x{0B}\pZ]+', ' ', 'g'), '^[ (]+', '') AS t FROM b WHERE rn = 1 AND regexp_matches(text, '[A-Za-z]') AND chapter IS NOT NULL AND kind IN ('chapter', 'rule', 'body') AND (marker IS NULL OR regexp_matches(marker, '^\((?:[A-Z]{1,2}|[a-z]{1,2}|\d{1,2}|[ivxl]{1,6})\)$')))
SELECT chapter, kind, depth, CASE WHEN kind = 'body' AND depth >= 1 THEN regexp_replace(marker, '[()]', '', 'g') END AS marker, count(*) AS n, sum(length(replace(CASE WHEN kind = 'rule' THEN 'Rule1.100' WHEN kind = 'body' AND marker IS NOT NULL THEN marker ELSE '' END || t, ' ', '')))::BIGINT AS chars FROM x GROUP BY ALL""",
    "variant_search": f"""WITH {_KB}, qv AS (SELECT query_id, 'asked' AS v, query_text AS t FROM eval_queries UNION ALL SELECT query_id, 'gold', gold_text FROM eval_queries),
qx AS (SELECT query_id || '|' || v AS query_id, term, count(*)::DOUBLE AS weight FROM (SELECT query_id, v, unnest({_toks("t")}) AS term FROM qv) GROUP BY ALL), {_bm25_sql("b", "qx", "kb")},
m AS (SELECT string_split(query_id, '|')[1] AS query_id, id, round(max(score), 9) AS score, count(DISTINCT string_split(query_id, '|')[2]) AS variants FROM b GROUP BY 1, 2)
SELECT * FROM (SELECT query_id, id AS chunk_id, score, variants, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM m) WHERE rank <= 10""",
    "running_headers": r"""WITH p AS (SELECT DISTINCT doc_id, ordinal, text FROM kb_chunks WHERE doc_id IS NOT NULL AND text IS NOT NULL), z AS (SELECT doc_id, count(*) AS pages FROM p GROUP BY 1 HAVING count(*) >= 3),
l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\r\n|\n|\r'), lambda x: regexp_replace(x, '^[\s\x{0B}]+|[\s\x{0B}]+$', '', 'g')), lambda x: x <> '') AS l FROM p),
e AS (SELECT doc_id, 'first' AS place, l[1] AS line FROM l WHERE len(l) > 0 UNION ALL SELECT doc_id, 'last', l[-1] FROM l WHERE len(l) > 0)
SELECT doc_id, line, place, count(*) AS n FROM e JOIN z USING (doc_id) WHERE NOT starts_with(line, '#') GROUP BY doc_id, line, place, pages HAVING count(*) >= greatest(2, floor(pages * 0.6))""",
    "frequent_edges": r"""WITH p AS (SELECT DISTINCT doc_id, ordinal, text FROM kb_chunks WHERE doc_id IS NOT NULL AND text IS NOT NULL), z AS (SELECT doc_id, count(*) AS pages FROM p GROUP BY 1 HAVING count(*) >= 3),
l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\r\n|\n|\r'), lambda x: regexp_replace(x, '^[\s\x{0B}]+|[\s\x{0B}]+$', '', 'g')), lambda x: x <> '') AS l FROM p),
e AS (SELECT doc_id, 'first' AS place, l[1] AS line FROM l WHERE len(l) > 0 UNION ALL SELECT doc_id, 'last', l[-1] FROM l WHERE len(l) > 0)
SELECT doc_id, line, place, count(*) AS n FROM e JOIN z USING (doc_id) WHERE NOT starts_with(line, '#') GROUP BY doc_id, line, place, pages HAVING count(*) >= greatest(2, floor(pages * 0.02))""",
    "id_remap": "WITH i AS (SELECT DISTINCT chunk_id, 'c-' || left(sha1(chunk_id), 16) AS new_id FROM chunks WHERE chunk_id IS NOT NULL) SELECT coalesce(new_id, p.chunk_id) AS id, count(*) AS n FROM answer_passages p LEFT JOIN i ON i.chunk_id = p.chunk_id GROUP BY 1",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem GROUP BY ALL",
    "order_lineage": """SELECT a.r_name AS customer_region, b.r_name AS supplier_region, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, count(DISTINCT o_orderkey) AS orders
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
JOIN nation x ON c_nationkey = x.n_nationkey JOIN region a ON x.n_regionkey = a.r_regionkey JOIN nation y ON s_nationkey = y.n_nationkey JOIN region b ON y.n_regionkey = b.r_regionkey GROUP BY ALL""",
}
