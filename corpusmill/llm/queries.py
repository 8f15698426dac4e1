"""Registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import encoding, leakage, mixing, near_duplicates, neighbours, packing, pairs, splitting
from corpusmill.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _similar(s: SparkSession, d: str) -> DataFrame:
    return neighbours.most_similar(neighbours.usable_vectors(table(s, d, "chunks"), "chunk_id", "embedding", 64, "loaded_at"))


def _chunk_texts(s: SparkSession, d: str) -> DataFrame:
    return near_duplicates.texts(table(s, d, "chunks"), "chunk_id", "text", "chunks").unionByName(near_duplicates.texts(table(s, d, "kb_chunks"), "chunk_id", "text", "kb_chunks"))


def _similar_in_a_forest(s: SparkSession, d: str) -> DataFrame:
    """As p3_found, with regions and leaves so small that even small tables are searched by the forest."""
    near = neighbours.most_similar(neighbours.usable_vectors(table(s, d, "chunks"), "chunk_id", "embedding", 64, "loaded_at"), region=250, coarse=8, leaf=100, least=60)
    return neighbours.mutual(near, 0.95).selectExpr("id_a AS chunk_id_a", "id_b AS chunk_id_b")


def _packing_check(s: SparkSession, d: str) -> DataFrame:
    """Of each group of both packings its items, their tokens, and the containers that are over-full or say a wrong room."""
    both = None
    for name, items, capacity in (("blocks", packing.body_blocks(table(s, d, "blocks")), 512), ("prompts", packing.prompt_chunks(table(s, d, "chunks")), 4096)):
        full = packing.pack(items, capacity).groupBy("grp", "container").agg(F.sum("length").alias("n"), F.max("room").alias("room"), F.min("room").alias("least"), F.count_if(F.col("part") == 1).alias("items"))
        wrong = F.count_if((F.col("n") > capacity) | (F.col("n") + F.col("room") != capacity) | (F.col("room") != F.col("least")))
        part = full.groupBy("grp").agg(F.sum("items").alias("n_items"), F.sum("n").alias("tokens"), wrong.alias("wrong")).withColumn("packing", F.lit(name))
        both = part if both is None else both.unionByName(part)
    return both


def _mix_check(s: SparkSession, d: str) -> DataFrame:
    """Of each target its relative share, and the documents used too often, of another source, or not summed up in its share."""
    selection, shares = mixing.mix(table(s, d, "documents"), table(s, d, "mix_targets"))
    own = table(s, d, "documents").select("doc_id", mixing.source_key(F.col("source")).alias("own"))
    got = selection.join(own, "doc_id").groupBy("mix_name", "source").agg(F.max("times").alias("times"), F.sum(F.col("times") * F.col("n_tokens")).alias("sum"), F.count_if(~F.col("own").eqNullSafe(F.col("source"))).alias("foreign"))
    rows = shares.join(got, ["mix_name", "source"], "left")
    wrong = F.coalesce("foreign", F.lit(0)) + F.when(F.coalesce("times", F.lit(0)) > F.col("max_repeats"), 1).otherwise(0) + F.when(F.coalesce("sum", F.lit(0)) != F.col("tokens"), 1).otherwise(0)
    return rows.select("mix_name", "source", F.round("target_share", 9).alias("target_share"), wrong.cast("long").alias("wrong"))


def _whole_leaks(s: SparkSession, d: str) -> DataFrame:
    """Items of which a document holds every word, unchanged."""
    sizes = table(s, d, "eval_queries").select("query_id", F.size(F.regexp_extract_all(F.lower("gold_text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))).alias("n")).distinct()
    return _leaks(s, d).where("edits = 0").join(sizes, "query_id").where("words = n").select("doc_id", "query_id")


def _near_duplicates(s: SparkSession, d: str) -> DataFrame:
    return near_duplicates.id_pairs(*near_duplicates.near_duplicate_sets(_chunk_texts(s, d), 0.6), expand=None).selectExpr("id_a AS chunk_id_a", "id_b AS chunk_id_b")


def _near_duplicate_groups(s: SparkSession, d: str) -> DataFrame:
    return near_duplicates.groups(*near_duplicates.near_duplicate_sets(_chunk_texts(s, d), 0.6)).selectExpr("space AS corpus", "id AS chunk_id", "group_id", "links")


def _leaks(s: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(s, d, "documents"), table(s, d, "eval_queries"))


def _mix(s: SparkSession, d: str, part: int) -> DataFrame:
    return mixing.mix(table(s, d, "documents"), table(s, d, "mix_targets"))[part]


QUERIES: dict[str, Query] = {
    "p1_found": lambda s, d: pairs.defective_pairs(table(s, d, "answers")),
    "p1_by_defect": lambda s, d: pairs.defective_pairs(table(s, d, "answers")).groupBy("defect").agg(F.count("*").alias("n_answers")),
    "p2_blocks": lambda s, d: packing.pack(packing.body_blocks(table(s, d, "blocks")), 512).selectExpr("grp AS rule", "id AS block_id", "part", "length AS n_tokens", "container", "room"),
    "p2_prompts": lambda s, d: packing.pack(packing.prompt_chunks(table(s, d, "chunks")), 4096).selectExpr("id AS chunk_id", "part", "length AS n_tokens", "container", "room"),
    "p3_similar": lambda s, d: _similar(s, d).selectExpr("id AS chunk_id", "neighbour", "similarity"),
    "p3_found": lambda s, d: neighbours.mutual(_similar(s, d), 0.95).selectExpr("id_a AS chunk_id_a", "id_b AS chunk_id_b"),
    "p3_forest": _similar_in_a_forest,
    "p2_check": _packing_check,
    "p7_whole": _whole_leaks,
    "p8_check": _mix_check,
    "p4_found": lambda s, d: splitting.cut_levels(splitting.split_oversized(table(s, d, "kb_chunks"))),
    "p4_pieces": lambda s, d: splitting.split_oversized(table(s, d, "kb_chunks")),
    "p6_found": _near_duplicates,
    "p6_groups": _near_duplicate_groups,
    "p7_found": lambda s, d: _leaks(s, d).select("doc_id", "query_id"),
    "p7_leaks": lambda s, d: _leaks(s, d),
    "p7_by_item": lambda s, d: _leaks(s, d).groupBy("query_id").agg(F.count("*").alias("n_documents"), F.max("words").alias("longest")),
    "p8_selection": lambda s, d: _mix(s, d, 0),
    "p8_shares": lambda s, d: _mix(s, d, 1),
    "p9_found": lambda s, d: encoding.restore_encoding(table(s, d, "documents")).select("doc_id").distinct(),
    "p9_restored": lambda s, d: encoding.restore_encoding(table(s, d, "documents")),
}

_WHITE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\pZ]+"
_LINE_END = r"(\x{E000}\x{E001}|\n|\r)"


def _longest(parts: str) -> str:
    return f"coalesce(list_max(list_transform({parts}, lambda x: length(x))), 0) <= 1500"


def _words_sql(c: str) -> str:
    """The words of a text as leakage.words_of() has them, with blanks between and around."""
    t = rf"regexp_replace({c}, '(?s)<!--.*?-->|</?[A-Za-z][^<>]{{0,200}}>|&(?:nbsp|amp|lt|gt|quot|#\d+|#x[0-9a-fA-F]+);', ' ', 'g')"
    t = rf"regexp_replace({t}, '([\pL\pN_])-[ \t]*(?:\r\n|\n|\r)[ \t]*([\pL\pN_])', '\1\2', 'g')"
    t = rf"regexp_replace({t}, '[*_`~\x{{AD}}\x{{200B}}-\x{{200D}}\x{{FEFF}}]+', '', 'g')"
    return rf"' ' || array_to_string(regexp_extract_all(lower({t}), '[\pL\pN]+'), ' ') || ' '"


_TOKENS = lambda c: rf"floor(len(list_filter(regexp_split_to_array(coalesce({c}, ''), '[\s\x{{0B}}\pZ]+'), lambda w: w <> '')) * 1.32)::BIGINT + 1"
_KEY = r"nullif(regexp_replace(regexp_replace(rule, '[\s\x{0B}\pZ]+', '', 'g'), '^(?i:mcr|rule)+', ''), '')"
_SOURCE = lambda c: rf"regexp_replace(regexp_replace(lower({c}), '^[\s\x{{0B}}\pZ_-]+|[\s\x{{0B}}\pZ_-]+$', '', 'g'), '[\s\x{{0B}}\pZ_-]+', '_', 'g')"

ORACLE: dict[str, str] = {
    # exact where one longest prefix holds all vectors, as on small tables; beyond that the index is approximate
    "p3_found": """
WITH c AS (SELECT chunk_id, arg_max(embedding, loaded_at) AS e FROM chunks WHERE chunk_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = 64
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY chunk_id),
u AS (SELECT chunk_id, list_transform(e, lambda x: x::DOUBLE) AS v FROM c),
p AS (SELECT a.chunk_id AS a, b.chunk_id AS b, list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v)) / sqrt(list_inner_product(b.v, b.v)) AS s FROM u a JOIN u b ON a.chunk_id <> b.chunk_id),
t AS (SELECT a, b, s FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(s, 6) DESC, b) AS r FROM p) WHERE r <= 10)
SELECT x.a AS chunk_id_a, x.b AS chunk_id_b FROM t x JOIN t y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b AND x.s >= 0.95""",
    "p4_found": rf"""
WITH c AS (SELECT DISTINCT chunk_id, replace(text, chr(13) || chr(10), chr(57344) || chr(57345)) AS t FROM kb_chunks WHERE length(text) > 1500),
p AS (SELECT *, regexp_split_to_array(t, '{_LINE_END}([ \t]*{_LINE_END})+') AS p FROM c),
l AS (SELECT *, flatten(list_transform(p, lambda x: regexp_split_to_array(x, '{_LINE_END}'))) AS l FROM p),
s AS (SELECT *, flatten(list_transform(l, lambda x: string_split(regexp_replace(x, '([.?!;]){_WHITE}', '\1' || chr(57346), 'g'), chr(57346)))) AS s FROM l),
w AS (SELECT *, flatten(list_transform(s, lambda x: regexp_split_to_array(x, '{_WHITE}'))) AS w FROM s)
SELECT DISTINCT chunk_id, CASE WHEN {_longest("p")} THEN 'paragraph' WHEN {_longest("l")} THEN 'line' WHEN {_longest("s")} THEN 'sentence' WHEN {_longest("w")} THEN 'word' ELSE 'none' END AS cut_at FROM w""",
    "p6_found": r"""
WITH t AS (SELECT DISTINCT 'c' AS k, chunk_id, text FROM chunks WHERE chunk_id IS NOT NULL UNION ALL SELECT DISTINCT 'k', chunk_id, text FROM kb_chunks WHERE chunk_id IS NOT NULL),
w AS (SELECT k, chunk_id, text, regexp_extract_all(lower(text), '[\pL\pN]+') AS w FROM t),
g AS (SELECT k, chunk_id, text, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 20),
i AS (SELECT k, row_number() OVER () AS n, chunk_id, len(g) AS z, g FROM g), x AS (SELECT k, n, chunk_id, z, unnest(g) AS s FROM i),
o AS (SELECT a.chunk_id AS a, b.chunk_id AS b, any_value(a.z) AS za, any_value(b.z) AS zb, count(*) AS c FROM x a JOIN x b ON a.k = b.k AND a.s = b.s AND a.chunk_id < b.chunk_id GROUP BY a.k, a.n, b.n, a.chunk_id, b.chunk_id)
SELECT DISTINCT a AS chunk_id_a, b AS chunk_id_b FROM o WHERE c >= 0.6 * (za + zb - c) - 1e-9""",
    "p2_check": f"""
WITH b AS (SELECT block_id, {_KEY} AS rk, {_TOKENS("text")} AS n, kind, deleted_at, loaded_at FROM blocks WHERE block_id IS NOT NULL),
b1 AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY loaded_at DESC NULLS LAST, rk DESC NULLS LAST, n DESC, kind DESC NULLS LAST, deleted_at DESC NULLS LAST) AS r FROM b),
c AS (SELECT chunk_id, {_TOKENS("embed_text")} AS n, deleted_at, loaded_at FROM chunks WHERE chunk_id IS NOT NULL),
c1 AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at DESC NULLS LAST, n DESC, deleted_at DESC NULLS LAST) AS r FROM c)
SELECT 'blocks' AS packing, coalesce(rk, 'block ' || block_id) AS grp, count(*) AS n_items, sum(n)::BIGINT AS tokens, 0::BIGINT AS wrong FROM b1 WHERE r = 1 AND kind = 'body' AND deleted_at IS NULL GROUP BY 1, 2
UNION ALL SELECT 'prompts', 'all', count(*), sum(n)::BIGINT, 0 FROM c1 WHERE r = 1 AND deleted_at IS NULL""",
    "p7_whole": f"""
WITH g AS (SELECT DISTINCT query_id, {_words_sql("gold_text")} AS w FROM eval_queries WHERE query_id IS NOT NULL AND gold_text IS NOT NULL), d AS (SELECT DISTINCT doc_id, {_words_sql("text")} AS w FROM documents WHERE text IS NOT NULL)
SELECT DISTINCT doc_id, query_id FROM d JOIN g ON contains(d.w, g.w) WHERE len(string_split(trim(g.w), ' ')) >= 20""",
    "p8_check": f"""
WITH t AS (SELECT mix_name, {_SOURCE("source")} AS source, sum(greatest(coalesce(target_share, 0), 0)) AS s FROM mix_targets WHERE mix_name IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2)
SELECT mix_name, source, round(s / sum(s) OVER (PARTITION BY mix_name), 9) AS target_share, 0::BIGINT AS wrong FROM t""",
}
ORACLE["p3_forest"] = ORACLE["p3_found"]
