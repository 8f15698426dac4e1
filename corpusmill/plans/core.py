"""Registered queries outside llm: name -> (spark, sf_dir) -> DataFrame, and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.operators import references
from corpusmill.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_references(references.answer_log_references(*(table(spark, d, t) for t in ("answer_passages", "answer_citations", "chunks", "blocks"))))


QUERIES: dict[str, Query] = {
    "p5_found": lambda s, d: references.orphans_found(_orphans(s, d)),
    "p5_by_month": lambda s, d: references.orphans_by_month(_orphans(s, d)),
}

_ORPHANS_SQL = r"""
WITH r AS (
  SELECT 'answer_passages' AS ref_table, answer_id, chunk_id AS ref_key, chunk_id AS k, recorded_at FROM answer_passages WHERE chunk_id IS NOT NULL
  UNION ALL
  SELECT 'answer_citations', answer_id, citation,
         regexp_replace(regexp_replace(citation, '[\s\x{85}\x{1c}-\x{1f}\pZ]+', '', 'g'), '^(?i:mcr)', ''), recorded_at
  FROM answer_citations WHERE citation IS NOT NULL),
p AS (
  SELECT 'answer_passages' AS ref_table, chunk_id AS k, loaded_at, deleted_at FROM chunks WHERE chunk_id IS NOT NULL
  UNION ALL
  SELECT 'answer_citations', regexp_replace(regexp_replace(citation, '[\s\x{85}\x{1c}-\x{1f}\pZ]+', '', 'g'), '^(?i:mcr)', ''), loaded_at, deleted_at
  FROM blocks WHERE citation IS NOT NULL),
j AS (
  SELECT r.ref_table, r.answer_id, r.ref_key, r.recorded_at, count(p.k) AS n,
         count(*) FILTER (WHERE p.loaded_at <= r.recorded_at AND (p.deleted_at IS NULL OR p.deleted_at > r.recorded_at)) AS there,
         min(p.loaded_at) AS first_load, row_number() OVER () AS rn
  FROM (SELECT *, row_number() OVER () AS id FROM r) r LEFT JOIN p USING (ref_table, k)
  GROUP BY r.ref_table, r.answer_id, r.ref_key, r.recorded_at, r.id),
o AS (
  SELECT ref_table, answer_id, ref_key, recorded_at,
         CASE WHEN n = 0 THEN 'missing' WHEN first_load IS NULL OR first_load > recorded_at THEN 'late' ELSE 'deleted' END AS reason
  FROM j WHERE n = 0 OR (there = 0 AND recorded_at IS NOT NULL))
"""

ORACLE: dict[str, str] = {
    "p5_found": _ORPHANS_SQL + "SELECT DISTINCT ref_table, answer_id, ref_key, reason FROM o",
    "p5_by_month": _ORPHANS_SQL + "SELECT ref_table, strftime(recorded_at, '%Y-%m') AS month, reason, count(*) AS n_rows, count(DISTINCT ref_key) AS n_keys FROM o GROUP BY ALL",
}
