"""Scans of the corpus tables. Columns are pruned at the scan by the select that follows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "blocks", "chunks", "kb_chunks", "answers", "answer_passages", "answer_citations", "eval_queries", "mix_targets", "parse_runs",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data folder; each is a Parquet file or folder of that name."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
