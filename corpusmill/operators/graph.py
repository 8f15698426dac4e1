"""The cross-reference graph of a rule corpus: a typed edge table and its one-hop joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusmill.functions import citations as C


def mentions(blocks: DataFrame) -> DataFrame:
    """(block_id, citation, rule, n, cited_rule, groups, before): each citation in each block, with the 90 characters before it.

    blocks: block_id, citation, rule, text. The text between citations is had by splitting at them, so that each
    mention sees what precedes it.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    found = C.cited_rules(t)
    between = F.split(t, C.CITE)
    rows = blocks.select("block_id", "citation", "rule", "text", F.posexplode(found).alias("n", "m"), between.alias("between"))
    return rows.select("block_id", "citation", "rule", "n", F.col("m.rule").alias("cited_rule"), F.col("m.groups").alias("groups"), F.expr("right(between[n], 90)").alias("before"))


def resolve(cited: DataFrame, valid: DataFrame) -> DataFrame:
    """`cited` with target: the longest prefix of (cited_rule, groups) that is a citation in valid; none, no row."""
    steps = cited.select("*", F.posexplode(C.prefixes(F.col("cited_rule"), F.col("groups"))).alias("step", "candidate"))
    hit = steps.join(valid.select(F.col("citation").alias("candidate")).distinct(), "candidate")
    best = F.row_number().over(W.partitionBy("block_id", "n").orderBy("step"))
    return hit.withColumn("best", best).where("best = 1").withColumnRenamed("candidate", "target").drop("best", "step")


def edges(blocks: DataFrame) -> DataFrame:
    """(src, src_rule, dst, dst_rule, relation, force): distinct by (src, dst, relation).

    blocks: body blocks with a citation. References of a rule to itself and to rules that no block has are dropped.
    """
    rules = blocks.where("rule IS NOT NULL").select(F.col("rule").alias("cited_rule")).distinct()
    cited = mentions(blocks).where("citation IS NOT NULL AND NOT (cited_rule <=> rule)").join(rules, "cited_rule")
    name, force = C.relation(F.col("before"))
    found = resolve(cited, blocks.where("citation IS NOT NULL").select("citation"))
    return found.select(F.col("citation").alias("src"), F.col("rule").alias("src_rule"), F.col("target").alias("dst"), F.col("cited_rule").alias("dst_rule"), name.alias("relation"), force.alias("force")).groupBy("src", "dst", "relation").agg(F.min("src_rule").alias("src_rule"), F.min("dst_rule").alias("dst_rule"), F.min("force").alias("force"))


def expand(shown: DataFrame, graph: DataFrame, limit: int = 3) -> DataFrame:
    """(query_id, citation, rule, force, way): what binds the shown citations and is not shown itself.

    shown: (query_id, citation, rule). Outward along all relations but 'refers'; inward along those that override or
    except a shown rule, half a step before the others.
    """
    out = shown.join(graph.where("relation <> 'refers'"), shown["citation"] == graph["src"]).select("query_id", F.col("dst").alias("found"), F.col("dst_rule").alias("found_rule"), F.col("force").cast("double").alias("force"), F.lit("out").alias("way"))
    into = shown.select("query_id", "rule").distinct().join(graph.where("relation IN ('overrides', 'excepts')"), F.col("rule") == F.col("dst_rule")).select("query_id", F.col("src").alias("found"), F.col("src_rule").alias("found_rule"), (F.col("force") - 0.5).alias("force"), F.lit("in").alias("way"))
    best = F.row_number().over(W.partitionBy("query_id", "found").orderBy("force", "way"))
    new = out.unionByName(into).join(shown.select("query_id", F.col("citation").alias("found")), ["query_id", "found"], "left_anti").withColumn("b", best).where("b = 1")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("force", "found"))
    return new.withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", F.col("found").alias("citation"), F.col("found_rule").alias("rule"), "force", "way", "rank")
