"""Ranking metrics, paired tests and slices."""

from __future__ import annotations

import math
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def first_relevant(hits: DataFrame, gold: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, rank): the rank of the first hit in gold (query_id, id), null where none is."""
    found = hits.join(gold, ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return queries.select("query_id").distinct().join(found, "query_id", "left")


def recall_mrr(ranks: DataFrame, ks: tuple[int, ...] = (1, 3, 10), by: list[str] | None = None) -> DataFrame:
    """n, r_at_k and mrr over (query_id, rank null if not found); with `by` for all queries and each of its columns' values, by grouping sets."""
    measures = [F.count("*").alias("n"), *[F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"r_at_{k}") for k in ks], F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr")]
    if not by:
        return ranks.agg(*measures)
    return ranks.groupingSets([[]] + [[F.col(c)] for c in by], *by).agg(*measures)


def ndcg(hits: DataFrame, gold: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, ndcg) at k, relevance being membership in gold (query_id, id)."""
    sizes = gold.groupBy("query_id").agg(F.countDistinct("id").alias("relevant"))
    hit = hits.where(F.col("rank") <= k).join(gold.select("query_id", "id").distinct(), ["query_id", "id"], "left_semi")
    got = hit.groupBy("query_id").agg(F.count("*").alias("found"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    rows = queries.select("query_id").distinct().join(sizes, "query_id").join(got, "query_id", "left")
    return rows.select("query_id", F.round(F.coalesce("found", F.lit(0)) / F.col("relevant"), 6).alias("recall"), F.round(F.coalesce("dcg", F.lit(0.0)) / ideal, 6).alias("ndcg"))


def mcnemar(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """One row (n, only_a, only_b, p_value): the exact two-sided test on hits within k of two runs (query_id, rank)."""
    hit = lambda c: F.coalesce(F.col(c) <= k, F.lit(False))
    both = a.select("query_id", F.col("rank").alias("ra")).join(b.select("query_id", F.col("rank").alias("rb")), "query_id")
    counts = both.agg(F.count("*").alias("n"), F.count_if(hit("ra") & ~hit("rb")).alias("only_a"), F.count_if(~hit("ra") & hit("rb")).alias("only_b"))
    total, low = F.col("only_a") + F.col("only_b"), F.least("only_a", "only_b")
    # log-binomials: the sum of ln over the factors keeps large counts finite
    log_choose = lambda i: F.aggregate(F.sequence(F.lit(1), F.greatest(i, F.lit(1))), F.lit(0.0), lambda s, j: s + F.when(i >= 1, F.log((total - j + 1) / j)).otherwise(0.0))
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), low), F.lit(0.0), lambda s, i: s + F.exp(log_choose(i) - total * math.log(2)))
    return counts.withColumn("p_value", F.when(total == 0, 1.0).otherwise(F.round(F.least(F.lit(1.0), 2 * tail), 6)))


def bootstrap(pairs: DataFrame, draws: int = 20_000, seed: int = 1, blocks: int = 64) -> DataFrame:
    """One row (n, mean, low, high): the mean difference of (query_id, a, b) and its 95 % interval by resampling.

    Each pair's number of draws in a resample is Poisson. Pairs are put into blocks by the hash of their id and a block
    has one generator, so blocks are resampled on their own, whatever the partitions, and only their sums meet.
    """

    def block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rng, d = np.random.default_rng([seed, int(key[0])]), pdf.sort_values(["h", "d"])["d"].to_numpy()
        total, count = np.zeros(draws), np.zeros(draws)
        for at in range(0, len(d), 256):
            part = d[at : at + 256]
            times = rng.poisson(1.0, (len(part), draws))
            total += part @ times
            count += times.sum(axis=0)
        return pd.DataFrame({"draw": np.arange(draws), "total": total, "count": count, "n": len(d), "s": d.sum()})

    rows = pairs.select(F.xxhash64("query_id").alias("h"), (F.col("a") - F.col("b")).alias("d")).where("d IS NOT NULL")
    sums = rows.groupBy(F.pmod("h", F.lit(blocks)).alias("block")).applyInPandas(block, "draw int, total double, count double, n long, s double")
    means = sums.groupBy("draw").agg((F.sum("total") / F.greatest(F.sum("count"), F.lit(1.0))).alias("mean"), F.sum("n").alias("n"), F.sum("s").alias("s"))
    at = lambda f: F.element_at("m", int(f * draws) + 1)
    return means.agg(F.max("n").alias("n"), (F.max("s") / F.greatest(F.max("n"), F.lit(1))).alias("mean"), F.array_sort(F.collect_list("mean")).alias("m")).select("n", "mean", at(0.025).alias("low"), at(0.975).alias("high"))


def nth_of_sorted(df: DataFrame, value: str, fractions: dict[str, float], by: list[str]) -> DataFrame:
    """(by..., n, one column for each fraction, max): element int(fraction x n) of the sorted values of each group, without interpolation.

    Equal values are counted first; the elements are found in the running counts of distinct values, so that no task
    sorts the rows of a group.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    w = W.partitionBy(*by)
    upto = counts.withColumn("upto", F.sum("c").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("n", F.sum("c").over(w))
    at = [F.min(F.when(F.col("upto") > F.floor(F.col("n") * f), F.col(value))).alias(name) for name, f in fractions.items()]
    return upto.groupBy(*by).agg(F.max("n").alias("n"), *at, F.max(value).alias("max"))
