"""The k most similar vectors of every vector: a hash-prefix forest (problem 3).

A tree gives every vector a long string of bits, one hyperplane to a bit, the hyperplane depending on the bits so far.
Vectors sorted by their strings are a tree: those with the longest common prefix lie side by side. The hyperplanes of
the first bits are fitted on samples and split the collection into regions of bounded size, which is measured; those of
the later bits are fitted inside the region, on its own rows. In a region several strings are made of each vector;
every one is descended to the longest prefix that no more than `leaf` vectors share, ascending again, in all trees
alike, where fewer than `least` candidates came out. What the trees of a region found is improved by the neighbours of
neighbours there; what is found in all regions is merged for each vector.

Vectors are shuffled once for each coarse tree (a number that grows with the logarithm of the collection), never once
for each tree; what comes back is k neighbours a vector and coarse tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from corpusmill.session import materialise


def _halving(sample: np.ndarray, rng: np.random.Generator, most: int = 512) -> tuple[np.ndarray, float] | None:
    """A hyperplane between two groups of the sample, moved so that half of it lies on either side."""
    x = sample[rng.choice(len(sample), min(len(sample), most), replace=False)]
    i, j = rng.choice(len(x), 2, replace=False)
    a, b = x[i], x[j]
    for _ in range(5):
        side = x @ (a - b) > 0
        if side.all() or not side.any():
            break
        a, b = x[side].mean(0), x[~side].mean(0)
        a, b = a / max(np.linalg.norm(a), 1e-12), b / max(np.linalg.norm(b), 1e-12)
    w = (a - b).astype(np.float32)
    p = sample @ w
    t = float(np.median(p))
    if (p > t).any() and (p <= t).any():
        return w, t
    return None


def hash_strings(x: np.ndarray, leaf: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """One tree over x: the strings' sorted order, and where each longest prefix of at most `leaf` rows begins in it.

    Rows that no hyperplane separates are split by position, so that no prefix is shared by more than `leaf`.
    """
    order, starts, todo = np.empty(len(x), dtype=np.int64), [], [np.arange(len(x))]
    at = 0
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            starts.append(at)
            order[at : at + len(rows)] = rows
            at += len(rows)
            continue
        cut = _halving(x[rows], rng)
        if cut is None:
            half = len(rows) // 2
            todo += [rows[half:], rows[:half]]
        else:
            one = x[rows] @ cut[0] > cut[1]
            todo += [rows[one], rows[~one]]
    return order, np.array(starts, dtype=np.int64)


def _best(own: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row of sims and their values, without own column."""
    sims[np.arange(len(own)), own] = -2
    k = min(k, sims.shape[1] - 1)
    if k < 1:
        return np.empty((len(own), 0), dtype=np.int64), np.empty((len(own), 0), dtype=np.float32)
    cols = np.argpartition(sims, sims.shape[1] - k, axis=1)[:, -k:]
    return cols, np.take_along_axis(sims, cols, axis=1)


def _merge(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row of candidates, each counted once."""
    by_id = np.argsort(ids, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, by_id, 1), np.take_along_axis(sims, by_id, 1)
    sims[:, 1:][ids[:, 1:] == ids[:, :-1]] = -2
    top = np.argpartition(-sims, k - 1, axis=1)[:, :k] if sims.shape[1] > k else np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1)


def refine(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, rounds: int, part: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours improved by the neighbours of neighbours, which a forest hardly ever all misses."""
    n, k = ids.shape
    for _ in range(rounds):
        new_ids, new_sims = ids.copy(), sims.copy()
        for at in range(0, n, part):
            rows = np.arange(at, min(n, at + part))
            near = ids[rows]
            more = np.where((near < 0)[:, :, None], -1, ids[np.maximum(near, 0)]).reshape(len(rows), -1)
            more[more == rows[:, None]] = -1
            value = np.matmul(x[np.maximum(more, 0)], x[rows][:, :, None])[:, :, 0]
            value[more < 0] = -2
            new_ids[rows], new_sims[rows] = _merge(np.concatenate([near, more], axis=1), np.concatenate([sims[rows], value], axis=1), k)
        ids, sims = new_ids, new_sims
    ids[sims < -1.5] = -1
    return ids, sims


def forest_neighbours(x: np.ndarray, k: int, trees: int, leaf: int, least: int, seed: int, rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x (unit vectors) the k most similar others that a forest of `trees` finds; -1 where there are fewer."""
    n = len(x)
    ids, sims = np.full((n, k), -1, dtype=np.int64), np.full((n, k), -2, dtype=np.float32)
    for tree in range(trees if n > leaf else 1):
        order, starts = hash_strings(x, leaf, np.random.default_rng(seed * 1000 + tree))
        ends = np.append(starts[1:], n)
        s = 0
        while s < len(starts):
            e = s
            while ends[e] - starts[s] <= least and e + 1 < len(starts):  # ascend: take the next prefix in as well
                e += 1
            rows = order[starts[s] : ends[e]]
            if ends[e] - starts[s] <= least and s:  # the last prefixes ascend to what precedes them
                rows = order[max(0, ends[e] - least - 1) : ends[e]]
            block = x[rows]
            cols, found = _best(np.arange(len(rows)), block @ block.T, k)
            both = np.concatenate([ids[rows], rows[cols]], axis=1)
            value = np.concatenate([sims[rows], found], axis=1)
            # the same neighbour may come from several trees: sort by id and blank repeats
            by_id = np.argsort(both, axis=1, kind="stable")
            both, value = np.take_along_axis(both, by_id, 1), np.take_along_axis(value, by_id, 1)
            value[:, 1:][both[:, 1:] == both[:, :-1]] = -2
            top = np.argsort(-value, axis=1, kind="stable")[:, :k]
            ids[rows], sims[rows] = np.take_along_axis(both, top, 1), np.take_along_axis(value, top, 1)
            s = e + 1
    ids[sims < -1.5] = -1
    return refine(x, ids, sims, rounds) if n > leaf else (ids, sims)


STEP = 6  # bits fitted at a time
ENOUGH = 128  # rows of a sample by which a hyperplane is fitted, at least


def fit_planes(sample: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The hyperplanes (w, t) of a whole tree of that depth, level by level, each halving the sample's rows that reach it."""
    w, t, groups = [], [], [np.arange(len(sample))]
    for _ in range(depth):
        below = []
        for rows in groups:
            cut = _halving(sample[rows], rng, 512) if len(rows) > 3 else None
            if cut is None:  # too few or too equal rows: any hyperplane through their middle
                at = rng.standard_normal(sample.shape[1]).astype(np.float32)
                cut = at, float((sample[rows] if len(rows) else sample).mean(axis=0) @ at)
            w.append(cut[0])
            t.append(cut[1])
            one = sample[rows] @ cut[0] > cut[1]
            below += [rows[~one], rows[one]]
        groups = below
    return np.array(w, dtype=np.float32), np.array(t, dtype=np.float32)


class CoarseTree:
    """The first bits of one string of every vector: hyperplanes, and the regions between them as numbers from 0."""

    def __init__(self):
        self.w: list[np.ndarray] = []
        self.t: list[float] = []
        self.kids: list[list[int]] = []  # of each hyperplane: another, or ~region
        self.root, self.regions = ~0, 1
        self.above: dict[int, tuple[int, int]] = {}  # of each region: the hyperplane over it and the side

    def grow(self, region: int, w: np.ndarray, t: np.ndarray) -> None:
        """Part a region by a whole tree of hyperplanes."""
        base, inner = len(self.w), len(w)
        over = self.above.pop(region, None)
        if over is None:
            self.root = base
        else:
            self.kids[over[0]][over[1]] = base
        free = region
        for i in range(inner):
            self.w.append(w[i])
            self.t.append(float(t[i]))
            kids = []
            for side in (0, 1):
                child = 2 * i + 1 + side
                if child < inner:
                    kids.append(base + child)
                else:
                    kids.append(~free)
                    self.above[free] = base + i, side
                    free = self.regions if free == region else free + 1
            self.kids.append(kids)
        self.regions += inner

    def of(self, x: np.ndarray) -> np.ndarray:
        """The region of each row."""
        node = np.full(len(x), self.root, dtype=np.int64)
        while len(rows := np.flatnonzero(node >= 0)):
            order = rows[np.argsort(node[rows], kind="stable")]
            first = np.flatnonzero(np.append(True, node[order][1:] != node[order][:-1]))
            for part in np.split(order, first[1:]):
                at = node[part[0]]
                node[part] = np.array(self.kids[at])[(x[part] @ self.w[at] > self.t[at]).astype(np.int64)]
        return ~node


def _hashed_share(rate) -> F.Column:
    """Whether a row is in a sample of about that share, by the hash of its id."""
    return F.xxhash64("id").cast("double") / F.lit(2.0**64) + F.lit(0.5) <= rate


def _fit_region(held, seed: int, k: int):
    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        w, t = fit_planes(_stack(pdf["v"].tolist()), held.value[1][int(key[0]), int(key[1])], np.random.default_rng([seed, int(key[0]), int(key[1]), k]))
        return pd.DataFrame({"tree": [key[0]], "region": [key[1]], "w": [w.tobytes()], "t": [t.tobytes()]})

    return fit


def coarse_trees(reps: DataFrame, n: int, many: int, region: int, seed: int, rounds: int = 30) -> list[CoarseTree]:
    """Trees whose regions hold about `region` rows of reps (id, v) each, and none more than half as many again.

    The first bits are fitted on a sample by the driver, of rows in proportion to the regions they part. Then the rows of
    every region are counted; those of too many are parted further, on samples of their own rows, one task to each.
    What is collected is counts and hyperplanes, as many as there are regions.
    """
    spark = reps.sparkSession
    trees = [CoarseTree() for _ in range(many)]
    depth = min(STEP, math.ceil(math.log2(n / region)))
    want = 2 * ENOUGH * 2**depth
    sample = _stack([r.v for r in reps.where(_hashed_share(F.lit(min(1.0, want / n)))).select("v").collect()])
    for t, tree in enumerate(trees):
        tree.grow(0, *fit_planes(sample, depth, np.random.default_rng(seed * 7919 + t)))
    for k in range(rounds):
        model = spark.sparkContext.broadcast(trees)

        def count(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            total = [np.zeros(tree.regions, dtype=np.int64) for tree in model.value]
            for b in batches:
                if b.num_rows:
                    x = _stack(b.column(0).to_pylist())
                    for t, tree in enumerate(model.value):
                        total[t] += np.bincount(tree.of(x), minlength=tree.regions)
            for t, c in enumerate(total):
                some = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), t)), pa.array(some), pa.array(c[some])], names=["tree", "region", "n"])

        sizes = reps.select("v").mapInArrow(count, "tree long, region long, n long").groupBy("tree", "region").agg(F.sum("n").alias("n"))
        big = {(r["tree"], r["region"]): r["n"] for r in sizes.where(F.col("n") > int(1.5 * region)).collect()}
        if not big:
            break
        bits = {key: min(STEP, max(1, math.ceil(math.log2(size / region)))) for key, size in big.items()}
        rates = {key: min(1.0, ENOUGH * 2 ** bits[key] / size) for key, size in big.items()}
        held = spark.sparkContext.broadcast((rates, bits))

        def draw(batches: Iterator[pa.RecordBatch], model=model, held=held) -> Iterator[pa.RecordBatch]:
            rates, _ = held.value
            for b in batches:
                if not b.num_rows:
                    continue
                x, u = _stack(b.column(1).to_pylist()), b.column(0).to_numpy().astype(np.float64) / 2.0**64 + 0.5
                for t, tree in enumerate(model.value):
                    r = tree.of(x)
                    take = np.flatnonzero(u <= np.array([rates.get((t, v), -1.0) for v in r.tolist()]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(take), t)), pa.array(r[take]), b.column(1).take(pa.array(take))], names=["tree", "region", "v"])

        drawn = reps.select(F.xxhash64("id", F.lit(k)).alias("h"), "v").mapInArrow(draw, "tree long, region long, v binary")
        for r in drawn.groupBy("tree", "region").applyInPandas(_fit_region(held, seed, k), "tree long, region long, w binary, t binary").orderBy("tree", "region").collect():
            t = np.frombuffer(r["t"], dtype=np.float32)
            trees[r["tree"]].grow(r["region"], np.frombuffer(r["w"], dtype=np.float32).reshape(len(t), -1), t)
    return trees


def usable_vectors(df: DataFrame, key: str, vector: str, dim: int, latest: str | None = None) -> DataFrame:
    """(id, v): one unit vector of each key, as bytes of float32.

    Vectors that are null, of another length, all zero or hold NaN or infinity are left out. Of several rows of a
    key the one with the latest `latest` counts (of these the one with the largest vector, where they tie).
    """
    good = F.expr(f"size({vector}) = {dim} AND NOT exists({vector}, x -> x IS NULL OR isnan(x) OR abs(x) = float('inf')) AND exists({vector}, x -> x <> 0)")
    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & good)
    when = F.col(latest) if latest else F.lit(0)
    one = rows.groupBy(F.col(key).alias("id")).agg(F.max(F.struct(when.alias("w"), F.col(vector).alias("v")))["v"].alias("v"))
    return one.mapInArrow(_unit_vectors, "id string, v binary")


def _unit_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        x = _matrix(b.column(1)).astype(np.float64)
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "v"])


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1)


def _stack(values) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype=np.float32).reshape(len(values), -1)


NEIGHBOUR = T.StructType([T.StructField("id", T.StringType()), T.StructField("ids", T.ArrayType(T.StringType())), T.StructField("sims", T.ArrayType(T.DoubleType()))])


def most_similar(
    vectors: DataFrame,
    k: int = 10,
    *,
    region: int | None = None,
    coarse: int | None = None,
    trees: int | None = None,
    leaf: int = 1000,
    least: int = 100,
    seed: int = 11,
) -> DataFrame:
    """(id, neighbour, similarity): the k most similar vectors of each of `vectors` (id string, v: bytes of a unit vector).

    Approximate; the recall of these parameters is measured in the tests and the README. Equal vectors are searched
    for once and come out for each of their ids: a neighbour's place goes to its equals too, the smaller ids first, and
    a vector's own equals precede all others with a similarity of 1. Ties go to the smaller id. Fewer than k others
    give fewer rows; one vector alone gives none; an empty table gives no rows.

    region: rows of one region, about; an eighth of all from 40,000 to 120,000 if None, which is 30 MB of vectors in a
    task at most. coarse: trees of regions; with d bits 1.5 (d + 1), and 3 at least, if None; trees (24 in all, 3 at least, if None), leaf, least:
    strings made of each vector inside a region, the most vectors that share a longest prefix, candidates below which
    to ascend.
    """
    spark = vectors.sparkSession
    vectors = materialise(vectors, "vectors")
    reps = materialise(vectors.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "distinct-vectors")
    n, copied = reps.agg(F.count("*"), F.count_if(F.col("copies") > 1)).first()
    region = region or min(120_000, max(40_000, n // 8))
    depth = max(0, math.ceil(math.log2(n / region))) if n else 0
    many = coarse or (1 if depth == 0 else max(3, round(1.5 * depth + 1.5)))
    regions = 1
    if depth:
        planted = coarse_trees(reps.select("id", "v"), n, many, region, seed)
        regions = max(t.regions for t in planted)
        model = spark.sparkContext.broadcast(planted)
    total = trees or (max(3, 24 // many) if depth else 24)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _stack(b.column(1).to_pylist()) if depth else None
            for t in range(many):
                r = model.value[t].of(x) * many + t if depth else np.zeros(b.num_rows, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), b.column(0).cast(pa.string()), b.column(1)], names=["region", "id", "v"])

    def search(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names, x = pdf["id"].to_numpy(dtype=object), _stack(pdf["v"].tolist())
        ids, _ = forest_neighbours(x, k, total, leaf, least, seed + int(key[0]))
        out_ids, out_sims = [], []
        for i, row in enumerate(ids):
            row = row[row >= 0]
            out_ids.append(names[row])
            # the same sum in the same order for either direction and in any region
            out_sims.append((x[row].astype(np.float64) * x[i]).sum(axis=1))
        return pd.DataFrame({"id": names, "ids": out_ids, "sims": out_sims})

    placed = reps.select("id", "v").mapInArrow(assign, "region int, id string, v binary")
    # one region to a partition: what a task reads is a region, however many there are
    placed = placed.repartitionById(regions * many, F.col("region")) if depth else placed
    found = placed.groupBy("region").applyInPandas(search, NEIGHBOUR)
    pairs = found.groupBy("id").agg(F.flatten(F.collect_list(F.arrays_zip(F.expr("transform(sims, x -> -x)").alias("s"), F.col("ids").alias("i")))).alias("all"))
    best = F.slice(F.array_sort(F.array_distinct("all")), 1, k)
    near = pairs.select(F.col("id").alias("rep"), F.inline(best).alias("s", "near")).select("rep", "near", (-F.col("s")).alias("similarity"))
    if not copied:
        return near.select(F.col("rep").alias("id"), F.col("near").alias("neighbour"), "similarity")
    return _expand(near, vectors.join(reps.where("copies > 1").select("v", F.col("id").alias("rep")), "v").select("id", "rep"), k)


def _expand(near: DataFrame, copies: DataFrame, k: int) -> DataFrame:
    """Neighbours of representatives to neighbours of every id. copies: (id, rep) of classes of equal vectors.

    k places hold at most the k + 1 smallest ids of a class, so no class is paired with itself beyond those.
    """
    place = F.row_number().over(W.partitionBy("rep").orderBy("id"))
    first = materialise(copies.withColumn("place", place).where(F.col("place") <= k + 1).drop("place"), "equal-vectors")
    near = near.join(first.select(F.col("rep").alias("near"), "id"), "near", "left").select("rep", F.coalesce("id", "near").alias("neighbour"), "similarity")
    near = near.unionByName(first.select("rep", F.col("id").alias("neighbour"), F.lit(1.0).alias("similarity")))
    rank = F.row_number().over(W.partitionBy("rep").orderBy(F.desc("similarity"), "neighbour"))
    near = near.withColumn("n", rank).where(F.col("n") <= k + 1)
    # the k + 1 first serve all ids of a class; the id itself is left out of them
    all_ids = near.join(copies, "rep", "left").select(F.coalesce("id", "rep").alias("id"), "neighbour", "similarity", "n").where("id <> neighbour")
    sole = F.row_number().over(W.partitionBy("id").orderBy("n"))
    return all_ids.withColumn("place", sole).where(F.col("place") <= k).select("id", "neighbour", "similarity")


def mutual(neighbours: DataFrame, least: float) -> DataFrame:
    """(id_a, id_b, similarity) of ids that are among each other's neighbours with at least that similarity; a < b."""
    near = neighbours.where(F.col("similarity") >= F.lit(least) - F.lit(1e-9))
    pair = near.groupBy(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b"))
    return pair.agg(F.count("*").alias("n"), F.max("similarity").alias("similarity")).where("n = 2").drop("n")
