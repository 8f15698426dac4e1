"""Filling containers of fixed capacity with whole items (problem 2).

Items are counted by length, so what is solved does not grow with their number: a histogram has at most as many rows
as the capacity has units. The capacity is cut into equal windows, about as long as three items. Combinations of up to
three lengths that fill a window are enumerated; non-negative least squares finds how often each has to be repeated for
all of them together to meet the histogram; the numbers are rounded and windows put together to containers. What is
left over is packed greedily, the longest first and each where the least room remains.

Items then get their containers by their rank among the items of the same length, which is counted in salted parts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from corpusmill.session import materialise

Classes = list[tuple[Counter, int]]  # what is in a container, and in how many


def combinations(lengths: np.ndarray, window: int, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (columns of three, -1 for none) of up to three lengths that fill window - slack to window, and the waste.

    For each one or two lengths the longest one is added that still fits and is no shorter than either.
    """
    d = len(lengths)
    out, waste = [], []
    one = np.flatnonzero((lengths <= window) & (lengths >= window - slack))
    out.append(np.stack([one, np.full_like(one, -1), np.full_like(one, -1)], axis=1))
    i, j = np.triu_indices(d)
    two = lengths[i] + lengths[j]
    ok = (two <= window) & (two >= window - slack)
    out.append(np.stack([i[ok], j[ok], np.full(ok.sum(), -1)], axis=1))
    k = np.searchsorted(lengths, window - two, side="right") - 1
    for step in (0, 1):  # the longest that fits, and the one before it
        kk = k - step
        ok = (kk >= j) & (two <= window)
        ok[ok] &= two[ok] + lengths[kk[ok]] >= window - slack
        out.append(np.stack([i[ok], j[ok], kk[ok]], axis=1))
    cols = np.concatenate(out)
    total = np.where(cols >= 0, lengths[cols], 0).sum(axis=1)
    waste = window - total
    return cols, waste


Problem = tuple[np.ndarray, np.ndarray, np.ndarray]  # combinations, their waste, counts of the lengths


def least_squares(problems: list[Problem], rounds: int = 300, near: float = 0.02) -> list[np.ndarray]:
    """Of each problem the x >= 0 of least |A x - counts|^2 (and a little for the waste), A having a column of ones for each combination.

    Accelerated projected gradient on all problems at once: they are blocks of one matrix, with three entries a column,
    that is never laid out. It ends when no repeat count moves by `near`, as they are rounded.
    """
    sizes = [len(p[0]) for p in problems]
    if not sum(sizes):
        return [np.zeros(n) for n in sizes]
    begin = np.cumsum([0] + [len(p[2]) for p in problems])
    d = int(begin[-1])
    at = np.concatenate([np.where(p[0] >= 0, p[0] + o, d) for p, o in zip(problems, begin, strict=False)]).ravel()
    price = 0.02 * np.concatenate([p[1] for p in problems])
    pad = np.append(np.concatenate([p[2] for p in problems]).astype(float), 0.0)
    n = len(price)
    of = np.repeat(np.arange(len(problems)), sizes)
    apply = lambda x: np.bincount(at, np.repeat(x, 3), minlength=d + 1)

    def back(r: np.ndarray) -> np.ndarray:
        r[d] = 0.0
        return r[at].reshape(n, 3).sum(axis=1)

    uses = np.bincount(at, minlength=d + 1)[:d]
    most = np.array([max(1, uses[a:b].max(initial=0)) for a, b in zip(begin[:-1], begin[1:], strict=True)])
    step = (1.0 / (3.0 * most))[of]
    x = y = np.zeros(n)
    t = 1.0
    for k in range(rounds):
        new = np.maximum(0.0, y - step * (back(apply(y) - pad) + price))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        moved = new - x
        y = new + (t - 1) / t2 * moved
        x, t = new, t2
        if k > 20 and k % 5 == 0 and np.abs(moved).max() < near:
            break
    return np.split(x, np.cumsum(sizes)[:-1])


def greedy(classes: Classes, counts: dict[int, int], capacity: int) -> Classes:
    """Best fit, longest first, of what counts holds, into the rooms of the classes and new containers.

    Containers with the same content are one class, so the work does not grow with the number of items.
    """
    rooms: dict[int, list[tuple[Counter, int]]] = {}
    for content, n in classes:
        rooms.setdefault(capacity - sum(k * v for k, v in content.items()), []).append((content, n))
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fit = min((r for r in rooms if r >= length and rooms[r]), default=None)
            if fit is None:
                each = capacity // length
                full, rest = divmod(left, each)
                for n, q in ((full, each), (1 if rest else 0, rest)):
                    if n:
                        rooms.setdefault(capacity - q * length, []).append((Counter({length: q}), n))
                break
            content, n = rooms[fit].pop()
            q = min(fit // length, left)  # as many as still fit into one
            m = min(n, left // q)
            if m < n:
                rooms[fit].append((content, n - m))
            rooms.setdefault(fit - q * length, []).append((content + Counter({length: q}), m))
            left -= m * q
    return [c for r in sorted(rooms) for c in rooms[r] if c[1]]


class Packing:
    """The containers of one histogram (lengths rising, from 1 to capacity), while they are filled."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, capacity: int):
        self.lengths, self.left, self.capacity = lengths, counts.astype(np.int64).copy(), capacity
        mean = float((lengths * counts).sum() / max(1, counts.sum()))
        self.per = max(1, int(capacity // (3 * mean)))
        self.window = capacity // self.per
        self.windows: list[tuple[Counter, int]] = []
        self.slacks = sorted({max(1, self.window // 64), max(2, self.window // 16)})
        self.one = int((lengths * counts).sum()) <= capacity  # all in one container: nothing to solve

    def problem(self, slack: int) -> Problem:
        """The combinations of what is left that fill a window but for the slack."""
        self.short = np.flatnonzero((self.lengths <= self.window) & (self.left > 0))
        self.cols, waste = combinations(self.lengths[self.short], self.window, slack)
        return self.cols, waste, self.left[self.short]

    def take(self, waste: np.ndarray, x: np.ndarray) -> None:
        """Windows by rounded repeat counts, as far as there are items."""
        times = np.floor(x + 0.5).astype(np.int64)
        for c in np.lexsort((-x, waste)):
            if times[c] < 1:
                continue
            content = Counter(self.short[self.cols[c][self.cols[c] >= 0]].tolist())
            n = min(int(times[c]), *(int(self.left[i]) // q for i, q in content.items()))
            if n > 0:
                for i, q in content.items():
                    self.left[i] -= n * q
                self.windows.append((Counter({int(self.lengths[i]): q for i, q in content.items()}), n))

    def classes(self) -> Classes:
        """Windows put together to containers, and what is left packed greedily."""
        if self.one:
            return [(Counter({int(k): int(n) for k, n in zip(self.lengths, self.left, strict=True) if n}), 1)] if self.left.any() else []
        out: Classes = []
        pool: list[Counter] = []
        for content, n in self.windows:
            if n >= self.per:
                out.append((Counter({k: v * self.per for k, v in content.items()}), n // self.per))
            pool += [content] * (n % self.per)
        for at in range(0, len(pool), self.per):
            out.append((sum(pool[at : at + self.per], Counter()), 1))
        return greedy(out, {int(k): int(n) for k, n in zip(self.lengths, self.left, strict=True) if n}, self.capacity)


def pack_histograms(histograms: list[tuple[np.ndarray, np.ndarray]], capacity: int) -> list[Classes]:
    """Containers for the items of each histogram (lengths, counts); equal ones are solved once, all of them together."""
    kinds = {(x.tobytes(), n.tobytes()): (x, n) for x, n in histograms}
    packings = {key: Packing(x, n, capacity) for key, (x, n) in kinds.items()}
    for k in range(2):
        open_ = [p for p in packings.values() if not p.one and k < len(p.slacks)]
        problems = [p.problem(p.slacks[k]) for p in open_]
        for p, (_, waste, _), x in zip(open_, problems, least_squares(problems), strict=True):
            p.take(waste, x)
    done = {key: p.classes() for key, p in packings.items()}
    return [done[x.tobytes(), n.tobytes()] for x, n in histograms]


PLAN = T.StructType(
    [T.StructField("grp", T.StringType())]
    + [T.StructField(c, T.LongType()) for c in ("length", "first_rank", "end_rank", "each", "first_container", "used")]
)


def _plan(capacity: int, together: int = 20_000):
    """Containers of groups sorted by grp and length, as many groups at a time as have about `together` rows."""
    schema = pa.schema([("grp", pa.string())] + [(f.name, pa.int64()) for f in PLAN.fields[1:]])

    def solve(groups: list[tuple[str | None, list[int], list[int]]]) -> pa.RecordBatch:
        rows = []
        for (grp, _, _), classes in zip(groups, pack_histograms([(np.array(x), np.array(n)) for _, x, n in groups], capacity), strict=True):
            base, ranks = 0, Counter()
            for content, n in classes:
                used = sum(k * v for k, v in content.items())
                for length, q in content.items():
                    rows.append((grp, length, ranks[length], ranks[length] + q * n, q, base, used))
                    ranks[length] += q * n
                base += n
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[tuple[str | None, list[int], list[int]]] = []
        held = 0
        for b in batches:
            for grp, length, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not groups or groups[-1][0] != grp:
                    if held > together:
                        yield solve(groups)
                        groups, held = [], 0
                    groups.append((grp, [], []))
                groups[-1][1].append(length)
                groups[-1][2].append(n)
                held += 1
        if groups:
            yield solve(groups)

    return run


def pack(items: DataFrame, capacity: int, salts: int = 32) -> DataFrame:
    """(grp, id, part, length, container, room): the container of every item and the room left in it.

    items: (grp string, id string, length), one row of each id; only items of one grp share a container, numbered from 0
    in each. An item of more than `capacity` is cut into parts of that size and a rest, numbered from 1; others are part
    1 and whole. Lengths that are null or below 1 count as 1; null ids are left out; a null grp is a group of its own;
    an empty table gives no rows. salts: parts in which the items of one length are counted.
    """
    spark = items.sparkSession
    length = F.greatest(F.coalesce(F.col("length").cast("long"), F.lit(1)), F.lit(1))
    rows = items.where("id IS NOT NULL").select("grp", "id", length.alias("total"))
    n_parts = F.expr(f"CAST(ceil(total / {capacity}) AS INT)")
    parts = rows.select("grp", "id", "total", F.explode(F.sequence(F.lit(1), n_parts)).alias("part"))
    parts = parts.select("grp", "id", "part", F.least(F.lit(capacity), F.col("total") - (F.col("part") - 1) * capacity).alias("length"))
    parts = materialise(parts.withColumn("salt", F.pmod(F.xxhash64("id", "part"), F.lit(salts)).cast("int")), "items")

    counts = parts.groupBy("grp", "length", "salt").agg(F.count("*").alias("n"))
    hist = counts.groupBy("grp", "length").agg(F.sum("n").alias("n"))
    # the rows are few and the work on them is not: as many tasks as other stages have, whatever their bytes
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    plan = hist.repartition(tasks, "grp").sortWithinPartitions("grp", "length").mapInArrow(_plan(capacity), PLAN)
    plan = plan.groupBy("grp", "length").agg(F.sort_array(F.collect_list(F.struct("first_rank", "end_rank", "each", "first_container", "used"))).alias("plan"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("grp", "length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("grp", "length", "salt", before.alias("before"), "n")
    # null-safe: a null group is a group
    same = lambda a, b, *on: [a[c].eqNullSafe(b[c]) for c in on]
    offsets = offsets.join(plan, same(offsets, plan, "grp", "length")).select(offsets["grp"], offsets["length"], "salt", "before", F.expr("filter(plan, p -> p.end_rank > before AND p.first_rank < before + n)").alias("plan"))
    ranked = parts.withColumn("rn", F.row_number().over(W.partitionBy("grp", "length", "salt").orderBy("id", "part")) - 1)
    placed = ranked.join(offsets, same(ranked, offsets, "grp", "length", "salt")).select(ranked["grp"], "id", "part", ranked["length"], (F.col("rn") + F.col("before")).alias("rank"), "plan")
    placed = placed.withColumn("p", F.expr("filter(plan, p -> p.first_rank <= rank AND rank < p.end_rank)[0]"))
    return placed.select("grp", "id", "part", "length", F.expr("p.first_container + (rank - p.first_rank) DIV p.each").alias("container"), (F.lit(capacity) - F.col("p.used")).alias("room"))


def estimated_tokens(text) -> F.Column:
    """floor(1.32 x words) + 1, words being runs without white space; 1 for a null or blank text."""
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\s\p{Z}]+"), lambda w: w != ""))
    return F.floor(words * 1.32).cast("long") + 1


def rule_key(rule) -> F.Column:
    """A rule number without blanks and without the words before it."""
    return F.nullif(F.regexp_replace(F.regexp_replace(rule, r"[\s\p{Z}]+", ""), r"^(?i:mcr|rule)+", ""), F.lit(""))


def body_blocks(blocks: DataFrame) -> DataFrame:
    """(grp, id, length) of the body blocks that are still there, one of each block_id, that loaded last, by rule.

    A block without a rule is a group of its own: it is combined with none.
    """
    row = F.struct("loaded_at", rule_key(F.col("rule")).alias("rule"), estimated_tokens(F.col("text")).alias("length"), "kind", "deleted_at")
    last = blocks.where("block_id IS NOT NULL").groupBy("block_id").agg(F.max(row).alias("b")).where("b.kind = 'body' AND b.deleted_at IS NULL")
    return last.select(F.coalesce("b.rule", F.concat(F.lit("block "), "block_id")).alias("grp"), F.col("block_id").alias("id"), F.col("b.length").alias("length"))


def prompt_chunks(chunks: DataFrame) -> DataFrame:
    """(grp, id, length) of the chunks that are still there, one of each chunk_id, that loaded last, in one group.

    Lengths are counted anew from embed_text, as n_tokens may be null, zero or wrong.
    """
    row = F.struct("loaded_at", estimated_tokens(F.col("embed_text")).alias("length"), "deleted_at")
    last = chunks.where("chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.max(row).alias("c")).where("c.deleted_at IS NULL")
    return last.select(F.lit("all").alias("grp"), F.col("chunk_id").alias("id"), F.col("c.length").alias("length"))
