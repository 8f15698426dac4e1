"""Mixing sources to target weights (problem 8).

Each source of a mix gets a quota of tokens, and each of its documents the same expected number of uses: the quota
over the source's tokens. The whole part of it is certain; the fraction is an inclusion probability, and the cube
method draws the sample: the vector of probabilities moves in the null space of the constraints, here the tokens and
the number of documents drawn, until it meets a face of the cube, again and again. Of every block of documents at most
two stay undecided; these come together and move on, until two of a source are left to land where the totals are
nearest.

Blocks are bounded in size, so that a source that holds most documents is worked on in many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.session import materialise

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def source_key(source: Column) -> Column:
    """One spelling of a source: small letters, words joined by underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(source), r"^[\s\p{Z}_-]+|[\s\p{Z}_-]+$", ""), r"[\s\p{Z}_-]+", "_")


def token_counts(documents: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens) under a tokenizer file of the tokenizers library; 0 for a null or empty text.

    The file has to be at that path on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.encode_special_tokens = True
        for b in batches:
            n: list[int] = []
            texts = [x or "" for x in b.column(2).to_pylist()]
            for at in range(0, len(texts), 200):
                n += [len(e.ids) for e in t.encode_batch_fast(texts[at : at + 200], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    rows = documents.where("doc_id IS NOT NULL").select("doc_id", source_key(F.col("source")).alias("source"), "text")
    return rows.mapInArrow(run, "doc_id long, source string, n_tokens long").where("source IS NOT NULL")


def quotas(targets: list[tuple[str, str, float, int]], totals: dict[str, int], budgets: dict[str, int] | None, least_fill: float) -> list[tuple[str, str, float, float, int]]:
    """(mix_name, source, relative share, expected uses of each document, max_repeats).

    Without a budget a mix is as large as it can be with every source of it that is there meeting its share, but
    no less than least_fill of the tokens of its sources; a source that is too small then is used max_repeats times.
    """
    out = []
    for mix in sorted({t[0] for t in targets}):
        own = [t for t in targets if t[0] == mix]
        total = sum(t[2] for t in own if t[2] > 0)
        there = [t for t in own if totals.get(t[1], 0) > 0 and t[2] > 0 and t[3] > 0]
        held = sum(t[2] for t in there)
        if there:
            natural = sum(totals[t[1]] for t in there)
            size = min(t[3] * totals[t[1]] * held / t[2] for t in there)
            size = (budgets or {}).get(mix) or max(size, least_fill * natural)
        for _, source, share, most in own:
            tokens = totals.get(source, 0)
            usable = tokens > 0 and share > 0 and most > 0
            uses = min(float(most), size * share / held / tokens) if usable else 0.0
            out.append((mix, source, share / total if total and share > 0 else 0.0, uses, most))
    return out


def flight(p: np.ndarray, tokens: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities moved to the faces of the cube, keeping their sum and that of tokens; at most two stay fractions.

    Three undecided units at a time: with two constraints they have a null space of one dimension.
    """
    p, t = p.tolist(), tokens.tolist()
    draw = rng.random(len(p) + 3).tolist()
    active: list[int] = []
    eps = 1e-9
    for k in range(len(p)):
        if not eps < p[k] < 1 - eps:
            p[k] = float(round(p[k]))
            continue
        active.append(k)
        if len(active) < 3:
            continue
        i, j, m = active
        u = (t[m] - t[j], t[i] - t[m], t[j] - t[i])
        if u == (0, 0, 0):
            u = (1, -1, 0)
        up = down = float("inf")
        for x, d in zip(active, u, strict=True):
            if d > 0:
                up, down = min(up, (1 - p[x]) / d), min(down, p[x] / d)
            elif d < 0:
                up, down = min(up, p[x] / -d), min(down, (1 - p[x]) / -d)
        step = up if draw[k] * (up + down) < down else -down
        left = []
        for x, d in zip(active, u, strict=True):
            v = p[x] + step * d
            p[x] = 0.0 if v < eps else 1.0 if v > 1 - eps else v
            if eps < p[x] < 1 - eps:
                left.append(x)
        active = left
    return np.array(p)


def landing(p: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The few fractions left, each to 0 or 1, so that the tokens, then the documents, are nearest to what p expects."""
    some = np.flatnonzero((p > 0) & (p < 1))
    out = p.copy()
    want, many = float((p[some] * tokens[some]).sum()), float(p[some].sum())
    if len(some):
        best = min(product((0.0, 1.0), repeat=len(some)), key=lambda x: (abs(float(np.dot(x, tokens[some])) - want), abs(sum(x) - many)))
        out[some] = best
    return out


UNIT = T.StructType([T.StructField("mix_name", T.StringType()), T.StructField("source", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("certain", T.LongType()), T.StructField("p", T.DoubleType())])


def _move(seed: int, last: bool):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        tokens = pdf["n_tokens"].to_numpy(dtype=float)
        rng = np.random.default_rng([seed, *map(ord, str(key[0]) + str(key[1])), int(key[2])])
        p = flight(pdf["p"].to_numpy(dtype=float), tokens, rng)
        return pdf.assign(p=landing(p, tokens) if last else p)[[f.name for f in UNIT]]

    return run


def mix(documents: DataFrame, targets: DataFrame, budgets: dict[str, int] | None = None, *, least_fill: float = 0.25, tokenizer: str = DEFAULT_TOKENIZER, block: int = 5_000, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """A selection (mix_name, doc_id, source, n_tokens, times) and its shares, one row of each target.

    documents: doc_id unique, source, text; targets: mix_name, source, target_share, max_repeats; other columns are not
    read. Shares are relative in a mix; null or negative ones count as 0, a null max_repeats as 1; of several targets of
    a mix and source (in any spelling) shares add up and the largest max_repeats holds. Documents of a null source or of
    one that no mix names are not drawn. A source that is absent, or too small for its share with max_repeats, comes out
    in the shares with what it really got. Empty tables give empty results.

    budgets: tokens of each mix; if None as many as all its sources can meet their shares with, or least_fill of their
    tokens. block: documents of a source in one task; seed: of the draws, which depend on nothing else but the rows.
    """
    spark = documents.sparkSession
    counted = materialise(token_counts(documents, tokenizer), "token-counts")
    share = F.greatest(F.coalesce(F.col("target_share"), F.lit(0.0)), F.lit(0.0))
    wanted = targets.where("mix_name IS NOT NULL AND source IS NOT NULL").groupBy("mix_name", source_key(F.col("source")).alias("source")).agg(F.sum(share).alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("most"))
    rows = [tuple(r) for r in wanted.orderBy("mix_name", "source").collect()]  # the mixes asked for
    names = [r[1] for r in rows]
    totals = {r["source"]: (r["n"], r["t"]) for r in counted.where(F.col("source").isin(names)).groupBy("source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).collect()} if names else {}
    plan = quotas(rows, {k: v[1] for k, v in totals.items()}, budgets, least_fill)
    schema = "mix_name string, source string, target_share double, uses double, max_repeats int"
    plan_df = spark.createDataFrame(plan, schema)
    units = counted.join(F.broadcast(plan_df.where("uses > 0")), "source")
    units = units.select("mix_name", "source", "doc_id", "n_tokens", F.floor("uses").cast("long").alias("certain"), (F.col("uses") - F.floor("uses")).alias("p"))
    most = max((n for n, _ in totals.values()), default=0)
    decided = None
    while True:
        parts = max(1, -(-most // block))
        part = F.pmod(F.xxhash64("doc_id", F.lit(parts)), F.lit(parts)).alias("part")
        units = materialise(units.groupBy("mix_name", "source", part).applyInPandas(_move(seed, parts == 1), UNIT), "units")
        done = units.where("p = 0 OR p = 1")
        decided = done if decided is None else decided.unionByName(done)
        if parts == 1:
            break
        # at most two of each part go on
        units, most = units.where("p > 0 AND p < 1"), 2 * parts
    selection = decided.select("mix_name", "doc_id", "source", "n_tokens", (F.col("certain") + F.col("p").cast("long")).cast("int").alias("times")).where("times > 0")
    got = selection.groupBy("mix_name", "source").agg(F.count("*").alias("n_documents"), F.sum("times").alias("n_uses"), F.sum(F.col("times") * F.col("n_tokens")).alias("tokens"), F.max("times").alias("most_used"))
    whole = got.groupBy("mix_name").agg(F.sum("tokens").alias("all_tokens"))
    shares = plan_df.join(got, ["mix_name", "source"], "left").join(whole, "mix_name", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return selection, shares.select("mix_name", "source", "target_share", (F.coalesce("tokens", F.lit(0)) / F.coalesce("all_tokens", F.lit(1))).alias("actual_share"), zero("tokens"), zero("n_documents"), zero("n_uses"), zero("most_used"), "max_repeats")
