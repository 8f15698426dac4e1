"""Audits of answers, of stored hashes, and of an append-only log."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the three detectors of a refusal look for.
NO_ANSWER = r"(?i)do(es)? not (answer|address|contain|provide)|not answered|no provision|cannot be answered|do not (support|establish)|passages do not|is not (governed|addressed) by"
REFUSAL_PHRASES = (
    "do not contain enough", "don't contain enough", "do not have enough", "don't have enough", "insufficient information", "cannot answer", "can't answer", "no information about",
    "sources do not address", "sources don't address", "not enough information", "unable to find", "i'm unable to", "no relevant information", "not in the provided",
)
REFUSAL_TERMS = (
    "do not answer", "does not answer", "not answered", "no provision", "cannot be answered", "do not state", "do not specify", "passages provided do not", "do not establish", "do not set",
    "do not address", "do not contain", "is not addressed", "not found in the", "outside the michigan court rules", "governed by statute", "would be found in", "passages do not",
)


def first_sentence(c: Column) -> Column:
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    return F.regexp_extract(t, r"^([\s\S]*?(?:[.!?](?:\s|[A-Za-z]|$)|\n|$))", 1)


def refusal_by_pattern(answer: Column) -> Column:
    """A phrase anywhere."""
    return F.coalesce(answer, F.lit("")).rlike(NO_ANSWER)


def refusal_by_lead(answer: Column) -> Column:
    """A phrase in the first sentence; or anywhere, if the answer cites nothing."""
    low, lead = F.lower(F.coalesce(answer, F.lit(""))), F.lower(first_sentence(answer))
    any_of = lambda c: F.exists(F.array(*[F.lit(p) for p in REFUSAL_PHRASES]), lambda p: F.contains(c, p))
    return any_of(lead) | (any_of(low) & ~low.rlike(r"\[\d+"))


def refusal_by_term(answer: Column) -> Column:
    """A term anywhere."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    return F.exists(F.array(*[F.lit(p) for p in REFUSAL_TERMS]), lambda p: F.contains(low, p))


def cited_numbers_ok(numbers: Column, k: Column) -> Column:
    """Whether at least one marker names a passage from 1 to k."""
    return F.exists(numbers, lambda n: (n >= 1) & (n <= k))


def citation_audit(citations: DataFrame, blocks: DataFrame, passages: DataFrame, chunks: DataFrame, key) -> DataFrame:
    """(answer_id, n_citations, n_exist, n_retrieved, all_exist, all_retrieved), one row of each answer with citations.

    A citation exists if a block has it, in the form key() gives it; it was retrieved if a chunk among the answer's
    passages lists it. Distinct citations count once.
    """
    said = citations.where("answer_id IS NOT NULL AND citation IS NOT NULL").select("answer_id", key(F.col("citation")).alias("c")).distinct()
    have = blocks.where("citation IS NOT NULL").select(key(F.col("citation")).alias("c")).distinct().withColumn("exist", F.lit(1))
    listed = chunks.where("chunk_id IS NOT NULL").select("chunk_id", F.explode("citations").alias("x")).where("x IS NOT NULL").select("chunk_id", key(F.col("x")).alias("c")).distinct()
    asked = said.select("answer_id").distinct()
    got = passages.select("answer_id", "chunk_id").distinct().join(asked, "answer_id", "left_semi").join(listed, "chunk_id").select("answer_id", "c").distinct().withColumn("got", F.lit(1))
    rows = said.join(have, "c", "left").join(got, ["answer_id", "c"], "left")
    n, e, g = F.count("*"), F.count("exist"), F.count("got")
    return rows.groupBy("answer_id").agg(n.alias("n_citations"), e.alias("n_exist"), g.alias("n_retrieved"), (n == e).alias("all_exist"), (n == g).alias("all_retrieved"))


def stale_hashes(df: DataFrame, key: str, text: str, stored: str, width: int = 64) -> DataFrame:
    """Rows whose stored hash isn't the start of the text's sha256."""
    fresh = F.substring(F.sha2(F.coalesce(F.col(text), F.lit("")), 256), 1, width)
    return df.select(F.col(key), F.col(stored).alias("stored"), fresh.alias("fresh")).where("NOT (stored <=> fresh)").distinct()


def chain(df: DataFrame, group: str, order: str, body: str) -> DataFrame:
    """(group, seq, hash): the hash chain of each group's lines, sha256(hash of the line before || body), in order.

    The chain is sequential by nature: groups are spread over tasks, their lines sorted by the shuffle and streamed, so
    that all that is held of a group is its last hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, last = None, b""
        for b in batches:
            hashes = []
            for g, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if g != mine:
                    mine, last = g, b""
                last = hashlib.sha256(last + (text or "").encode("utf-8")).hexdigest().encode()
                hashes.append(last.decode())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hashes, pa.string())], names=[group, "seq", "hash"])

    rows = df.where(F.col(group).isNotNull()).select(group, F.col(order).cast("long").alias("seq"), F.col(body).alias("body"))
    kind = rows.schema[group].dataType.simpleString()
    return rows.repartition(group).sortWithinPartitions(group, "seq", "body").mapInArrow(run, f"{group} {kind}, seq long, hash string")


def first_break(logged: DataFrame, group: str, order: str, body: str, hashed: str) -> DataFrame:
    """(group, first_bad): the first line whose hash does not follow from the stored hash before it; null if none.

    Each line is checked against its neighbour, so no chain has to be folded.
    """
    from pyspark.sql.window import Window as W

    before = F.coalesce(F.lag(hashed).over(W.partitionBy(group).orderBy(order)), F.lit(""))
    bad = ~F.col(hashed).eqNullSafe(F.sha2(F.concat(before, F.col(body)), 256))
    return logged.withColumn("bad", bad).groupBy(group).agg(F.min(F.when(F.col("bad"), F.col(order))).alias("first_bad"))
