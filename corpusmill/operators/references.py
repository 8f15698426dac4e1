"""References to records that do not exist: a bitmap anti-join by key range and period (problem 5).

Keys of both sides are encoded as integers: the key's hash names a range, its rank among the keys of that range is
the code. Both sides become bitmaps per range (and per month of the reference), and reference AND-NOT parent leaves
the codes of references that may dangle. Only those are decoded and held, row by row, against the target's intervals.

A bitmap of a range is 4 KB for 32,768 keys whatever the number of rows behind it, so the anti-join moves bits and
not rows; rows are touched again only for the codes that survive.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from corpusmill.session import materialise

BUCKET_BITS = 32768  # bits in one bitmap of bitmap_construct_agg

SURVIVOR = T.StructType(
    [
        T.StructField("range_id", T.IntegerType()),
        T.StructField("bucket", T.LongType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("known", T.BooleanType()),
        T.StructField("bits", T.ArrayType(T.IntegerType())),
    ]
)


@dataclass(frozen=True)
class Reference:
    """A column of one table that names keys of another.

    rows: (answer_id, ref_key, recorded_at); parents: (parent_key, loaded_at, deleted_at). key gives the form in
    which both sides are compared.
    """

    name: str
    rows: DataFrame
    parents: DataFrame
    key: Callable[[Column], Column] = staticmethod(lambda c: c)


def citation_key(c: Column) -> Column:
    """A citation without white space of any kind and without one leading MCR, in any letter case."""
    return F.regexp_replace(F.regexp_replace(c, r"[\s\u0085\p{Z}]+", ""), r"^(?i:mcr)", "")


def _month(ts: Column) -> Column:
    return (F.year(ts) * 12 + F.month(ts) - 1).cast("int")


def _and_not(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Bitmaps of one range and bucket: references of each month AND NOT the keys there for the whole month.

    kind 'known' holds every key with a target row, 'on' the keys whose presence without a gap begins with that
    month, 'off' those for which it ends with it. A month's presence is carried on from the month before.
    """
    range_id, bucket = keys
    as_bits = lambda b: np.frombuffer(b, dtype=np.uint8)
    none = np.zeros(BUCKET_BITS // 8, dtype=np.uint8)
    known, steps, refs = none.copy(), {}, []
    for kind, month, bitmap in zip(pdf["kind"], pdf["month"], pdf["bitmap"], strict=True):
        if kind == "known":
            known |= as_bits(bitmap)
        elif kind in ("on", "off"):
            step = steps.setdefault(int(month), {"on": none.copy(), "off": none.copy()})
            step[kind] |= as_bits(bitmap)
        else:
            refs.append((int(month), as_bits(bitmap)))
    out, there = [], none.copy()
    changes = sorted(steps)
    at = 0
    for month, bitmap in sorted(refs, key=lambda x: x[0]):
        while at < len(changes) and changes[at] <= month:
            there = (there & ~steps[changes[at]]["off"]) | steps[changes[at]]["on"]
            at += 1
        for is_known, bits in ((False, bitmap & ~known), (True, bitmap & known & ~there)):
            found = np.flatnonzero(np.unpackbits(bits, bitorder="little"))
            if len(found):
                out.append((range_id, bucket, month, is_known, found.astype(np.int32)))
    return pd.DataFrame(out, columns=[f.name for f in SURVIVOR])


def _events(parents: DataFrame) -> DataFrame:
    """+1 at loaded_at and -1 at deleted_at of every target row that is there for a moment at least."""
    valid = parents.where(F.col("loaded_at").isNotNull() & (F.col("deleted_at").isNull() | (F.col("deleted_at") > F.col("loaded_at"))))
    both = F.array(F.struct(F.col("loaded_at").alias("at"), F.lit(1).alias("step")), F.struct(F.col("deleted_at").alias("at"), F.lit(-1).alias("step")))
    return valid.select("ref_table", "key", F.inline(both)).where(F.col("at").isNotNull())


def orphan_references(references: list[Reference], key_ranges: int | None = None) -> DataFrame:
    """Rows (ref_table, answer_id, ref_key, recorded_at, reason) whose key had no target row at recorded_at.

    reason is 'missing' (no target row has the key), 'late' (all of them load after recorded_at) or 'deleted'.
    A target row is there from loaded_at, inclusive, until deleted_at, exclusive; null deleted_at means it is still
    there. Defined cases: a null reference is none; a null recorded_at can only be 'missing'; a target row with null
    loaded_at, or deleted no later than it was loaded, is never there but its key is known; if no target row has a
    loaded_at the reason is 'late'. Repeated rows come out as often as they go in. Empty tables give no rows, or make
    every reference 'missing'. Other columns of the tables are not read.

    key_ranges: number of ranges of the key dictionary; four for each shuffle partition if None.
    """
    spark = references[0].rows.sparkSession
    ranges = key_ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    refs = parents = None
    for r in references:
        rows = r.rows.where(F.col("ref_key").isNotNull()).select(F.lit(r.name).alias("ref_table"), "answer_id", "ref_key", r.key(F.col("ref_key")).alias("key"), "recorded_at")
        own = r.parents.where(F.col("parent_key").isNotNull()).select(F.lit(r.name).alias("ref_table"), r.key(F.col("parent_key")).alias("key"), "loaded_at", "deleted_at")
        refs = rows if refs is None else refs.unionByName(rows)
        parents = own if parents is None else parents.unionByName(own)
    # a null recorded_at gets a month before all others: nothing is present in it
    refs = refs.withColumn("month", F.coalesce(_month(F.col("recorded_at")), F.lit(-1)))

    # what each side says of a key, aggregated before anything is shuffled by key
    asked = refs.select("ref_table", "key", "month").distinct().withColumn("kind", F.lit("ref"))
    known = parents.groupBy("ref_table", "key").agg(F.min("loaded_at").alias("first_load"))
    events = _events(parents)
    by_month = events.groupBy("ref_table", "key", _month(F.col("at")).alias("month")).agg(F.sum("step").alias("net"), F.sum(F.when(F.col("step") < 0, -1).otherwise(0)).alias("closes"))
    life = W.partitionBy("ref_table", "key").orderBy("month")
    # 'sure' in a month: open at its start and not closed by all the closings in it; then there at every moment of it
    before = F.coalesce(F.sum("net").over(life.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    open_after = F.sum("net").over(life.rowsBetween(W.unboundedPreceding, 0))
    months = by_month.select("ref_table", "key", "month", (before + F.col("closes") >= 1).alias("sure"), (open_after >= 1).alias("after"))
    # between two months with events nothing changes: the state after one holds from the next month on
    steps = months.select("ref_table", "key", F.inline(F.array(F.struct(F.col("month").alias("month"), F.col("sure").alias("on")), F.struct((F.col("month") + 1).alias("month"), F.col("after").alias("on")))))
    # a month may follow the last event's and have events itself: 'sure' of its own events holds then
    steps = steps.groupBy("ref_table", "key", "month").agg(F.min("on").alias("on"))
    steps = steps.select("ref_table", "key", "month", F.when(F.col("on"), "on").otherwise("off").alias("kind"))
    said = asked.unionByName(steps).unionByName(known.select("ref_table", "key", F.lit(None).cast("int").alias("month"), F.lit("known").alias("kind")))

    # the dictionary: range by hash, code by rank in the range; one shuffle for both sides
    said = said.withColumn("range_id", F.pmod(F.xxhash64("ref_table", "key"), F.lit(ranges)).cast("int"))
    said = said.withColumn("code", F.dense_rank().over(W.partitionBy("range_id").orderBy("ref_table", "key")) - 1)
    said = materialise(said.withColumn("bucket", F.expr(f"CAST(code DIV {BUCKET_BITS} AS BIGINT)")), "reference-codes")

    bitmaps = said.groupBy("range_id", "bucket", "kind", "month").agg(F.expr(f"bitmap_construct_agg(CAST(code % {BUCKET_BITS} AS BIGINT))").alias("bitmap"))
    survivors = bitmaps.groupBy("range_id", "bucket").applyInPandas(_and_not, SURVIVOR)
    survivors = survivors.select("range_id", "month", "known", "bucket", F.explode("bits").alias("bit")).select("range_id", "month", "known", (F.col("bucket") * BUCKET_BITS + F.col("bit")).cast("int").alias("code"))
    decoded = said.where("kind = 'ref'").select("range_id", "code", "ref_table", "month", "key")
    suspects = survivors.join(decoded, ["range_id", "code", "month"]).select("ref_table", "key", "month", "known")

    # rows of the surviving codes; the month in the key spreads a key that many rows name
    rows = refs.join(suspects, ["ref_table", "key", "month"])
    missing = rows.where(~F.col("known")).withColumn("reason", F.lit("missing"))
    partly = materialise(rows.where(F.col("known") & F.col("recorded_at").isNotNull()), "reference-partly")
    return missing.select("ref_table", "answer_id", "ref_key", "recorded_at", "reason").unionByName(_judge(partly, events, known))


def _judge(rows: DataFrame, events: DataFrame, known: DataFrame) -> DataFrame:
    """The exact check of references whose key has target rows, some of them gone or not yet there in the month.

    Events and references are summed up by day, so the window over a key sees one row a day; only days on which a
    target row comes or goes are then ordered moment by moment.
    """
    keys = rows.select("ref_table", "key").distinct()
    events = events.join(keys, ["ref_table", "key"], "left_semi").withColumn("day", F.to_date("at"))
    rows = rows.withColumn("day", F.to_date("recorded_at"))
    days = events.select("ref_table", "key", "day", "step", F.lit(1).alias("moved")).unionByName(rows.select("ref_table", "key", "day").distinct().select("*", F.lit(0).alias("step"), F.lit(0).alias("moved")))
    days = days.groupBy("ref_table", "key", "day").agg(F.sum("step").alias("net"), F.max("moved").alias("moved"))
    base = F.coalesce(F.sum("net").over(W.partitionBy("ref_table", "key").orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    days = days.select("ref_table", "key", "day", base.alias("base"), "moved")
    rows = rows.join(days, ["ref_table", "key", "day"])
    calm = rows.where("moved = 0").withColumn("open", F.col("base"))
    busy = rows.where("moved = 1")
    busy_days = busy.select("ref_table", "key", "day").distinct()
    at_rank = lambda n: F.lit(n).alias("after")  # noqa: E731  events of a moment count for references of the same moment
    moments = busy.select("ref_table", "key", "day", F.col("recorded_at").alias("at"), at_rank(1), F.lit(0).alias("step"), "base", "answer_id", "ref_key").unionByName(
        events.join(busy_days, ["ref_table", "key", "day"], "left_semi").select("ref_table", "key", "day", "at", at_rank(0), "step"), allowMissingColumns=True
    )
    run = F.sum("step").over(W.partitionBy("ref_table", "key", "day").orderBy("at", "after").rowsBetween(W.unboundedPreceding, W.currentRow))
    busy = moments.withColumn("open", run).where("after = 1").select("ref_table", "key", "answer_id", "ref_key", F.col("at").alias("recorded_at"), (F.col("open") + F.col("base")).alias("open"))
    judged = calm.select(*busy.columns).unionByName(busy).where("open < 1").join(known, ["ref_table", "key"])
    late = F.col("first_load").isNull() | (F.col("first_load") > F.col("recorded_at"))
    return judged.select("ref_table", "answer_id", "ref_key", "recorded_at", F.when(late, "late").otherwise("deleted").alias("reason"))


def orphans_found(orphans: DataFrame) -> DataFrame:
    """Distinct (ref_table, answer_id, ref_key, reason)."""
    return orphans.select("ref_table", "answer_id", "ref_key", "reason").distinct()


def orphans_by_month(orphans: DataFrame) -> DataFrame:
    """(ref_table, month 'yyyy-MM', reason, n_rows, n_keys) of orphan_references(); month is null with recorded_at."""
    month = F.date_format("recorded_at", "yyyy-MM").alias("month")
    return orphans.groupBy("ref_table", month, "reason").agg(F.count("*").alias("n_rows"), F.countDistinct("ref_key").alias("n_keys"))


def answer_log_references(passages: DataFrame, citations: DataFrame, chunks: DataFrame, blocks: DataFrame) -> list[Reference]:
    """The two references of the answer log: passages name chunks by id, citations name blocks by citation."""
    chunk_rows = chunks.select(F.col("chunk_id").alias("parent_key"), "loaded_at", "deleted_at")
    block_rows = blocks.select(F.col("citation").alias("parent_key"), "loaded_at", "deleted_at")
    return [
        Reference("answer_passages", passages.select("answer_id", F.col("chunk_id").alias("ref_key"), "recorded_at"), chunk_rows),
        Reference("answer_citations", citations.select("answer_id", F.col("citation").alias("ref_key"), "recorded_at"), block_rows, citation_key),
    ]
