"""The query log as a stream: running counts, sessions, feedback upserts and delta loads.

Each has a batch form elsewhere; on a finished input both give the same rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_log(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def hourly_counts(events: DataFrame, late: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) by tumbling window of ts; what comes later than `late` is dropped."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
    return rows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n): events of a user no more than `gap` apart."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return rows.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def upsert_stream(rows: DataFrame, path: str, key: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Keep the last row of each key in a Parquet table: of a batch's rows and the table's, the one with the latest `order`.

    A batch is written to a folder of its own and named by a pointer file once it is complete, so a batch that is run
    again replaces what it wrote and readers see one whole version.
    """
    from corpusmill.sources.sinks import publish, upserted

    def merge(batch: DataFrame, epoch: int) -> None:
        publish(upserted(batch, path, key, order), path, f"v{epoch:06d}")

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def chained(lines: DataFrame, group: str, order: str, body: str) -> DataFrame:
    """(group, seq, hash): a hash chain that goes on from batch to batch; of each group only the last hash is kept.

    Lines (group string, order bigint, body string) of a batch are taken in order of `order`, as operators.audit.chain() does
    of a whole table; null groups are left out.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else ""
        rows = pd.concat(parts).sort_values(["seq", "body"], kind="stable")
        hashes = []
        for text in rows["body"]:
            last = hashlib.sha256((last + (text or "")).encode()).hexdigest()
            hashes.append(last)
        state.update((last,))
        yield pd.DataFrame({group: key[0], "seq": rows["seq"].to_numpy(), "hash": hashes})

    rows = lines.where(F.col(group).isNotNull()).select(group, F.col(order).cast("long").alias("seq"), F.coalesce(F.col(body), F.lit("")).alias("body"))
    return rows.groupBy(group).applyInPandasWithState(step, f"{group} string, seq long, hash string", "last string", "append", GroupStateTimeout.NoTimeout)


def stash(events: DataFrame, keep: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """(id, outcome, payload, at): what became of each pending request: 'taken' by its id, or 'expired' after `keep` of event time.

    events: id string, kind 'ask' or 'take', payload string, ts. A take without a request is 'unknown'; a request that is asked
    again replaces the one before. Time is that of the watermark, so a silent stream expires nothing.
    """
    millis = int(pd.Timedelta(keep).total_seconds() * 1000)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            payload, at = state.get
            state.remove()
            yield pd.DataFrame({"id": [key[0]], "outcome": ["expired"], "payload": [payload], "at": [pd.Timestamp(at, unit="ms")]})
            return
        held = state.get if state.exists else None
        for kind, payload, ts in pd.concat(parts).sort_values(["ts", "kind"], kind="stable")[["kind", "payload", "ts"]].itertuples(index=False):
            at = int(ts.timestamp() * 1000)
            if kind == "ask":
                held = (payload, at)
            elif held is not None and at - held[1] <= millis:
                out.append((key[0], "taken", held[0], ts))
                held = None
            else:
                out.append((key[0], "expired" if held is not None else "unknown", held[0] if held is not None else None, ts))
                held = None
        if held is None:
            if state.exists:
                state.remove()
        else:
            state.update(held)
            state.setTimeoutTimestamp(max(held[1] + millis + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["id", "outcome", "payload", "at"])

    rows = events.where("id IS NOT NULL AND ts IS NOT NULL").select("id", "kind", "payload", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return rows.groupBy("id").applyInPandasWithState(step, "id string, outcome string, payload string, at timestamp", "payload string, at long", "append", GroupStateTimeout.EventTimeTimeout)
