"""Streams with state of their own, over files that come one by one."""

import datetime as dt

from corpusmill.operators import audit
from corpusmill.streaming import log

T0 = dt.datetime(2025, 1, 1)


def fed(spark, tmp_path, parts, schema, run):
    """All rows that `run` gives of a stream of one file for each part."""
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append" if i else "overwrite").parquet(path)
    for i, f in enumerate(sorted((tmp_path / "in").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)):
        import os

        os.utime(f, (1_700_000_000 + i * 10, 1_700_000_000 + i * 10))
    q = run(log.read_log(spark, path, spark.createDataFrame([], schema).schema)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return [tuple(r) for r in spark.read.parquet(out).collect()]


def test_a_chain_goes_on_over_batches(spark, tmp_path):
    schema = "u string, n long, body string"
    parts = [[("a", 2, "y"), ("a", 1, "x"), ("b", 1, None)], [("a", 3, "z"), (None, 1, "q")], [("b", 2, "w")]]
    got = fed(spark, tmp_path, parts, schema, lambda s: log.chained(s, "u", "n", "body"))
    whole = audit.chain(spark.createDataFrame([r for p in parts for r in p], schema), "u", "n", "body")
    assert sorted(got) == sorted(map(tuple, whole.collect()))


def test_requests_are_taken_or_expire(spark, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    schema = "id string, kind string, payload string, ts timestamp"
    parts = [[("a", "ask", "p", at(0)), ("b", "ask", "q", at(0)), ("c", "take", None, at(1))], [("a", "take", None, at(5))], [("d", "ask", "r", at(60))], [("e", "ask", "s", at(61))]]
    got = fed(spark, tmp_path, parts, schema, log.stash)
    assert sorted((i, o, p) for i, o, p, _ in got) == [("a", "taken", "p"), ("b", "expired", "q"), ("c", "unknown", None)]
