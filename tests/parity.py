"""Compare a registered query with its SQL as the driver does: rows, columns, values without order."""

from __future__ import annotations

import datetime
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


COUNT = [0]


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_of(columns: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, name: str, sf_dir: str) -> str:
    """Empty if equal, else what differs."""
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    COUNT[0] = ours[1].total()
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    cur = con.execute(entry.oracle_sql()[name])
    theirs = rows_of([c[0] for c in cur.description], cur.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} and {theirs[0]}"
    if ours[1] != theirs[1]:
        return f"rows {ours[1].total()} and {theirs[1].total()}; only ours {list((ours[1] - theirs[1]).items())[:3]}; only SQL's {list((theirs[1] - ours[1]).items())[:3]}"
    return ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    from corpusmill.session import local_session

    sf = sys.argv[1]
    names = sys.argv[2:] or list(entry.queries())
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    for n in names:
        began = time.time()
        try:
            if n in entry.oracle_sql():
                said = compare(spark, n, sf) or f"equal, {COUNT[0]} rows"
            else:
                df = entry.queries()[n](spark, sf)
                said = f"{len(df.collect())} rows, no SQL"
        except Exception as e:
            said = f"ERROR {type(e).__name__} {str(e)[:1500]}"
        print(f"{n}: {said} ({time.time() - began:.1f} s)", flush=True)
