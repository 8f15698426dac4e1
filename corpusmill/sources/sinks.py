"""Writers: versions of a table, upserts, delta loads, ordered manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The version of a table that was published last, or None."""
    jvm, where, fs = _fs(spark, path)
    pointer = jvm.org.apache.hadoop.fs.Path(where, "CURRENT")
    if not fs.exists(pointer):
        return None
    name = spark.read.text(f"{path}/CURRENT").first()[0]
    return spark.read.parquet(f"{path}/{name}")


def publish(df: DataFrame, path: str, version: str) -> None:
    """Write df as a version and make it the current one; readers see the old or the new one, never a part."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}/{version}")
    jvm, where, fs = _fs(spark, path)
    staged = jvm.org.apache.hadoop.fs.Path(where, f"_{version}.tmp")
    out = fs.create(staged, True)
    out.write(bytearray(version, "utf-8"))
    out.close()
    # one step: whoever reads finds the old name or the new one
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(context.makeQualified(staged), context.makeQualified(jvm.org.apache.hadoop.fs.Path(where, "CURRENT")), options)


def upserted(rows: DataFrame, path: str, key: list[str], order: str) -> DataFrame:
    """The current version with rows merged in: of each key the row with the latest `order`."""
    old = current(rows.sparkSession, path)
    both = rows if old is None else old.unionByName(rows)
    others = [c for c in rows.columns if c not in key and c != order]
    last = both.groupBy(*key).agg(F.max(F.struct(order, *others)).alias("r"))
    return last.select(*[c if c in key else F.col(f"r.{c}").alias(c) for c in rows.columns])


def missing_rows(wanted: DataFrame, have: DataFrame, key: list[str]) -> DataFrame:
    """What a resumed load still has to bring."""
    return wanted.join(have.select(*key).distinct(), key, "left_anti")


def insert_if_absent(rows: DataFrame, have: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new keys, one of each."""
    return missing_rows(rows.dropDuplicates(key), have, key)


def write_manifest(df: DataFrame, path: str, order: list[str]) -> None:
    """One CSV file with a header, in order. For reports of a bounded number of rows."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """JSON lines; ordered by ranges, so that files in name order are in order."""
    (df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df).write.mode("overwrite").json(path)
