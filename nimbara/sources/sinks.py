"""Sinks: atomic replacement, partitioned maps and plain reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def replace_table(df: DataFrame, path: str) -> None:
    """Write beside ``path`` and rename: readers see the old table or the new one.

    The old table moves aside first and goes last, so a lost driver leaves one
    of the two under a name that begins with ``path``.
    """
    spark = df.sparkSession
    fresh, aside = f"{path}.{uuid.uuid4().hex}", f"{path}.old.{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(fresh)
    fs, at = _fs(spark, path)
    old = _fs(spark, aside)[1]
    had = fs.exists(at) and fs.rename(at, old)
    if not fs.rename(_fs(spark, fresh)[1], at):
        if had:
            fs.rename(old, at)
        raise OSError(f"cannot rename to {path}")
    if had:
        fs.delete(old, True)


def write_maps(df: DataFrame, path: str, period: str) -> None:
    """One partition per period label; a later run replaces only the periods it has."""
    df.repartition(period).write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy(period).parquet(path)


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A small table as CSV (with a header), JSON lines or text (one string column)."""
    out = df.write.mode("overwrite")
    if kind == "csv":
        out.option("header", True).csv(path)
    elif kind == "json":
        out.json(path)
    elif kind == "text":
        out.text(path)
    else:
        raise ValueError(f"unknown kind {kind}")
