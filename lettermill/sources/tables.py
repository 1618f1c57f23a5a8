"""Readers for the tables, and the message-shaped views over them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def write(df: DataFrame, path: str, mode: str = "append") -> None:
    """The one writer of a table. append refuses rows of other columns than the table's. overwrite completes the new table
    beside the old one before it takes its place, so a job that dies leaves the old one whole."""
    if mode not in ("append", "overwrite"):
        raise ValueError(f"{mode} is neither append nor overwrite")
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = fs.exists(at(path))
    if mode == "append":
        if there:
            shape = lambda d: [(f.name, f.dataType) for f in d.schema.fields]
            if shape(spark.read.parquet(path)) != shape(df):
                raise ValueError(f"{path} has other columns")
        df.write.mode("append").parquet(path)
        return
    tag = uuid.uuid4().hex[:8]
    new, old = f"{path}.new-{tag}", f"{path}.old-{tag}"
    df.write.parquet(new)
    if there and not fs.rename(at(path), at(old)) or not fs.rename(at(new), at(path)):
        raise OSError(f"{new} could not take the place of {path}")
    fs.delete(at(old), True)


def epoch(ts) -> F.Column:
    """Seconds since 1970 of a timestamp without time zone, taken as UTC."""
    return F.unix_timestamp(F.to_timestamp(F.col(ts) if isinstance(ts, str) else ts))


def messages(spark: SparkSession, root: str) -> DataFrame:
    """events as messages: the user writes, the event's type is the folder, `purchase` goes out and all else comes in."""
    e = table(spark, root, "events")
    return e.select(
        F.col("event_id").alias("message_id"),
        F.col("user_id").alias("sender"),
        F.col("event_type").alias("mailbox"),
        "ts",
        epoch("ts").alias("at"),
        F.when(F.col("event_type") == "purchase", "outbound").otherwise("inbound").alias("direction"),
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )
