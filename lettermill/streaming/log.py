"""The append-only event log as a stream, with cursors and retention."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.operators.upkeep import nth_newest
from lettermill.session import shared_dir


class OutOfRange(ValueError):
    """A cursor that the log no longer, or not yet, reaches."""

    def __init__(self, oldest: int):
        super().__init__(f"the oldest sequence number is {oldest}")
        self.oldest = oldest


def event_source(spark: SparkSession, path: str, after: int | None = None, *, files_at_once: int = 16) -> DataFrame:
    """A stream over the log's Parquet (a file or a folder that grows), of the events after a cursor."""
    folder = path
    schema = spark.read.parquet(folder).schema
    glob = folder if _is_dir(spark, folder) else folder.rsplit("/", 1)[0]
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once)
    if glob != folder:
        reader = reader.option("pathGlobFilter", folder.rsplit("/", 1)[1])
    stream = reader.parquet(glob)
    return stream if after is None else stream.filter(F.col("event_id") > after)


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def drain(stream: DataFrame, name: str, *, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Runs the stream over all that is there, then stops; the sink's rows, as Parquet in the shared folder. In complete
    mode each batch's whole result takes the place of the one before."""
    spark, table = stream.sparkSession, f"{name}-{uuid.uuid4().hex[:8]}"
    path = f"{shared_dir(spark)}/lettermill/{table}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or f"{path}-cursor").trigger(availableNow=True)
    if mode == "complete":
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path))
    else:
        writer = writer.format("parquet").option("path", path)
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def check_cursor(cursor: int, oldest: int, latest: int) -> None:
    """0 is always legal; otherwise the next event must still be there, and the cursor must not be in the future."""
    if cursor and (cursor + 1 < oldest or cursor > latest):
        raise OutOfRange(oldest)


def since(events: DataFrame, cursor: int, limit: int) -> DataFrame:
    span = events.agg(F.min("event_id"), F.max("event_id")).first()
    check_cursor(cursor, span[0] or 0, span[1] or 0)
    return events.filter(F.col("event_id") > cursor).orderBy("event_id").limit(limit)


def retain(events: DataFrame, *, now, rows: int = 1_000_000, days: int = 7) -> DataFrame:
    """The newest rows by id, none older than days; ids may have gaps."""
    first = nth_newest(events, "event_id", rows)
    return events.filter((F.col("event_id") >= F.lit(first)) & (F.col("ts") >= F.lit(now) - F.expr(f"INTERVAL {days} DAYS")))


def once(stream: DataFrame, key: str, time_col: str, ttl: str = "1 day") -> DataFrame:
    """Idempotent: each key passes once within the time."""
    return stream.withWatermark(time_col, ttl).dropDuplicatesWithinWatermark([key])
