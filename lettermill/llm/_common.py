"""What the operators of this subpackage share: written intermediates, ranks without a single task, and row checks."""

from __future__ import annotations

import atexit
import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as the contracts state them: runs of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_WRITTEN: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. It is the session's spark.checkpoint.dir; only where that
    is unset on a local master, as in tests, a temporary folder is made and set. On a cluster an unset folder raises."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and the executors of {master} share")
        at = "file://" + tempfile.mkdtemp(prefix="lettermill-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def drop_table(spark: SparkSession, path: str) -> None:
    """Deletes a folder written by written(); missing ones are no error."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _WRITTEN.pop(path, None)


@atexit.register
def _drop_all() -> None:
    for path, spark in list(_WRITTEN.items()):
        try:
            drop_table(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before; its shared folder then goes with it
            return


class Written:
    """A DataFrame written as Parquet to the shared folder and read back. Its lineage is the files alone, so a lost
    executor costs a re-read and not a recomputation, and what a non-deterministic plan dealt out stays as it was."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/lettermill/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        _WRITTEN[self.path] = self.spark
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        drop_table(self.spark, self.path)


def written(df: DataFrame, name: str) -> DataFrame:
    return Written(df, name).df


@contextlib.contextmanager
def scratch() -> Iterator[list[str]]:
    """Drops at its end the tables written within it, but for those whose paths are put into the list that it gives."""
    before, keep = set(_WRITTEN), []
    yield keep
    for path, spark in list(_WRITTEN.items()):
        if path not in before and path not in keep:
            drop_table(spark, path)


def join_by_key(rows: DataFrame, per_key: DataFrame, keys: list[str], n: str, total: int, most: int = 1024) -> DataFrame:
    """rows with what per_key says of their key: an inner join where null equals null. per_key has one row for each key,
    and in its column n, which is left out, how many of the `total` rows have that key (or more).

    A hot key needs no luck of the planner: keys of more than total / most rows, of which there are fewer than `most`,
    are broadcast, so their rows stay where they are; the others are dealt out by key, each with few rows. As both inputs
    are read more than once they should be written tables."""
    names = [f"_key_{i}" for i in range(len(keys))]
    given = per_key.select(*(F.col(k).alias(x) for k, x in zip(keys, names)), *(c for c in per_key.columns if c not in keys))
    hot, rest = (F.broadcast(given.filter(F.col(n) > total // most)), given.filter(F.col(n) <= total // most))
    same = [F.col(k).eqNullSafe(F.col(x)) for k, x in zip(keys, names)]
    cond = functools.reduce(Column.__and__, same)
    few = rows.join(hot, cond).drop(n, *names)
    return few.unionByName(rows.join(hot.select(*names), cond, "left_anti").join(rest, cond).drop(n, *names))


def global_rank(df: DataFrame, group: list[str], order: list[Column], out: str, partitions: int | None = None) -> DataFrame:
    """Adds out, the 0-based rank of each row within group by order, with no task that holds a whole group.

    Rows are range-partitioned and sorted by (group, order), written once, counted per (partition, group), and each
    row's place is its offset within its partition plus the rows of its group in earlier partitions. Rows that tie on
    everything get different ranks, by the order in which they were written."""
    spark = df.sparkSession
    keys = [F.col(g) for g in group]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    at, pid = f"_{out}_at", f"_{out}_pid"
    dealt = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    dealt = written(dealt.withColumn(at, F.monotonically_increasing_id()), "rank").withColumn(pid, F.shiftright(at, 33))
    per = dealt.groupBy(pid, *group).agg(F.min(at).alias("_first"), F.count(F.lit(1)).alias("_n"))
    # one row for each partition and group that it holds: at most partitions + groups rows, since the data are sorted
    if group:
        prior = " AND ".join(f"a.`{g}` <=> b.`{g}`" for g in group)
    else:
        prior = "true"
    per = written(per, "rank-counts")
    from pyspark.sql import Window

    w = Window.partitionBy(*group).orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    offs = per.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    a, b = dealt.alias("a"), offs.alias("b")
    cond = F.expr(f"a.`{pid}` = b.`{pid}` AND {prior}")
    return a.join(b, cond).select(*[F.col(f"a.`{c}`") for c in df.columns], (F.col(f"a.`{at}`") - F.col("b._first") + F.col("b._before")).alias(out))


def few_rows(batches, rows: int = 256):
    """The same rows in batches of at most so many, so that what Python makes of a batch stays small. At the end of the
    rows the worker, which waits for its next task, gives back the memory that it no longer uses."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
    give_back()


def give_back() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than GNU's keeps it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def row_batches(batch, *names: str):
    """Python lists of the named columns of an Arrow batch."""
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]
