"""A leased work queue as transitions of a state table: id, state, priority, attempts, at, lease_until."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEASE, ATTEMPTS, BACKOFF, BACKOFF_MOST = 300, 5, 30, 1800  # fixed values, in seconds but for the attempts
PRIORITY = {"recent": 10, "normal": 100, "backfill": 500}  # fixed values; lower goes first


def backoff(attempts: Column) -> Column:
    return F.least(F.lit(BACKOFF) * F.pow(F.lit(2.0), F.least(attempts - 1, F.lit(20))).cast("long"), F.lit(BACKOFF_MOST).cast("long"))


def enqueue(queue: DataFrame, items: DataFrame, done: DataFrame) -> DataFrame:
    """items: id, kind, hash. What is already done with the same hash, or already waiting, is not put in."""
    fresh = items.join(done, ["id", "kind", "hash"], "left_anti").join(queue.select("id", "kind"), ["id", "kind"], "left_anti")
    return queue.unionByName(fresh.withColumns({"state": F.lit("pending"), "attempts": F.lit(0)}), allowMissingColumns=True)


def lease(queue: DataFrame, now: int, n: int) -> DataFrame:
    """The queue with the n best of what is due leased: lowest priority number, then oldest, then id."""
    due = queue.filter((F.col("state") == "pending") & (F.col("at") <= now)).orderBy("priority", "at", "id").limit(n).select(F.col("id").alias("due_id"))
    q = queue.join(F.broadcast(due), F.col("id") == F.col("due_id"), "left") if n <= 10_000 else queue.join(due, F.col("id") == F.col("due_id"), "left")
    on = F.col("due_id").isNotNull()
    return q.withColumns({"state": F.when(on, "leased").otherwise(F.col("state")), "attempts": F.when(on, F.col("attempts") + 1).otherwise(F.col("attempts")), "lease_until": F.when(on, F.lit(now + LEASE)).otherwise(F.col("lease_until"))}).drop("due_id")


def after_failure(failed: DataFrame) -> DataFrame:
    """failed: id, attempts. dead after the last attempt, else pending again after the wait."""
    dead = F.col("attempts") >= ATTEMPTS
    return failed.withColumns({"state": F.when(dead, "dead").otherwise("pending"), "wait": F.when(~dead, backoff(F.col("attempts")))})


def reap(queue: DataFrame, now: int) -> DataFrame:
    """Leases that ran out are pending again."""
    out = (F.col("state") == "leased") & (F.col("lease_until") < now)
    return queue.withColumns({"state": F.when(out, "pending").otherwise(F.col("state")), "lease_until": F.when(out, F.lit(None)).otherwise(F.col("lease_until"))})
