"""Who entered and left a saved predicate since the last look."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def delta(ledger: DataFrame, now: DataFrame, id_col: str = "id") -> DataFrame:
    """id and change: entered (to fire), departed (to forget, so that a return fires again)."""
    entered = now.join(ledger, id_col, "left_anti").select(id_col, F.lit("entered").alias("change"))
    departed = ledger.join(now, id_col, "left_anti").select(id_col, F.lit("departed").alias("change"))
    return entered.unionByName(departed)


def advance(ledger: DataFrame, change: DataFrame, id_col: str = "id") -> DataFrame:
    """The ledger after a change; call it once what entered has fired, so that a crash in between fires again."""
    left = ledger.join(change.filter("change = 'departed'"), id_col, "left_anti").select(id_col)
    return left.union(change.filter("change = 'entered'").select(id_col))


def foreach_batch(read_ledger, write_ledger, fire, predicate, id_col: str = "id"):
    """The function for writeStream.foreachBatch: evaluates the predicate, fires what entered, then stamps the ledger."""

    def run(batch: DataFrame, batch_id: int) -> None:
        ledger = read_ledger()
        change = delta(ledger, predicate(batch), id_col).persist()
        fire(change.filter("change = 'entered'"), batch_id)
        write_ledger(advance(ledger, change, id_col))
        change.unpersist()

    return run
