"""Mixing sources to target weights by weighted fair queueing, with DataFrame operations only.

Every document gets a place in its source's shuffle (by a hash of its id) and a virtual finish time: the source's tokens
up to and with it, divided by the source's target. A second pass over the source goes on from there, so a document has
one finish time for each pass. Passes of all sources are then taken in order of finish time until the total budget is
reached; as every source has finish time 1 at its target, each ends near its target.

Neither the running sums nor the global order are made in one task. The first are a range partition by the hash into
about the square root of the rows, sums of the ranges, prefix sums over those few, and running sums within each range. Of
the order only the place where the budget ends is looked for, in ever smaller ranges; so what the mix takes of a source
is told by the last document of its shuffle that each pass takes, and one row for each source is all that the documents
are joined with.

Defined results: a null text has size 0 and is never taken, as is any text without words. A null source is a source of
its own, last in order. Rows of one source that share an id are taken or left together (so repeated rows are), and their
order is that of the id; null ids share one, so however many share an id they are one in the shuffle. Documents whose pass would exceed the budget are left, so the mix never
has more tokens than it. An empty table gives an empty table. Reruns give the same mix: nothing depends on how rows are
stored. Columns other than those named are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermill.llm._common import WORD, Written, global_rank, join_by_key


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(id_: Column) -> Column:
    return F.md5(F.coalesce(id_.cast("string"), F.lit("")))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, few: int = 100_000) -> DataFrame:
    """sizes: source, source_size, one row for each source, written. Adds place (from 1, by code point, null last) and target.

    Targets are weight times a common level, but at most `most` times the source's size. The level begins as if no source
    were at its limit and rises as those beyond theirs are found, until no more are. Up to `few` sources are numbered in
    one task, more by ranges."""
    if sizes.count() <= few:
        t = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")))
    else:
        t = global_rank(sizes, [], [F.col("source").isNull(), F.col("source")], "place").withColumn("place", (F.col("place") + 1).cast("int"))
    t = t.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") - 1) % len(weights) + 1))
    t = t.withColumn("limit", F.col("source_size") * F.lit(float(most)))
    t = Written(t, "weights").df
    level, capped = None, -1
    while True:
        over = F.lit(False) if level is None else F.col("limit") / F.col("weight") < F.lit(level)
        x = t.agg(F.count(F.when(over, 1)).alias("n"), F.sum("source_size").alias("all"), F.sum(F.when(over, F.col("limit"))).alias("held"), F.sum(F.when(~over, F.col("weight"))).alias("open")).first()
        if not x.open or x.n == capped:
            break
        level, capped = (x["all"] * share - (x.held or 0.0)) / x.open, x.n
    target = F.col("limit") if level is None else F.least("limit", F.col("weight") * F.lit(level))
    return t.select("source", "source_size", "place", *(c for c in sizes.columns if c not in ("source", "source_size")), target.alias("target"))


@dataclass
class Mix:
    """rows: id, size, source_size, target, taken, passes. cuts: for each source (one row each, with its number of
    documents in n) the last (key, id) of its shuffle that passes 1 to `most` take, from which any copy of the documents
    can be mixed alike."""

    rows: DataFrame
    cuts: DataFrame
    most: int
    documents: int
    sources: int


def _with_source(rows: DataFrame, table: DataFrame, documents: int, sources: int, few: int = 10_000) -> DataFrame:
    """rows (column source) with what table says of the source. Up to `few` sources are a small table to broadcast; with
    more, only those with a large part of the rows are, and the others are joined by a shuffle."""
    if sources > few:
        return join_by_key(rows, table, ["source"], "n", documents)
    given = table.drop("n").withColumnRenamed("source", "_source")
    return rows.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def _last_finish(each: DataFrame, budget: float, single: int = 50_000) -> tuple[tuple, bool] | None:
    """each: place, size, finish. Where the budget ends in the order of (finish, place): the last of them that is still in
    it and True, or the first that is not and False. None if all are.

    The range in which it lies is cut into bins, and the bin that holds it is the next range, by finish time and, where
    all share one, by place, until the range holds few enough rows to be put in order by one task."""
    before, inside = 0, each
    while True:
        x = inside.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.min(F.struct("finish", "place")).alias("first"), F.max(F.struct("finish", "place")).alias("last")).first()
        # A millionth of a word is allowed for the rounding of sums of targets.
        if not x.n or before + x.size <= budget + 1e-6:
            return None
        by = "finish" if x.first.finish < x.last.finish else "place"
        low, high = x.first[by], x.last[by]
        if x.n <= single or low == high:
            run = F.sum("size").over(Window.orderBy("finish", "place").rangeBetween(Window.unboundedPreceding, Window.currentRow))
            sums = inside.groupBy("finish", "place").agg(F.sum("size").alias("size")).withColumn("upto", run)
            cut = sums.filter(F.col("upto") + before <= budget + 1e-6).agg(F.max(F.struct("finish", "place"))).first()[0]
            return (tuple(x.first), False) if cut is None else (tuple(cut), True)
        bins = math.isqrt(x.n)
        slot = F.floor((F.col(by) - low) / (high - low) * bins)
        sums = inside.groupBy(slot.alias("slot")).agg(F.sum("size").alias("part"))  # at most bins + 1 rows
        sums = sums.withColumn("upto", F.sum("part").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        over = sums.filter(F.col("upto") + before > budget + 1e-6).orderBy("slot").select("slot", (F.col("upto") - F.col("part")).alias("before")).first()
        before, inside = before + over.before, inside.filter(slot == over.slot)


def plan_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, few: int = 10_000, single: int = 50_000) -> Mix:
    """few and single only say from which number of sources, and of rows at the cut, on they are dealt out to many tasks."""
    sized = Written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "sized").df
    sizes = Written(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "sizes").df
    totals = sizes.agg(F.sum("n").alias("documents"), F.count(F.lit(1)).alias("sources")).first()
    n, sources = totals.documents or 0, totals.sources
    targets = Written(source_targets(sizes, weights, share, most), "targets").df
    # Rows of a source that share an id are one from here on, however many they are.
    each_id = sized.filter("size > 0").groupBy("source", "id").agg(F.sum("size").alias("size"))
    ranges = max(1, math.isqrt(n))
    keyed = Written(each_id.withColumn("key", shuffle_key(F.col("id"))), "keyed").df
    keyed = _with_source(keyed, targets, n, sources, few).withColumn("range", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.lit(ranges) / F.lit(2**32)))
    parts = Written(keyed.groupBy("place", "range").agg(F.sum("size").alias("part")), "ranges").df
    before = parts.select("place", "range", F.coalesce(F.sum("part").over(Window.partitionBy("place").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    run = F.sum("size").over(Window.partitionBy("place", "range").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    timed = keyed.join(before, ["place", "range"]).withColumn("upto", F.col("before") + run)
    timed = Written(timed.select("id", "source", "place", "size", "key", "source_size", "target", "upto"), "timed").df

    def finish(i: int) -> Column:
        """Of pass i, from 0; null where nothing is to be taken."""
        return F.when(F.col("target") > 0, (F.col("upto") + F.col("source_size") * i) / F.col("target"))

    each = timed.select("place", "size", F.explode(F.array(*(finish(i) for i in range(most)))).alias("finish")).filter("finish IS NOT NULL")
    cut = _last_finish(each, targets.agg(F.sum("target")).first()[0] or 0.0, single)

    def taken(i: int) -> Column:
        f = finish(i)
        if cut is None:
            return f.isNotNull()
        (at, place), whole = cut
        same = (f == at) & ((F.col("place") <= place) if whole else (F.col("place") < place))
        return F.coalesce((f < at) | same, F.lit(False))

    last = [F.max(F.when(taken(i), F.struct("key", "id"))).alias(f"last{i}") for i in range(most)]
    cuts = Written(timed.groupBy("place").agg(*last), "cuts").df
    cuts = Written(targets.join(cuts, "place", "left"), "source-cuts").df
    rows = _with_source(sized, cuts, n, sources, few).withColumn("passes", _passes(F.col("id"), F.col("size") > 0, most))
    rows = rows.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("passes")).alias("taken"), "passes")
    return Mix(rows, cuts.select("source", "n", *(f"last{i}" for i in range(most))), most, n, sources)


def _passes(id_: Column, wordy: Column, most: int) -> Column:
    """How many passes take a document: those whose last of the source's shuffle (last0, last1, …) is not before it."""
    own = F.struct(shuffle_key(id_).alias("key"), id_.alias("id"))
    return sum((F.when(wordy & F.coalesce(own <= F.col(f"last{i}"), F.lit(False)), 1).otherwise(0) for i in range(most)), F.lit(0))


def apply_mix(docs: DataFrame, mix: Mix, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Whole rows, each as often as the mix takes it, with their own columns only, whatever they are called. Only the
    source's row of mix.cuts is joined to them: a document is taken by a pass if its place in the shuffle is not beyond
    the source's last."""
    doc = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    given = docs.select(doc, F.col(source_col).alias("source"))
    passes = _passes(F.col("doc")[id_col], F.coalesce(F.col("doc")[text_col].rlike(WORD), F.lit(False)), mix.most)
    joined = _with_source(given, mix.cuts, mix.documents, mix.sources)
    return joined.select("doc", F.explode(F.array_repeat(F.lit(1), passes))).select("doc.*")


#: The same mix in DuckDB's SQL, over the view documents.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source) AS place
  FROM d GROUP BY source
), w AS (
  SELECT *, CAST([3.0, 1.0, 2.0][CAST((place - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS weight, CAST(source_size AS DOUBLE) * 2.0 AS lim FROM s
), r AS (
  SELECT *, lim / weight AS ratio FROM w
), l AS (
  SELECT *, (CAST((SELECT sum(source_size) FROM s) AS DOUBLE) * 1.5
             - coalesce(sum(lim) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r
), t AS (
  SELECT source, source_size, place,
         least(lim, coalesce((SELECT level FROM l WHERE level <= ratio ORDER BY ratio, place LIMIT 1) * weight, lim)) AS target FROM l
), f AS (
  SELECT d.doc_id, d.key, d.size, t.source_size, t.target, t.place,
         CAST(sum(d.size) OVER (PARTITION BY t.place ORDER BY d.key, d.doc_id NULLS FIRST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), p AS (
  SELECT *, CASE WHEN size > 0 AND target > 0 THEN CAST(upto + source_size * pass AS DOUBLE) / target END AS finish
  FROM f, (VALUES (0), (1)) AS passes(pass)
), q AS (
  SELECT *, sum(size) OVER (ORDER BY finish, place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total
  FROM p WHERE finish IS NOT NULL
), k AS (
  SELECT max(struct_pack(finish := finish, place := place)) AS cut FROM q WHERE total <= (SELECT sum(target) FROM t) + 1e-6
)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       CAST(sum(CASE WHEN finish IS NOT NULL AND struct_pack(finish := finish, place := place) <= (SELECT cut FROM k) THEN size ELSE 0 END) AS BIGINT) AS taken
FROM p GROUP BY doc_id, key, size, source_size, target, place, upto
"""
