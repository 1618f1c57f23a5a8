"""Relevance evaluation, click replay and learning to rank."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def metrics(judged: DataFrame, *, k: int = 10, recall_at: int = 50, precision_at: int = 3) -> DataFrame:
    """judged: q, doc_id, score, gain (0 to 3). For each query ndcg, mrr, recall and p3; precision divides by k always."""
    order = Window.partitionBy("q").orderBy(F.desc("score"), "doc_id")
    best = Window.partitionBy("q").orderBy(F.desc("gain"), "doc_id")
    r = judged.withColumn("rank", F.row_number().over(order)).withColumn("ideal", F.row_number().over(best))

    def dcg(place: str) -> Column:
        return F.sum(F.when(F.col(place) <= k, (F.pow(F.lit(2.0), F.col("gain")) - 1) / F.log2(F.col(place) + 1)).otherwise(0.0))

    hit = F.col("gain") > 0
    some = F.greatest(F.sum(F.when(hit, 1).otherwise(0)), F.lit(1))
    g = r.groupBy("q").agg(
        dcg("rank").alias("dcg"), dcg("ideal").alias("idcg"),
        F.coalesce(1.0 / F.min(F.when(hit, F.col("rank"))), F.lit(0.0)).alias("mrr"),
        (F.sum(F.when(hit & (F.col("rank") <= recall_at), 1.0).otherwise(0.0)) / some).alias("recall"),
        (F.sum(F.when(hit & (F.col("rank") <= precision_at), 1.0).otherwise(0.0)) / precision_at).alias("p3"),
    )
    return g.select("q", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"), "mrr", "recall", "p3")


def replay(impressions: DataFrame, key: str) -> DataFrame:
    """impressions: key, engaged, pos. The denominators are all impressions."""
    on = F.col("engaged")
    m = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return impressions.groupBy(key).agg(
        F.count(F.lit(1)).alias("impressions"), m(on).alias("ctr"), F.avg(F.when(on, 1.0 / F.col("pos")).otherwise(0.0)).alias("mrr"),
        m(on & (F.col("pos") <= 1)).alias("success1"), m(on & (F.col("pos") <= 3)).alias("success3"), m(~on).alias("abandoned"),
    )


def grade(action: Column, seconds: Column) -> Column:
    """reply (purchase) 3, open (click) 2, dwell (view) 3 from 30 seconds else 1, archive (error) -1, scrolled past 0."""
    return F.when(action == "purchase", 3).when(action == "click", 2).when(action == "view", F.when(seconds >= 30, 3).otherwise(1)).when(action == "error", -1).otherwise(0)


def propensity(pos: Column, eta: float = 0.5, most: float = 10.0) -> Column:
    return F.least(F.greatest(F.pow(pos.cast("double"), eta), F.lit(1.0)), F.lit(most))


def preference_pairs(graded: DataFrame, keys: list[str], id_col: str, most: int = 512) -> DataFrame:
    """graded: keys (a query's impressions), id, grade, pos. Pairs of a better over a worse result that stood above it or
    was acted on; at most `most` for a query, by (better, worse) position: the bound of a training sample."""
    a, b = graded.alias("a"), graded.alias("b")
    met = F.expr(" AND ".join(f"a.`{k}` = b.`{k}`" for k in keys) + " AND a.grade > b.grade AND (b.pos < a.pos OR b.grade <> 0)")
    p = a.join(b, met).select(*(F.col(f"a.{k}").alias(k) for k in keys), F.col(f"a.{id_col}").alias("better"), F.col(f"b.{id_col}").alias("worse"), (F.col("a.grade") - F.col("b.grade")).cast("int").alias("margin"), propensity(F.col("a.pos")).alias("weight"), F.col("a.pos").alias("_a"), F.col("b.pos").alias("_b"))
    w = Window.partitionBy(*keys).orderBy("_a", "_b")
    return p.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r", "_a", "_b")


def fit_pairwise(pairs: DataFrame, features: list[str], incumbent: list[float], *, epochs: int = 60, rate: float = 0.1, l2: float = 0.01) -> list[float]:
    """Pairwise logistic regression by full-batch gradient descent. pairs: a column of better minus worse for each
    feature, and weight. Every epoch is one aggregate over the cluster; only the gradient's sums come to the driver. A
    feature that never differs keeps the incumbent's weight."""
    stats = pairs.agg(*(F.sqrt(F.avg(F.col(f) * F.col(f))).alias(f) for f in features)).first()
    scale = np.array([stats[f] or 0.0 for f in features])
    live = scale > 0
    w = np.array(incumbent, float) * np.where(live, scale, 1.0)
    start = w.copy()
    for _ in range(epochs):
        z = sum((F.lit(float(w[i] / scale[i])) * F.col(f) for i, f in enumerate(features) if live[i]), F.lit(0.0))
        pull = F.col("weight") * (1 / (1 + F.exp(z)))
        g = pairs.agg(F.sum("weight").alias("n"), *(F.sum(pull * F.col(f)).alias(f) for f in features)).first()
        n = g["n"] or 1.0
        grad = np.array([(g[f] or 0.0) / (n * scale[i]) if live[i] else 0.0 for i, f in enumerate(features)]) - l2 * (w - start)
        w = w + rate * grad
    return [float(w[i] / scale[i]) if live[i] else float(incumbent[i]) for i in range(len(features))]


def accept(incumbent: float, candidate: float, *, queries: int, pairs: int, least_queries: int = 50, least_pairs: int = 200, gain: float = 0.005) -> tuple[bool, str]:
    """Whether a candidate's held-out quality replaces the incumbent's; a tie is refused."""
    if queries < least_queries or pairs < least_pairs:
        return False, "too little feedback"
    return (True, "better") if candidate >= incumbent + gain else (False, "no gain")


def resolve_golden(judgments: DataFrame, messages: DataFrame) -> DataFrame:
    """judgments: q, message_id, gain; messages: id, message_id. Each judgment with the rows' smallest id, null where no
    message has it: what is unresolved is reported, not dropped."""
    known = messages.groupBy("message_id").agg(F.min("id").alias("id"))
    return judgments.join(known, "message_id", "left").select("q", "message_id", "gain", "id", F.col("id").isNotNull().alias("resolved"))


def macro(per_query: DataFrame, floors: dict[str, float], unresolved: int = 0) -> DataFrame:
    """One row: the mean over queries of each metric that floors names, and ok: whether each reaches its floor and every
    judgment was resolved. No query at all is not ok."""
    m = per_query.agg(*(F.avg(c).alias(c) for c in floors))
    ok = F.lit(unresolved == 0)
    for c, floor in floors.items():
        ok = ok & F.coalesce(F.col(c) >= floor, F.lit(False))
    return m.withColumn("ok", ok)


def worst(per_query: DataFrame, n: int, by: str = "ndcg", key: str = "q") -> DataFrame:
    """The n queries with the lowest metric, ties by name."""
    return per_query.orderBy(by, key).limit(n)
