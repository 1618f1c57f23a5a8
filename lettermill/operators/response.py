"""Response times over exchanges: message_id, contact, ours (who wrote), at (seconds), parent_id (what it answers)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY = 86_400


def dedupe(messages: DataFrame, key: str, id_col: str) -> DataFrame:
    """The first row of each key stays; rows with a null key all stay."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(id_col)
    keyed = messages.filter(F.col(key).isNotNull()).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    return keyed.unionByName(messages.filter(F.col(key).isNull()))


def pairs(exchange: DataFrame) -> DataFrame:
    """Replies with the seconds since what they answer, where the writer's side changes; negative ones are left out."""
    reply, parent = exchange.alias("r"), exchange.select(F.col("message_id").alias("p_id"), F.col("ours").alias("p_ours"), F.col("at").alias("p_at")).alias("p")
    p = reply.join(parent, F.col("r.parent_id") == F.col("p.p_id")).filter("r.ours <> p.p_ours AND r.at >= p.p_at")
    return p.select("r.message_id", "r.contact", "r.ours", "r.at", (F.col("r.at") - F.col("p.p_at")).alias("latency"))


def percentile(column: str, p: float):
    """Nearest rank, so always one of the values, whole seconds here."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})").cast("long")


def stats(of: DataFrame, keys: list[str], column: str = "latency") -> DataFrame:
    return of.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), percentile(column, 0.5).alias("p50"), percentile(column, 0.9).alias("p90"), F.avg(column).alias("mean"), F.min(column).alias("fastest"), F.max(column).alias("slowest"))


def bottlenecks(of: DataFrame, *, least: int = 3, seconds: int = 900, ratio: float = 2.0) -> DataFrame:
    """Contacts whose answers from us are slow: enough samples on both sides, and our median far above theirs."""
    ours, theirs = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY latency) FILTER (WHERE ours)").cast("long"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY latency) FILTER (WHERE NOT ours)").cast("long")
    g = of.groupBy("contact").agg(F.count_if("ours").alias("n1"), F.count_if(~F.col("ours")).alias("n2"), ours.alias("ours_p50"), theirs.alias("theirs_p50"))
    slower = (F.col("n1") >= least) & (F.col("n2") >= least) & (F.col("ours_p50") >= seconds) & (F.col("ours_p50") >= ratio * F.col("theirs_p50"))
    return g.select("contact", "ours_p50", "theirs_p50", slower.alias("slower"), (F.col("theirs_p50") / F.greatest(F.col("ours_p50"), F.lit(1))).alias("symmetry"))


def stalled(exchange: DataFrame, *, least: int = 3) -> DataFrame:
    """Contacts with whether as many of their messages are overdue as a sample must have."""
    contacts = exchange.filter("contact IS NOT NULL").select("contact").distinct()
    return contacts.join(overdue(exchange), "contact", "left").select("contact", (F.coalesce("overdue", F.lit(0)) >= least).alias("stalled"))


def answered(exchange: DataFrame) -> DataFrame:
    """Messages to us with whether we wrote to the contact at or after their time."""
    last = exchange.filter("ours").groupBy("contact").agg(F.max("at").alias("last_ours"))
    return exchange.filter("NOT ours").join(last, "contact", "left").withColumn("answered", F.coalesce(F.col("last_ours") >= F.col("at"), F.lit(False)))


def overdue(exchange: DataFrame) -> DataFrame:
    """Unanswered messages older than our usual slowest time (p90, a day at least), of contacts we have answered."""
    late = pairs(exchange).filter("ours").groupBy("contact").agg(F.greatest(percentile("latency", 0.9), F.lit(DAY)).alias("late"))
    now = exchange.agg(F.max("at").alias("now"))
    open_ = answered(exchange).filter("NOT answered").join(late, "contact").crossJoin(F.broadcast(now))  # now is one row
    return open_.filter("now - at > late").groupBy("contact").agg(F.count(F.lit(1)).alias("overdue"))


def trend(of: DataFrame, *, range_days: int = 90, window_days: int = 28, step_days: int = 7) -> DataFrame:
    """Rolling windows that end at the newest time and step back; half-open, and cut at the range's start. Each pair is
    dealt only to the windows that hold it, so there is no join with the windows at all."""
    newest = of.agg(F.max("at").alias("newest"))
    n = -(-range_days // step_days)
    t = of.crossJoin(F.broadcast(newest))  # newest is one row
    ends = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.col("newest") - k * step_days * DAY)
    start = F.col("newest") - range_days * DAY
    holds = F.filter(ends, lambda e: (F.col("at") < e) & (F.col("at") >= F.greatest(e - window_days * DAY, start)))
    return stats(t.select("latency", F.explode(holds).alias("until")), ["until"])


def report(exchange: DataFrame) -> DataFrame:
    """contact, total, samples, p50, p90 and overdue: a row for each contact that we answered, and one with total set over
    all of them (contact is null there)."""
    ours = pairs(exchange).filter("ours")
    rows = ours.rollup("contact").agg(F.grouping("contact").cast("boolean").alias("total"), F.count(F.lit(1)).alias("samples"), percentile("latency", 0.5).alias("p50"), percentile("latency", 0.9).alias("p90"))
    late = overdue(exchange).rollup("contact").agg(F.grouping("contact").cast("boolean").alias("total"), F.sum("overdue").alias("overdue"))
    late = late.select(F.col("contact").alias("c"), F.col("total").alias("t"), "overdue")
    return rows.join(late, F.expr("total = t AND contact <=> c"), "left").select("contact", "total", "samples", "p50", "p90", F.coalesce("overdue", F.lit(0)).alias("overdue"))
