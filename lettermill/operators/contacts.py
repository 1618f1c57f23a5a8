"""Insight into contacts and senders: cadence, decay, topics, classes and unsubscribing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermill.operators.response import percentile

STOP = "the and for with this that from are was you your".split()


def cadence(messages: DataFrame) -> DataFrame:
    """messages: contact, id, at, outbound. Gaps between a contact's messages, its silence, and whether it fades."""
    w = Window.partitionBy("contact").orderBy("at", "id")
    span = messages.agg(F.max("at").alias("now"), F.min("at").alias("first"))
    g = messages.withColumn("gap", F.col("at") - F.lag("at").over(w)).crossJoin(F.broadcast(span))  # span is one row
    middle = F.expr("(now + first) div 2")
    s = g.groupBy("contact").agg(
        F.count(F.lit(1)).alias("messages"), F.avg(F.col("outbound").cast("double")).alias("direction"), F.min("at").alias("first_at"), F.max("at").alias("last_at"),
        percentile("gap", 0.5).alias("median_gap"), F.max("gap").alias("longest_gap"), F.count_if(F.col("at") >= middle).alias("recent"), F.count_if(F.col("at") < middle).alias("prior"), F.first("now").alias("now"),
    )
    silence = F.col("now") - F.col("last_at")
    return s.withColumns({"silence": silence, "dormant": silence > F.greatest(3 * F.col("median_gap"), F.lit(30 * 86400)), "declining": F.col("recent") / F.greatest(F.col("prior"), F.lit(1)) < 0.5})


def dormant(known: DataFrame, messages: DataFrame) -> DataFrame:
    """contact and dormant of every known contact; one that never wrote is dormant."""
    return known.select("contact").distinct().join(cadence(messages).select("contact", "dormant"), "contact", "left").select("contact", F.coalesce("dormant", F.lit(True)).alias("dormant"))


def topics(messages: DataFrame, contact_col: str, id_col: str, subject_col: str, top: int = 8) -> DataFrame:
    words = F.filter(F.split(F.lower(subject_col), r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) >= 3) & ~w.rlike("^[0-9]+$") & ~w.isin(STOP))
    t = messages.select(F.col(contact_col).alias(contact_col), id_col, F.explode(F.array_distinct(words)).alias("term"))
    df = t.groupBy(contact_col, "term").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    w = Window.partitionBy(contact_col).orderBy(F.desc("df"), "term")
    return df.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top).drop("r")


def recipients(column: str) -> Column:
    """The bare addresses of a comma list."""
    return F.transform(F.split(column, ","), lambda a: F.lower(F.trim(F.when(a.contains("<"), F.regexp_extract(a, "<([^>]*)>", 1)).otherwise(a))))


def sender_class(*, least: int = 4, low: int = 43_200, high: int = 8_640_000) -> Column:
    """newsletter, transactional, automated, personal or unknown, from columns unsubscribe, automated, messages, replies
    and median_gap: regular mail with a way out, any with a way out, machines, people."""
    regular = (F.col("messages") >= least) & F.col("median_gap").between(low, high)
    return F.when(F.col("unsubscribe") & regular, "newsletter").when(F.col("unsubscribe"), "transactional").when(F.col("automated"), "automated").when((F.col("replies") > 0) | (F.col("messages") >= 2), "personal").otherwise("unknown")


def unsubscribe_candidate(*, messages: int = 5, read_rate: float = 0.2, replies: int = 0) -> Column:
    return F.col("class").isin("newsletter", "transactional") & (F.col("replies") <= replies) & (F.col("messages") >= messages) & (F.col("read_rate") <= read_rate) & F.col("unsubscribe")


def unsubscribe_links(header: Column) -> list[Column]:
    return [F.regexp_extract(header, "<(https://[^>]+)>", 1).alias("web"), F.regexp_extract(header, "<mailto:([^>]+)>", 1).alias("mail")]


def report(senders: DataFrame, limit: int) -> DataFrame:
    """senders: sender, candidate, unread, messages. In the report's order, with the total before the limit."""
    total = senders.agg(F.count(F.lit(1)).alias("total"))
    top = senders.orderBy(F.desc("candidate"), F.desc("unread"), F.desc("messages"), "sender").limit(limit)
    return top.crossJoin(F.broadcast(total))  # the total is one row
