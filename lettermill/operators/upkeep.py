"""What keeps an index and its users' state in order: caps, caches, reindexing, tags, notices and reranking."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from datetime import datetime, timedelta

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lettermill.session import cut


class OverCap(ValueError):
    """A scan that would read more rows than it may."""


def capped(df: DataFrame, cap: int | None = 250_000) -> DataFrame:
    """df, or OverCap: the rows are never cut silently. The probe stops at one row more than the cap. The cap is for rows
    that one process will hold; None is for a scan whose rows stay with the executors, which has neither cap nor probe."""
    if cap is not None and df.limit(cap + 1).count() > cap:
        raise OverCap(f"over {cap} rows")
    return df


def fan_out(arms: dict[str, Callable[[], DataFrame]], schema: str, spark: SparkSession) -> tuple[DataFrame, list[str]]:
    """The union of all arms, each a short list that is computed here; one that Spark cannot plan or run is left out and
    named. Mistakes in the arms' own Python code are raised."""
    out, failed = spark.createDataFrame([], schema), []
    for name, arm in arms.items():
        try:
            out = out.unionByName(cut(arm()))
        except (PySparkException, Py4JError):
            failed.append(name)
    return out, failed


def rerank(l1: DataFrame, verdicts: DataFrame) -> DataFrame:
    """l1: doc_id, score. verdicts: doc_id, place, of the same few rows. In the verdicts' order the rows take l1's scores
    from the best down, made strictly decreasing; an incomplete set of verdicts leaves l1 as it is."""
    by_score = Window.orderBy(F.desc("score"), "doc_id")
    ranked = l1.withColumn("r", F.row_number().over(by_score))
    slots = ranked.select("r", F.col("score").alias("slot"))
    judged = l1.select("doc_id").join(verdicts, "doc_id", "left")
    complete = judged.agg(F.bool_and(F.col("place").isNotNull()).alias("ok"))
    order = judged.withColumn("r", F.row_number().over(Window.orderBy("place", "doc_id")))
    new = order.join(slots, "r").select("doc_id", (F.col("slot") - F.col("r") * 1e-9).alias("new"))
    return ranked.join(new, "doc_id").crossJoin(F.broadcast(complete)).select("doc_id", F.when(F.col("ok"), F.col("new")).otherwise(F.col("score")).alias("score"))


def cache_key(query: str, filters: str, version: int, ranker: str) -> str:
    """A result is good for one corpus version and one ranker."""
    return hashlib.sha256("\0".join((query, filters, str(version), ranker)).encode()).hexdigest()


def fresh(cached_version: int, version: int, age: float, window: float = 5.0) -> bool:
    """A page stays good at its own version, or for a bounded time after."""
    return cached_version == version or age < window


def missing_vectors(texts: DataFrame, cache: DataFrame, model: str, dim: int) -> DataFrame:
    """texts: id, hash. What the cache (model, dim, hash) has no vector for."""
    own = cache.filter((F.col("model") == model) & (F.col("dim") == dim)).select("hash")
    return texts.join(own, "hash", "left_anti")


def reindex(messages: DataFrame, *, since=None, mailbox: str | None = None, ids: list[int] | None = None, id_col: str = "id", time_col: str = "at", mailbox_col: str = "mailbox") -> DataFrame:
    out = messages
    if since is not None:
        out = out.filter(F.col(time_col) >= F.lit(since))
    if mailbox is not None:
        out = out.filter(F.col(mailbox_col) == mailbox)
    return out if ids is None else out.filter(F.col(id_col).isin(ids))


def has_cycle(parents: DataFrame, depth: int = 64) -> bool:
    """parents: node, parent. Whether some node is its own ancestor; paths of more than depth links count as one. A cycle
    has paths of any length, so all that is asked is whether one of depth + 1 links exists: links are put together by
    squaring, as in raising to a power."""
    power = parents.filter("parent IS NOT NULL").select("node", "parent").distinct()
    left, whole = depth + 1, None

    def then(x: DataFrame, y: DataFrame) -> DataFrame:
        a, b = x.alias("a"), y.alias("b")
        return cut(a.join(b, F.col("a.parent") == F.col("b.node")).select(F.col("a.node").alias("node"), F.col("b.parent").alias("parent")).distinct())

    while True:
        if left & 1:
            whole = power if whole is None else then(whole, power)
            if whole.isEmpty():
                return False
        left >>= 1
        if not left:
            return True
        power = then(power, power)
        if power.isEmpty():
            return False


def resolve_suggestions(suggestions: DataFrame, decisions: DataFrame) -> DataFrame:
    """suggestions: id, tag; decisions: id, tag, accepted. state: accepted, rejected or pending."""
    return suggestions.join(decisions, ["id", "tag"], "left").withColumn("state", F.when(F.col("accepted").isNull(), "pending").when(F.col("accepted"), "accepted").otherwise("rejected")).drop("accepted")


def shadow(impressions: DataFrame, new_order: DataFrame) -> DataFrame:
    """impressions: q, doc_id, pos, engaged; new_order: q, doc_id, new_pos. The engaged results' reciprocal ranks now and
    under the other order, and how many shown results that order has never been judged on."""
    j = impressions.join(new_order, ["q", "doc_id"], "full")
    mean = lambda c: F.avg(F.when(F.col("engaged"), 1.0 / F.col(c)))
    return j.groupBy("q").agg(mean("pos").alias("now"), mean("new_pos").alias("then"), F.count_if(F.col("pos").isNull()).alias("unlabelled"))


def prune(log: DataFrame, *, oldest, rows: int, id_col: str, time_col: str) -> DataFrame:
    """By age and by number, newest ids first; ids may have gaps."""
    return log.filter((F.col(time_col) >= F.lit(oldest)) & (F.col(id_col) >= F.lit(nth_newest(log, id_col, rows))))


def nth_newest(log: DataFrame, id_col: str, rows: int, buckets: int = 1000) -> int:
    """The smallest id among the `rows` highest (unique integers). Ranges of ids are counted, at most `buckets` at a time,
    and the one that holds it is looked into again: no sort, and no more than the counts come to the driver."""
    low, high = log.agg(F.min(id_col), F.max(id_col)).first()
    if low is None or rows <= 0:
        return 0 if high is None else high + 1
    while True:
        width = (high - low) // buckets + 1
        inside = log.filter(F.col(id_col).between(low, high)).groupBy(F.floor((F.col(id_col) - low) / width).alias("b")).agg(F.count(F.lit(1)).alias("n"))
        for b, n in sorted(inside.collect(), reverse=True):
            if n >= rows:
                break
            rows -= n
        else:
            return low
        if width == 1:
            return low + b
        low, high = low + b * width, min(high, low + (b + 1) * width - 1)


def notify_step(notices: DataFrame, *, quiet_col: str, threshold: str | None, attempts: int = 3) -> DataFrame:
    """notices: id, tier, state, attempts, failed. pending goes to delivered, waits in quiet hours, is suppressed under
    the threshold, and fails after its attempts. An unknown threshold admits nothing."""
    order = ["low", "normal", "high", "critical"]
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("tier"))
    enough = rank >= order.index(threshold) + 1 if threshold in order else F.lit(False)
    go = F.when(F.col("state") != "pending", F.col("state")).when(~enough, "suppressed").when(F.col(quiet_col), "pending").when(~F.col("failed"), "delivered").when(F.col("attempts") + 1 >= attempts, "failed").otherwise("pending")
    tried = (F.col("state") == "pending") & enough & ~F.col(quiet_col)
    return notices.withColumns({"next": go, "tries": F.col("attempts") + tried.cast("int")})


_DAYS = "monday tuesday wednesday thursday friday saturday sunday".split()


def natural_time(phrase: str, now: datetime) -> datetime | None:
    """`tomorrow 9am`, `friday 14:30`, `in 2 hours`, `next week`; local wall clock in now's zone. None if it is none."""
    s = " ".join(phrase.lower().split())
    if m := re.fullmatch(r"in (\d+) (minute|hour|day|week)s?", s):
        n = int(m[1])
        step = {"minute": timedelta(minutes=n), "hour": timedelta(hours=n), "day": timedelta(days=n), "week": timedelta(weeks=n)}[m[2]]
        if m[2] in ("minute", "hour") and now.tzinfo is not None:
            from datetime import timezone

            return (now.astimezone(timezone.utc) + step).astimezone(now.tzinfo)  # hours that pass, whatever the clock does
        return now + step
    m = re.fullmatch(r"(today|tomorrow|next week|" + "|".join(_DAYS) + r")(?: (?:at )?(\d{1,2})(?::(\d{2}))?\s?(am|pm)?)?", s)
    if not m:
        return None
    if m[1] in _DAYS:
        ahead = (_DAYS.index(m[1]) - now.weekday()) % 7 or 7
    else:
        ahead = {"today": 0, "tomorrow": 1, "next week": 7}[m[1]]
    hour, minute = int(m[2] or 9), int(m[3] or 0)
    if m[4]:
        hour = hour % 12 + 12 * (m[4] == "pm")
    if hour > 23 or minute > 59:
        return None
    return (now + timedelta(days=ahead)).replace(hour=hour, minute=minute, second=0, microsecond=0)


def export_page(messages: DataFrame, *, after: int = 0, page: int = 256, ids: list[int] | None = None, thread: int | None = None, mailbox: str | None = None, where=None) -> DataFrame:
    """What an export takes next: the messages of all given selections with an id above the cursor, in order of id."""
    m = messages.filter(F.col("id") > after)
    if ids is not None:
        m = m.filter(F.col("id").isin(ids))
    for name, value in (("thread", thread), ("mailbox", mailbox)):
        if value is not None:
            m = m.filter(F.col(name) == value)
    return (m if where is None else m.filter(where)).orderBy("id").limit(page)


def ledger_query(ledger: DataFrame, limit: int, *, since=None, until=None, **equal) -> DataFrame:
    """Newest first, at most limit, of the rows that meet all the predicates that are given (at: half-open)."""
    rows = ledger
    if since is not None:
        rows = rows.filter(F.col("at") >= F.lit(since))
    if until is not None:
        rows = rows.filter(F.col("at") < F.lit(until))
    for name, value in equal.items():
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    return rows.orderBy(F.desc("id")).limit(limit)


def to_fire(hits: DataFrame, fired: DataFrame) -> DataFrame:
    """hits, fired: rule, id. Each pair that a tick has to fire: those not fired before, once however often they hit."""
    return hits.select("rule", "id").distinct().join(fired, ["rule", "id"], "left_anti")


def upsert_entities(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """entities: entity_id, kind, norm; mentions: kind, norm. The entities with a row for each new (kind, norm); those
    that were there keep their ids, new ones are numbered on in the order of kind and norm."""
    new = mentions.select("kind", "norm").distinct().join(entities, ["kind", "norm"], "left_anti")
    # Ranges of new entities are counted first, so no task numbers them all.
    parts = cut(new.repartitionByRange("kind", "norm").sortWithinPartitions("kind", "norm").withColumn("_at", F.monotonically_increasing_id()))
    per = parts.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # one row for each partition
    before = per.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    start = entities.agg(F.coalesce(F.max("entity_id"), F.lit(0)).alias("_last"))
    numbered = parts.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(before), "_part").crossJoin(F.broadcast(start))
    place = F.col("_at") - F.shiftleft(F.col("_part"), 33) + F.col("_before") + F.col("_last") + 1
    return entities.select("entity_id", "kind", "norm").unionByName(numbered.select(place.alias("entity_id"), "kind", "norm"))


def outbox_step(outbox: DataFrame, now: int, *, lease: int = 600) -> DataFrame:
    """outbox: id, state, due, started, outcome (sent, refused, cancel or null). Adds next: scheduled goes to sending when
    due, or to canceled; sending to sent or failed by its outcome, and to uncertain when it has none in time, as sending
    again could send twice. The others are final."""
    out = F.col("outcome")
    begun = F.when(out == "cancel", "canceled").when(F.col("due") <= now, "sending").otherwise("scheduled")
    ended = F.when(out == "sent", "sent").when(out == "refused", "failed").when(F.col("started") + lease <= now, "uncertain").otherwise("sending")
    return outbox.withColumn("next", F.when(F.col("state") == "scheduled", begun).when(F.col("state") == "sending", ended).otherwise(F.col("state")))
