"""Features of candidates, the linear ranker with its explanation, and what is shown of a result."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.operators.retrieve import recency

# The cold-start weights of the first ranker; other features weigh nothing.
L1_WEIGHTS = {
    "rrf_score": 1.0, "bm25_subject": 0.9, "bm25_body": 0.35, "cos_max_chunk": 0.8, "cos_mean_chunk": 0.3, "exact_phrase_hit": 0.6,
    "term_coverage": 0.4, "sender_affinity": 0.5, "user_replied_thread": 0.3, "recency_decay": 0.45, "ai_priority": 0.25,
    "is_flagged": 0.2, "is_unread": 0.15, "has_tag": 0.15, "has_attachment": 0.2, "is_newsletter": -0.4, "is_automated": -0.25,
}
FOLDER_PRIOR = {"inbox": 1.0, "archive": 0.6, "sent": 0.5, "spam": 0.05, "trash": 0.02}  # fixed values; others 0.4

SENDER_CAP, BULK_SHARE = 20, 0.3  # fixed values: messages that count in full, what bulk senders keep of their reputation


def saturate(n: Column, cap: int) -> Column:
    return F.least(F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)), F.lit(cap)) / F.lit(float(cap))


def coverage(words: Column, terms: list[str]) -> Column:
    """The share of the distinct terms that the words hold; 1 for no terms."""
    distinct = sorted(set(terms))
    if not distinct:
        return F.lit(1.0)
    return F.size(F.array_intersect(F.array(*map(F.lit, distinct)), words)) / F.lit(float(len(distinct)))


def folder_prior(folder: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in FOLDER_PRIOR.items() for x in kv)), F.lower(folder)), F.lit(0.4))


def bulk_flags(sender: Column, subject: Column) -> tuple[Column, Column]:
    both = F.lower(F.concat_ws(" ", sender, subject))
    return both.rlike("newsletter|digest|unsubscribe|weekly|marketing"), both.rlike("no-?reply|donotreply|notification|automated|alert|mailer-daemon")


def sender_affinity(messages: Column, last_at: Column, now: int) -> Column:
    """How much a sender writes, times how lately; 0 for one never seen."""
    return saturate(messages, SENDER_CAP) * recency(last_at, now)


def sender_reputation(messages: Column, bulk: Column) -> Column:
    """How much a sender writes; senders in bulk keep a share of it."""
    return saturate(messages, SENDER_CAP) * F.when(bulk, BULK_SHARE).otherwise(1.0)


def date_intent(at: Column, ranges: list[tuple[int | None, int | None, bool]]) -> Column:
    """Whether a time lies in all ranges (from, before, negated), half-open, outside those that are negated. False where
    no range is asked for and for null times."""
    inside = F.lit(bool(ranges))
    for low, high, negated in ranges:
        within = (F.lit(True) if low is None else at >= low) & (F.lit(True) if high is None else at < high)
        inside = inside & (~within if negated else within)
    return F.coalesce(inside & at.isNotNull(), F.lit(False))


def replied_threads(messages: DataFrame, thread_col: str, answered: Column) -> DataFrame:
    """messages with replied: whether any message of the thread was answered; false without a thread. Threads that were
    answered are made distinct first, so a long thread costs one row on that side."""
    told = messages.filter(answered).filter(F.col(thread_col).isNotNull()).select(F.col(thread_col).alias("_told")).distinct()
    j = messages.join(told, F.col(thread_col) == F.col("_told"), "left")
    return j.withColumn("replied", F.col("_told").isNotNull()).drop("_told")


def best_field(scores: dict[str, Column]) -> Column:
    """The field with the highest score above 0, ties to the earlier; null for none."""
    top = F.greatest(*scores.values(), F.lit(0.0))
    out = F.lit(None).cast("string")
    for name, s in reversed(scores.items()):
        out = F.when((s > 0) & (s == top), name).otherwise(out)
    return out


def l1_score(intent: str = "exploratory") -> tuple[Column, dict[str, float]]:
    """The ranker as one expression over columns named like its features, and the weights that hold for the intent."""
    w = dict(L1_WEIGHTS)
    if intent == "navigational":
        w["is_newsletter"] = 0.0
    if intent in ("navigational", "lookup"):
        w["is_automated"] = 0.0
    return sum((F.lit(x) * finite(F.col(n)) for n, x in w.items()), F.lit(0.0)), w


def finite(x: Column) -> Column:
    x = x.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def explain(df: DataFrame, id_col: str, weights: dict[str, float]) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(n).alias("feature"), finite(F.col(n)).alias("value"), F.lit(w).alias("weight")) for n, w in weights.items()))
    e = df.select(id_col, F.explode(rows).alias("x"))
    return e.select(id_col, "x.feature", "x.value", "x.weight", (F.col("x.value") * F.col("x.weight")).alias("product"))


def min_span(words: list[str], terms: list[str]) -> int | None:
    """The fewest words between the first and the last of a window that holds every distinct term (two at least), as
    the difference of places plus one less one; None if there is none."""
    need = set(terms)
    if len(need) < 2:
        return None
    last: dict[str, int] = {}
    best = None
    for i, w in enumerate(words):
        if w in need:
            last[w] = i
            if len(last) == len(need):
                span = i - min(last.values())
                best = span if best is None else min(best, span)
    return None if best is None else best + 1


def covering_span(words: Column, terms: list[str]) -> Column:
    """min_span as an expression: the words are cut down to the terms' places, over which one pass keeps the last place
    of each term."""
    need = sorted(set(terms))
    n = len(need)
    if n < 2:
        return F.lit(None).cast("int")
    named = F.array(*map(F.lit, need))
    coded = F.filter(F.transform(words, lambda w, i: F.when(F.array_contains(named, w), i * n + F.array_position(named, w).cast("int") - 1).otherwise(-1)), lambda x: x >= 0)
    state = lambda last, best: F.struct(last.alias("last"), best.alias("best"))

    def step(s: Column, x: Column) -> Column:
        place, term = F.floor(x / n).cast("int"), (x % n).cast("int")
        last = F.transform(s["last"], lambda p, k: F.when(k == term, place).otherwise(p))
        return state(last, F.when(F.array_min(last) >= 0, F.least(s["best"], place - F.array_min(last) + 1)).otherwise(s["best"]))

    return F.aggregate(coded, state(F.array_repeat(F.lit(-1), n), F.lit(None).cast("int")), step, lambda s: s["best"])


def snippet(text: str | None, terms: list[str], size: int = 220) -> tuple[str, list[tuple[int, int]]]:
    """The stretch of about size characters that holds the most matches, cut at words, with its matches' places."""
    text = text or ""
    marks = [(m.start(), m.end()) for t in sorted(set(terms)) if t for m in re.finditer(rf"(?i)\b{re.escape(t)}", text)]
    marks.sort()
    if not marks:
        cut = text[:size]
        return (cut if len(text) <= size else cut.rsplit(" ", 1)[0]).strip(), []
    inside = [sum(a <= x < a + size for x, _ in marks) for a, _ in marks]
    first = marks[inside.index(max(inside))][0]
    start = max(0, min(first - size * 2 // 5, len(text) - size))
    if start:
        start = text.find(" ", start, first) + 1 or start
    end = min(len(text), start + size)
    if end < len(text):
        end = max(text.rfind(" ", first + 1, end), first + 1) if " " in text[first + 1 : end] else end
    merged: list[tuple[int, int]] = []
    for a, b in marks:
        if start <= a and b <= end:
            a, b = a - start, b - start
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
    return text[start:end], merged
