"""Parsed queries as Spark predicates: one mask, the same for every retriever, which Catalyst pushes into the scans."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.plans.grammar import TEXT_KEYS, Filter, ParsedQuery, date_bounds, size_of

PRIORITY = ("low", "normal", "high", "critical")  # fixed values, in order of rank


@dataclass
class Fields:
    """Which columns of the table answer which key. Keys without an entry cannot be enforced. relations: for has, tag,
    filename, is and note, a table with a column of message ids, and the column that holds the value."""

    id: str
    text: dict[str, list[str]] = field(default_factory=dict)
    size: str | None = None
    time: str | None = None
    mailbox: str | None = None
    account: str | None = None
    thread: str | None = None
    attachments: str | None = None
    relations: dict[str, tuple[DataFrame, str, str]] = field(default_factory=dict)
    ai: dict[str, str] = field(default_factory=dict)


@dataclass
class Mask:
    """column: None where nothing constrains. never: a clause that no row can meet, so the whole is empty."""

    column: Column | None = None
    never: bool = False
    semi: list[tuple[DataFrame, bool]] = field(default_factory=list)  #: ids to keep, or to leave (True)
    dropped: list[str] = field(default_factory=list)  #: clauses that could not be enforced

    def apply(self, df: DataFrame, id_col: str) -> DataFrame:
        if self.never:
            return df.filter(F.lit(False))
        out = df if self.column is None else df.filter(self.column)
        for ids, negated in self.semi:
            out = out.join(ids.select(F.col(ids.columns[0]).alias(id_col)).distinct(), id_col, "left_anti" if negated else "left_semi")
        return out


def contains(column: str, value: str) -> Column:
    """Case-insensitive; the value's own wildcards are plain characters."""
    return F.lower(F.col(column)).contains(value.lower())


def glob_pattern(glob: str) -> str:
    """`*` and `?` as a regular expression over the whole value, without regard to case."""
    return "(?is)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


def null_safe_not(p: Column) -> Column:
    """A clause that is null does not hold, so its negation keeps the row."""
    return ~F.coalesce(p, F.lit(False))


def _clause(f: Filter, fields: Fields, today: date) -> Column | bool | None | DataFrame:
    """A predicate, a table of ids, False (no row can meet it) or None (cannot be enforced)."""
    key, value = f.key, f.value
    if key in TEXT_KEYS:
        columns = fields.text.get(key)
        if not columns:
            return None
        found = F.lit(False)
        for c in columns:
            found = found | F.coalesce(contains(c, value), F.lit(False))
        return found
    if key in ("larger", "smaller"):
        n = size_of(value)
        if n is None or fields.size is None:
            return None
        return F.col(fields.size) > n if key == "larger" else F.col(fields.size) < n
    if key in ("before", "after", "on", "date"):
        bounds = date_bounds(key, value, today)
        if bounds is None or fields.time is None:
            return None
        low, high = bounds
        p = F.lit(True)
        if low is not None:
            p = p & (F.col(fields.time) >= F.lit(low.isoformat()).cast("timestamp_ntz"))
        if high is not None:
            p = p & (F.col(fields.time) < F.lit(high.isoformat()).cast("timestamp_ntz"))
        return p
    if key in ("in", "account"):
        column = fields.mailbox if key == "in" else fields.account
        return None if column is None else F.lower(F.col(column).cast("string")) == value.lower()
    if key == "thread":
        if fields.thread is None:
            return None
        return F.col(fields.thread) == int(value) if re.fullmatch(r"-?\d+", value) else False
    if key == "has" and value == "attachment" and fields.attachments:
        return F.col(fields.attachments) == 1
    if key == "is" and value in ("pinned", "muted"):
        return False
    if key == "ai":
        part, _, want = value.replace(">", ":>").partition(":")
        column = fields.ai.get(part)
        if column is None:
            return None
        if part == "priority" and want.startswith(">"):
            if want[1:] not in PRIORITY:
                return False
            rank = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col(column))
            return rank > PRIORITY.index(want[1:]) + 1
        return F.col(column) == want if want else F.col(column).cast("boolean")
    name = value if key == "has" else key
    if name in fields.relations:
        ids, own, column = fields.relations[name]
        if key == "has":
            return ids.select(own)
        if key == "filename":
            return ids.filter(F.col(column).rlike(glob_pattern(value))).select(own)
        if key == "tag" and value.endswith("/*"):
            node = value[:-2].lower()
            tag = F.lower(F.col(column))
            return ids.filter((tag == node) | tag.startswith(node + "/")).select(own)
        if key == "note":
            return ids.filter(contains(column, value)).select(own)
        return ids.filter(F.lower(F.col(column)) == value.lower()).select(own)
    return None


def mask(query: ParsedQuery, fields: Fields, today: date) -> Mask:
    out = Mask()
    for f in query.filters:
        p = _clause(f, fields, today)
        if p is None:
            out.dropped.append(f"{f.key}:{f.value}")
        elif p is False:
            out.never = out.never or not f.negated  # a negated clause that never holds always does
        elif isinstance(p, DataFrame):
            out.semi.append((p, f.negated))
        else:
            p = null_safe_not(p) if f.negated else p
            out.column = p if out.column is None else out.column & p
    return out


@dataclass(frozen=True)
class Rule:
    """match: all or any of the column patterns; flags are held against an array column; sizes are inclusive."""

    match: str = "all"
    patterns: tuple[tuple[str, str], ...] = ()
    has_flags: tuple[str, ...] = ()
    lacks_flags: tuple[str, ...] = ()
    min_bytes: int | None = None
    max_bytes: int | None = None


def rule_predicate(rule: Rule, *, flags: str | None = None, size: str | None = None, most_chars: int = 65536) -> Column:
    """The rule as one predicate; patterns read at most most_chars of a value. No clause at all matches nothing."""
    parts = [F.coalesce(F.substring(F.col(c), 1, most_chars).rlike(p), F.lit(False)) for c, p in rule.patterns]
    if flags:
        parts += [F.coalesce(F.array_contains(flags, x), F.lit(False)) for x in rule.has_flags]
        parts += [~F.coalesce(F.array_contains(flags, x), F.lit(False)) for x in rule.lacks_flags]
    if size and rule.min_bytes is not None:
        parts.append(F.coalesce(F.col(size) >= rule.min_bytes, F.lit(False)))
    if size and rule.max_bytes is not None:
        parts.append(F.coalesce(F.col(size) <= rule.max_bytes, F.lit(False)))
    if not parts:
        return F.lit(False)
    out = parts[0]
    for p in parts[1:]:
        out = out & p if rule.match == "all" else out | p
    return out


def quiet(hour_of_day: Column, start: float, end: float) -> Column:
    """Quiet hours [start, end) on the local clock; they may pass midnight, and equal bounds are never quiet."""
    if start == end:
        return F.lit(False)
    inside = (hour_of_day >= start) & (hour_of_day < end)
    return inside if start < end else (hour_of_day >= start) | (hour_of_day < end)


def policy_mode(df: DataFrame, rules: DataFrame, *, account: str, folder: str, sender: str, default: str) -> DataFrame:
    """df with mode. rules: tier (folder, pattern, account), value, mode, of a bounded rule set. The first tier with a
    match decides, folder before pattern before account; within it the most restrictive mode (deny, ask, allow) wins."""
    tier = F.expr("CASE tier WHEN 'folder' THEN 1 WHEN 'pattern' THEN 2 ELSE 3 END")
    strict = F.expr("CASE r_mode WHEN 'deny' THEN 1 WHEN 'ask' THEN 2 ELSE 3 END")
    like = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower("value"), r"([.\\+^$|(){}\[\]])", r"\\$1"), r"\*", ".*"), r"\?", ".")
    r = rules.select(tier.alias("r_tier"), F.lower("value").alias("r_value"), F.concat(F.lit("^"), like, F.lit("$")).alias("r_like"), F.col("mode").alias("r_mode"))
    keyed = df.withColumn("_row", F.monotonically_increasing_id())
    hit = F.expr(f"(r_tier = 1 AND lower({folder}) = r_value) OR (r_tier = 2 AND lower({sender}) RLIKE r_like) OR (r_tier = 3 AND lower({account}) = r_value)")
    best = keyed.select(account, folder, sender).distinct().join(r, hit).groupBy(account, folder, sender).agg(F.min_by("r_mode", F.struct("r_tier", strict)).alias("_mode"))
    cond = F.expr(" AND ".join(f"a.{c} <=> b.{c}" for c in (account, folder, sender)))
    return df.alias("a").join(best.alias("b"), cond, "left").select("a.*", F.coalesce("b._mode", F.lit(default)).alias("mode"))
