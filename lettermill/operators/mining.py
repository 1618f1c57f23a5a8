"""Text mining over documents and pages: entities and their graph, links, redaction, injection, chunks, threads."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lettermill.functions.text import fold, letter_mask, luhn, mask_of
from lettermill.operators.retrieve import subsequence_score
from lettermill.session import cut

# Patterns that both Java and RE2 read.
ENTITY = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}",
    "number": r"[0-9]{9,}",
}


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, kind, value, one row for each mention; all on the JVM side."""
    each = [F.transform(F.regexp_extract_all(text_col, F.lit(p), F.lit(0)), _tag(kind)) for kind, p in ENTITY.items()]
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(F.concat(*each)).alias("e")).select("doc_id", "e.kind", "e.value")


def _tag(kind: str):
    return lambda v: F.struct(F.lit(kind).alias("kind"), (F.lower(v) if kind == "email" else v).alias("value"))


def cooccurrence(mentions: DataFrame, id_col: str, value_col: str) -> DataFrame:
    """src < dst and the number of documents that hold both. Mentions are made distinct first, so that a document that
    repeats an entity costs nothing more."""
    m = mentions.select(F.col(id_col).alias("d"), F.col(value_col).alias("v")).distinct()
    a, b = m.alias("a"), m.alias("b")
    return a.join(b, F.expr("a.d = b.d AND a.v < b.v")).groupBy(F.col("a.v").alias("src"), F.col("b.v").alias("dst")).agg(F.count(F.lit(1)).alias("weight"))


def orphan_edges(edges: DataFrame, mentions: DataFrame, id_col: str, value_col: str) -> DataFrame:
    """Edges whose ends no longer share a document."""
    live = cooccurrence(mentions, id_col, value_col)
    return edges.join(live.select("src", "dst"), ["src", "dst"], "left_anti")


def links(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    return pages.select(id_col, F.explode(F.regexp_extract_all(html_col, F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))


# The base score by class of link.
LINK_BASE = {"action": 0.92, "document": 0.78, "article": 0.70, "navigation": 0.40, "social": 0.18, "tracking": 0.05}


def scored_links(pages: DataFrame, id_col: str, html_col: str, url_col: str) -> DataFrame:
    """href, kind, n, score: the class's base, less for later places, more for repeats, less where the link's own text
    names another host."""
    pattern = r'<a href="([^"]*)"[^>]*>([^<]*)</a>'
    whole = F.regexp_extract_all(html_col, F.lit(pattern), F.lit(0))
    each = pages.select(id_col, url_col, F.posexplode(whole).alias("place", "a"))
    href, label = F.regexp_extract("a", pattern, 1), F.regexp_extract("a", pattern, 2)
    each = each.select(id_col, F.lower(href).alias("href"), label.alias("label"), "place")
    kind = F.when(F.col("href").rlike("confirm|verify|reset|sign|pay"), "action").when(F.col("href").rlike(r"\.(pdf|docx?|xlsx?|pptx?|csv)$"), "document").when(F.col("href").rlike("unsubscribe|track|click|pixel"), "tracking").when(F.col("href").rlike("facebook|twitter|linkedin|instagram"), "social").when(F.col("href").startswith("/"), "navigation").otherwise("article")
    base = F.element_at(F.create_map(*(F.lit(x) for kv in LINK_BASE.items() for x in kv)), F.col("kind"))
    shown = F.regexp_extract(F.lower("label"), r"([a-z0-9-]+(?:\.[a-z0-9-]+)+)", 1)
    deceptive = (shown != "") & F.col("href").startswith("http") & ~F.contains("href", shown)
    g = each.withColumn("kind", kind).withColumn("deceptive", deceptive).groupBy(id_col, "href", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place"), F.bool_or("deceptive").alias("deceptive"))
    score = base * F.exp(-F.col("place") / 50.0) + 0.02 * (F.col("n") - 1) - F.when(F.col("deceptive"), 0.10).otherwise(0.0)
    return g.select(id_col, "href", "kind", "n", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6).alias("score"))


# Redaction, in order of precedence.
REDACT = [
    ("EMAIL", re.compile(ENTITY["email"])),
    ("IBAN", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}\b")),
    ("CARD", re.compile(r"\b\d(?:[ -]?\d){12,18}\b")),
    ("SSN", re.compile(r"\b(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b")),
    ("SECRET", re.compile(r"""(?i)\b(?:token|secret|password|api[_-]?key)\s*[=:]\s*["']?([A-Za-z0-9_\-]{12,})""")),
    ("PHONE", re.compile(r"\+\d[\d ().-]{7,}\d")),
    ("OTP", re.compile(r"(?i)\bcode(?: is|:)? (\d{4,8})\b")),
]


def redact(text: str | None) -> tuple[str | None, dict[str, str]]:
    """The text with a token for each value (`⟦KIND_n⟧`, the same for the same value, numbered by first appearance), and
    the values by token, from which rehydrate restores it exactly."""
    if text is None:
        return None, {}
    spans: list[tuple[int, int, str]] = []
    for kind, pattern in REDACT:
        for m in pattern.finditer(text):
            a, b = m.span(1) if m.lastindex else m.span()
            if kind == "CARD" and not luhn(re.sub(r"\D", "", m.group())):
                continue
            if all(b <= x or y <= a for x, y, _ in spans):
                spans.append((a, b, kind))
    seen: dict[tuple[str, str], str] = {}
    counts: dict[str, int] = {}
    out, last = [], 0
    for a, b, kind in sorted(spans):
        value = text[a:b]
        if (kind, value) not in seen:
            counts[kind] = counts.get(kind, 0) + 1
            seen[kind, value] = f"⟦{kind}_{counts[kind]}⟧"
        out += [text[last:a], seen[kind, value]]
        last = b
    return "".join([*out, text[last:]]), {token: value for (_, value), token in seen.items()}


def rehydrate(text: str, values: dict[str, str]) -> str:
    return re.sub(r"⟦[A-Z]+_\d+⟧", lambda m: values.get(m[0], m[0]), text)


def redact_column():
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: redact(t)[0])

    return run


INJECTION = [
    ("instruction_override", "hostile", re.compile(r"(ignore|disregard|forget) (all |any )?(the )?(previous|prior|above) (instructions|rules)|new instructions:")),
    ("role_spoof", "hostile", re.compile(r"(^|\n)\s*(system|assistant)\s*:|<\|?(system|im_start)\|?>")),
    ("exfiltration", "hostile", re.compile(r"(send|forward|post|upload) (all|the|your) (messages|mail|data|password|contacts)")),
    ("invisible", "suspicious", re.compile("[​⁠﻿]")),
    ("bidi_control", "suspicious", re.compile("[‪-‮⁦-⁩]")),
    ("homoglyph", "suspicious", re.compile("[a-z][а-я]|[а-я][a-z]")),
    ("hidden_html", "suspicious", re.compile(r"display\s*:\s*none|font-size\s*:\s*0|visibility\s*:\s*hidden")),
]


def injections(text: str | None, most: int = 32) -> list[tuple[str, str, int, int]]:
    """kind, severity, start, end of what looks like words to a model rather than to the reader; at most `most`."""
    low = (text or "").lower()
    return sorted(((k, s, m.start(), m.end()) for k, s, p in INJECTION for m in p.finditer(low)), key=lambda x: (x[2], x[0]))[:most]


def scan_column(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    @F.pandas_udf("array<struct<kind:string,severity:string,start:int,stop:int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: [{"kind": k, "severity": v, "start": a, "stop": b} for k, v, a, b in injections(t)])

    return docs.select(id_col, F.explode(run(F.col(text_col))).alias("x")).select(id_col, "x.*")


def chunk_spans(text: str | None, tokens: int = 512, overlap: int = 64, least: int = 48) -> list[tuple[int, int]]:
    """Character spans of about tokens * 4 bytes; a cut goes to the last blank line, line, sentence or space in the last
    third, the next begins overlap tokens before it, and a short rest joins the chunk before."""
    text = text or ""
    size, back = tokens * 4, overlap * 4
    out: list[tuple[int, int]] = []
    at = 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            low = at + size * 2 // 3
            for mark in ("\n\n", "\n", ". ", " "):
                cut = text.rfind(mark, low, end)
                if cut >= 0:
                    end = cut + len(mark)
                    break
        if len(text) - end < least:
            end = len(text)
        out.append((at, end))
        if end == len(text):
            break
        at = max(end - back, at + 1)
    return out


def chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    @F.pandas_udf("array<struct<start:int,stop:int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: [{"start": a, "stop": b} for a, b in chunk_spans(t)])

    c = docs.select(id_col, text_col, F.posexplode(run(F.col(text_col))).alias("ordinal", "s"))
    text = F.expr(f"substring({text_col}, s.start + 1, s.stop - s.start)")
    return c.select(id_col, "ordinal", "s.start", "s.stop", F.ceil(F.octet_length(text) / 4.0).alias("tokens"))


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b, in either direction. node and root, the smallest node that edges lead to, for every node that an edge
    names. Each round a node takes the smallest label among its neighbours', then that label's own, so chains of n take
    about log n rounds; labels are cut to files between rounds."""
    pairs = edges.filter("a <> b").select("a", "b")
    both = cut(pairs.union(pairs.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("n1")).agg(F.min("root").alias("near"))
        step = cut(labels.join(near, F.col("node") == F.col("n1")).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root")))
        up = labels.select(F.col("node").alias("n2"), F.col("root").alias("top"))
        new = cut(step.join(up, F.col("root") == F.col("n2")).select("node", "old", F.least("root", "top").alias("root")))
        if new.filter("old <> root").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", "root")


def thread_components(messages: DataFrame, node_col: str, parent_col: str) -> DataFrame:
    """node and thread, the smallest message that replies connect it with, in whatever order they were numbered. A parent
    that is no message of the table connects nothing by itself."""
    nodes = messages.select(F.col(node_col).alias("node"), F.col(parent_col).alias("parent"))
    known = nodes.select(F.col("node").alias("k")).distinct()
    edges = nodes.join(known, F.col("parent") == F.col("k")).select(F.col("node").alias("a"), F.col("parent").alias("b"))
    roots = components(edges).withColumnRenamed("node", "n")
    return nodes.join(roots, F.col("node") == F.col("n"), "left").select("node", F.coalesce("root", "node").alias("thread"))


def threads(messages: DataFrame, *, days: int = 30) -> DataFrame:
    """messages: id, message_id, refs (array of message ids, answered ones and all before), account, subject (bare), reply
    (whether the subject says so) and at (seconds). id and thread, the smallest id of the thread.

    Messages that share any reference are one thread, whether or not what they refer to is there. A reply without a thread
    joins the newest one of its account and subject that began at most `days` before it; the lowest id names a thread."""
    own = messages.select("id", F.explode(F.array_distinct(F.concat(F.array("message_id"), F.coalesce("refs", F.array().cast("array<string>"))))).alias("ref")).filter("ref IS NOT NULL")
    first = own.groupBy("ref").agg(F.min("id").alias("first"))
    roots = components(own.join(first, "ref").select(F.col("id").alias("a"), F.col("first").alias("b"))).withColumnRenamed("node", "n")
    placed = messages.join(roots, F.col("id") == F.col("n"), "left").select("id", "account", "subject", "at", "reply", (F.col("root").isNull() & F.col("reply") & (F.col("subject") != "")).alias("lost"), F.coalesce("root", "id").alias("thread"))
    # Threads by their beginning, and lost replies, in one order of time; of each the last beginning before it.
    begun = placed.groupBy("thread").agg(F.min_by(F.struct("account", "subject"), F.struct("at", "id")).alias("k"), F.min("at").alias("at"), F.bool_and("lost").alias("lost")).filter("NOT lost")
    line = begun.select(F.col("k.account").alias("account"), F.col("k.subject").alias("subject"), "at", F.lit(0).alias("kind"), F.col("thread").alias("id"))
    line = line.unionByName(placed.filter("lost").select("account", "subject", "at", F.lit(1).alias("kind"), "id"))
    before = Window.partitionBy("account", "subject").orderBy("at", "kind", "id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("kind") == 0, F.struct(F.col("id").alias("thread"), "at")), ignorenulls=True).over(before)
    joined = line.withColumn("to", last).filter((F.col("kind") == 1) & (F.col("at") - F.col("to.at") <= days * 86_400)).select(F.col("id").alias("n"), F.col("to.thread").alias("found"))
    named = placed.join(joined, F.col("id") == F.col("n"), "left").select("id", F.coalesce("found", "thread").alias("thread"))
    return named.join(named.groupBy("thread").agg(F.min("id").alias("least")), "thread").select("id", F.col("least").alias("thread"))


def capped_mentions(mentions: DataFrame, id_col: str, value_col: str, most: int = 64) -> DataFrame:
    """Each document's distinct values, the first `most` in their order: what bounds the pairs of a document."""
    m = mentions.select(F.col(id_col).alias(id_col), F.col(value_col).alias(value_col)).distinct()
    w = Window.partitionBy(id_col).orderBy(value_col)
    return m.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")


def finder(entries: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """entries: id, name, kind, uses. Names that hold the query's letters in order, by how well they do, 40 more if equal,
    with a share for frequent use."""
    wanted = fold(query).replace(" ", "")

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: subsequence_score(wanted, fold(t or "")))

    m = entries.filter(letter_mask(F.col("name")).bitwiseAND(F.lit(mask_of(wanted))) == mask_of(wanted)).withColumn("fuzzy", score("name")).filter("fuzzy > 0")
    total = F.col("fuzzy") + F.when(F.lower("name") == query.lower(), 40.0).otherwise(0.0) + 10.0 * F.least(F.log1p("uses") / F.log1p(F.lit(1000.0)), F.lit(1.0))
    return m.select("id", "name", "fuzzy", F.round(total, 6).alias("score")).orderBy(F.desc("score"), F.desc("fuzzy"), F.length("name"), "id").limit(limit)
