"""Candidate generators over a corpus: lexical, prefix, dense, entity, fuzzy, structured and recency. All give
doc_id, source, score and rank, rank 1 the best, ties to the smaller id."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6  # fixed values of the public BM25 formula
FIELD_WEIGHTS = {"subject": 8.0, "sender": 4.0, "recipients": 2.0, "body": 1.0, "attachment": 1.0, "note": 3.0, "summary": 2.0}


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: str = "body") -> DataFrame:
    """doc_id, field, term, pos, one row for each token."""
    return docs.select(F.col(id_col).alias("doc_id"), F.lit(field).alias("field"), F.posexplode(tokens(F.coalesce(F.col(text_col), F.lit("")))).alias("pos", "term"))


def postings(pos: DataFrame) -> DataFrame:
    return pos.groupBy("term", "doc_id", "field").agg(F.count(F.lit(1)).alias("tf"))


def doc_vocabulary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """term, docs and n like vocabulary(), from the texts: the words of each are counted within the row, so one row for
    each term of a document is summed, partly before the shuffle, and no list of documents is kept."""
    words = docs.select(tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("w"))
    once = words.select(F.explode(F.array_distinct("w")).alias("term"), F.lit(1).alias("docs"), F.lit(0).alias("n"))
    every = words.select(F.explode("w").alias("term"), F.lit(0).alias("docs"), F.lit(1).alias("n"))
    return once.unionByName(every).groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def term_positions(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """positions() of the given terms only: found inside the row, so no other word becomes a row."""
    wanted = F.array(*map(F.lit, sorted(set(terms))))
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    near = F.lit(False)
    for t in sorted(set(terms)):
        near = near | F.contains(low, F.lit(t))
    rows = docs.filter(near).select(F.col(id_col).alias("doc_id"), F.posexplode(tokens(F.col(text_col))).alias("pos", "term"))
    return rows.filter(F.array_contains(wanted, F.col("term"))).select("doc_id", F.lit("body").alias("field"), "pos", "term")


def vocabulary(pos: DataFrame) -> DataFrame:
    return pos.groupBy("term").agg(F.count_distinct("doc_id").alias("docs"), F.count(F.lit(1)).alias("n"))


def ranked(df: DataFrame, source: str, limit: int | None = None) -> DataFrame:
    """Adds source and rank. With a limit only that many rows are ordered and numbered."""
    order = [F.desc("score"), F.asc("doc_id")]
    if limit is not None:
        df = df.orderBy(*order).limit(limit)
    return df.withColumn("source", F.lit(source)).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def bm25(docs: DataFrame, terms: list[str], *, fields: dict[str, str] | None = None, id_col: str = "doc_id", weights: dict[str, float] | None = None, require_all: bool = True, prefix: bool = False, only: DataFrame | None = None) -> DataFrame:
    """doc_id and score of the documents that hold all terms (any, if not require_all). fields: column by field name.
    Term counts are computed within each row, so only the rows that match, with their counts, are shuffled. only: doc_id of
    the few documents to score; the statistics are those of all."""
    fields = fields or {"body": "text"}
    weights = weights or FIELD_WEIGHTS
    low = docs.select(F.col(id_col).alias("doc_id"), *(F.lower(F.coalesce(F.col(c), F.lit(""))).alias(f) for f, c in fields.items()))

    def same(term: str):
        return lambda w: F.startswith(w, F.lit(term)) if prefix else w == F.lit(term)

    def times(f: str, t: str) -> Column:
        """Texts are only cut into words where the term stands in them at all; lengths need no words, just their number."""
        return F.when(F.contains(f, F.lit(t)), F.size(F.filter(tokens(F.col(f)), same(t)))).otherwise(0)

    length = sum((F.regexp_count(f, F.lit(r"[\p{L}\p{N}]+")) for f in fields), F.lit(0))
    counted = low.select("doc_id", length.alias("dl"), *(sum((F.lit(weights.get(f, 1.0)) * times(f, t) for f in fields), F.lit(0.0)).alias(f"tf{i}") for i, t in enumerate(terms)))
    stats = counted.agg(F.count(F.lit(1)).alias("N"), F.avg("dl").alias("avgdl"), *(F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))))
    if only is not None:
        counted = counted.join(only, "doc_id", "left_semi")
    joined = counted.crossJoin(F.broadcast(stats))  # the statistics are one row

    def part(i: int) -> Column:
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.greatest(F.log((F.col("N") - df + 0.5) / (df + 0.5)), F.lit(IDF_FLOOR))
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))

    hits = [F.col(f"tf{i}") > 0 for i in range(len(terms))]
    keep = hits[0]
    for h in hits[1:]:
        keep = keep & h if require_all else keep | h
    return joined.filter(keep).select("doc_id", sum((part(i) for i in range(len(terms))), F.lit(0.0)).alias("score"))


def phrase_hits(pos: DataFrame, phrase: list[str]) -> DataFrame:
    """doc_id and the number of places where the words follow each other."""
    at = None
    for i, term in enumerate(phrase):
        own = pos.filter(F.col("term") == term).select("doc_id", (F.col("pos") - i).alias("start"))
        at = own if at is None else at.join(own, ["doc_id", "start"])
    return at.groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"))


def near_hits(pos: DataFrame, a: str, b: str, within: int = 10) -> DataFrame:
    """doc_id and the closest distance of the two words, where it is at most within. One pass over each document's
    occurrences: the neighbour before in the merged order is the closest of the other kind before it."""
    both = pos.filter(F.col("term").isin(a, b))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    other = F.when(F.col("term") == a, F.max(F.when(F.col("term") == b, F.col("pos"))).over(w)).otherwise(F.max(F.when(F.col("term") == a, F.col("pos"))).over(w))
    return both.withColumn("gap", F.col("pos") - other).groupBy("doc_id").agg(F.min("gap").alias("gap")).filter(F.col("gap") <= within)


def spell(vocab: DataFrame, term: str, *, least_docs: int = 2) -> DataFrame:
    """The best correction: edit budget by length (0 to 3 letters none, to 5 one, else two), then distance, documents, term."""
    budget = 0 if len(term) <= 3 else 1 if len(term) <= 5 else 2
    near = vocab.filter((F.col("docs") >= least_docs) & F.length("term").between(len(term) - budget, len(term) + budget))
    near = near.withColumn("distance", F.levenshtein("term", F.lit(term), budget)).filter("distance >= 0")
    return near.orderBy("distance", F.desc("docs"), "term").limit(1).select("term", "docs", "distance")


def pmi_synonyms(pos: DataFrame, pivot: str, n_docs: int, *, newest: int = 64, least: float = 1.0, together: int = 2, share: float = 0.6, top: int = 3) -> DataFrame:
    """Terms by pointwise mutual information with pivot over the newest documents that hold it."""
    doc_terms = pos.select("doc_id", "term").distinct()
    own = doc_terms.filter(F.col("term") == pivot).orderBy(F.desc("doc_id")).limit(newest).select("doc_id")
    pivots = own.agg(F.count(F.lit(1)).alias("n"))
    df = doc_terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    co = doc_terms.join(own, "doc_id", "left_semi").filter(F.col("term") != pivot).groupBy("term").agg(F.count(F.lit(1)).alias("co"))
    x = co.filter(F.col("co") >= together).join(df, "term").filter(F.col("df") <= share * n_docs).crossJoin(F.broadcast(pivots))
    x = x.withColumn("pmi", F.log((F.col("co") / F.col("n")) / (F.col("df") / F.lit(n_docs)))).filter((F.col("pmi") >= least) & F.col("n").between(2, share * n_docs))
    return x.orderBy(F.desc(F.round("pmi", 9)), "term").limit(top).select("term", F.round("pmi", 6).alias("pmi"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """v by its length, which is computed once. Nulls add nothing to it and stay; by a length of 0 one divides as IEEE 754
    does, which Spark's own division refuses."""
    own = F.filter(v, lambda x: x.isNotNull())
    by = lambda x, n: F.when(n == 0, x * float("inf")).otherwise(x / n)
    return F.transform(F.array(F.sqrt(dot(own, own))), lambda n: F.transform(v, lambda x: by(x.cast("double"), n)))[0]


def knn(vectors: DataFrame, query: list[float], k: int, *, id_col: str = "vec_id", vector_col: str = "embedding", units: bool = False) -> DataFrame:
    """The k nearest by cosine; one scan and a bounded heap, no shuffle. Where all vectors are known to be unit, units
    saves their lengths. A vector of zeros is at 0 from all."""
    q = F.array(*(F.lit(float(x)) for x in query))
    score = dot(F.col(vector_col), q)
    if not units:
        own = F.sqrt(dot(F.col(vector_col), F.col(vector_col))) * F.lit(math.sqrt(sum(x * x for x in query)))
        score = F.when(own > 0, score / own).otherwise(0.0)
    scored = vectors.select(F.col(id_col).alias("doc_id"), score.alias("score"))
    return ranked(scored, "dense", k)


def max_mean(vectors: DataFrame, query: list[float], group_col: str, *, vector_col: str = "embedding") -> DataFrame:
    """The best and the mean similarity of each group's vectors: partial sums, one small shuffle."""
    q = F.array(*(F.lit(float(x)) for x in query))
    s = vectors.select(group_col, dot(F.col(vector_col), q).alias("s"))
    return s.groupBy(group_col).agg(F.max("s").alias("cos_max"), F.avg("s").alias("cos_mean"))


def recency(at: Column, now: int, half_life_days: float = 30.0) -> Column:
    age = F.greatest(F.lit(0.0), (F.lit(now) - at) / 86400.0)
    return F.when(at.isNull(), 0.0).otherwise(F.exp(-age / half_life_days))


def subsequence_score(query: str, text: str | None) -> float:
    """How well the query's letters follow each other in the text: 16 a letter, 8 more next to the last, 8 at a word's
    start, less one for each letter skipped between. 0 if they do not all occur in order."""
    low, q = (text or "").lower(), query.lower().replace(" ", "")
    score, at, last = 0.0, 0, -2
    for c in q:
        i = low.find(c, at)
        if i < 0:
            return 0.0
        score += 16 + 8 * (i == last + 1) + 8 * (i == 0 or not low[i - 1].isalnum()) - (min(i - at, 15) if last >= 0 else 0)
        last, at = i, i + 1
    return score


def fuzzy(docs: DataFrame, query: str, text: Column, *, id_col: str = "doc_id", limit: int = 200) -> DataFrame:
    q = query

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: subsequence_score(q, t))

    # A cheap prefilter on the JVM side: every letter must occur.
    has_all = F.lit(True)
    for c in sorted(set(q.lower().replace(" ", ""))):
        has_all = has_all & F.contains(F.lower(text), F.lit(c))
    scored = docs.filter(has_all).select(F.col(id_col).alias("doc_id"), score(text).alias("score")).filter("score > 0")
    return ranked(scored, "fuzzy", limit)


def entity_lookup(mentions: DataFrame, wanted: DataFrame) -> DataFrame:
    """mentions: doc_id, kind, norm, confidence. wanted: kind, norm, boost, a query's few entities. The best mention of
    each entity counts, times its boost."""
    best = mentions.join(F.broadcast(wanted), ["kind", "norm"]).groupBy("doc_id", "kind", "norm").agg(F.max(F.col("confidence") * F.col("boost")).alias("s"))
    return best.groupBy("doc_id").agg(F.sum("s").alias("score"))
