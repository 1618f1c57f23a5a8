"""Fusion of candidate lists, collapse of threads and near copies, and what the fused rows are drawn from."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The order of the sources and their weights by intent; structured and prefix weigh 0.1 in each.
SOURCES = ["lexical", "dense", "fuzzy", "entity", "structured", "prefix", "recency"]
WEIGHTS = {
    "navigational": {"lexical": 1.0, "dense": 0.6, "fuzzy": 0.9, "entity": 0.7, "recency": 0.8, "structured": 0.1, "prefix": 0.1},
    "exploratory": {"lexical": 0.7, "dense": 1.0, "fuzzy": 0.4, "entity": 0.5, "recency": 0.3, "structured": 0.1, "prefix": 0.1},
    "lookup": {"lexical": 0.8, "dense": 0.5, "fuzzy": 0.6, "entity": 1.0, "recency": 0.4, "structured": 0.1, "prefix": 0.1},
}
RRF_K = 60


def _weight(weights: dict[str, float]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.col("source")), F.lit(0.0))


def best_hits(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("doc_id", "source").agg(F.min("rank").alias("rank"), F.max_by("score", -F.col("rank")).alias("score"))


def _fused(parts: DataFrame) -> DataFrame:
    """parts: doc_id, source, part. Adds which source gave most (ties to the earlier) and how many hit."""
    place = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    return parts.groupBy("doc_id").agg(F.sum("part").alias("score"), F.max_by("source", F.struct("part", -place)).alias("best_source"), F.count_distinct("source").alias("n_sources"))


def rrf(candidates: DataFrame, weights: dict[str, float], k: int = RRF_K) -> DataFrame:
    return _fused(best_hits(candidates).withColumn("part", _weight(weights) / (F.lit(k) + F.col("rank"))))


def linear(candidates: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Scores of each source brought to 0..1 (a constant source to 1), then weighted."""
    w = Window.partitionBy("source")
    low, high = F.min("score").over(w), F.max("score").over(w)
    norm = F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0)
    return _fused(best_hits(candidates).withColumn("norm", norm).withColumn("part", _weight(weights) * F.col("norm")))


def drop_prior_only(fused: DataFrame, candidates: DataFrame) -> DataFrame:
    """With free text, documents that no text retriever found go."""
    found = candidates.filter(F.col("source").isin("lexical", "dense", "fuzzy", "entity")).select("doc_id").distinct()
    return fused.join(found, "doc_id", "left_semi")


def collapse(fused: DataFrame, group_col: str) -> DataFrame:
    """The best of each group stays, with the others' ids in order; a null group never collapses."""
    own = F.when(F.col(group_col).isNull(), F.struct(F.lit(1).alias("a"), F.col("doc_id").alias("b"))).otherwise(F.struct(F.lit(0).alias("a"), F.col(group_col).cast("long").alias("b")))
    g = fused.withColumn("_g", own)
    w = Window.partitionBy("_g").orderBy(F.desc("score"), "doc_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    r = g.withColumn("_r", F.row_number().over(w)).withColumn("_all", F.collect_list("doc_id").over(whole))
    return r.filter("_r = 1").withColumn("collapsed", F.slice("_all", 2, 1 << 30)).drop("_g", "_r", "_all")


def _fnv1a(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def bigram_simhash(text: str | None, least: int = 12) -> int | None:
    """64 sign votes over hashed word pairs, as a signed number; None under `least` words."""
    words = [w for w in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()]
    if len(words) < least:
        return None
    hashes = np.array([_fnv1a(f"{a}\0{b}".encode()) for a, b in zip(words, words[1:])], "<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view("<i8")[0])


def simhash_column(chars: int = 4000):
    @F.pandas_udf("long")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: bigram_simhash(t[:chars] if t else t)).astype("Int64")

    return hashed


def leader_clusters(ranked: DataFrame, hash_col: str, distance: int = 3) -> DataFrame:
    """Greedy, in order of score: a row joins the first leader within distance, else leads. ranked: the fused few (a
    page's candidates), already limited; the order makes it sequential, so it runs in one task over doc_id and hash."""

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        leaders: list[tuple[int, int]] = []
        out = []
        for doc, h in zip(pdf.doc_id, pdf.h):
            lead = None if pd.isna(h) else next((d for d, x in leaders if ((int(h) ^ x) & 0xFFFFFFFFFFFFFFFF).bit_count() <= distance), None)
            if lead is None:
                lead = doc
                if not pd.isna(h):
                    leaders.append((doc, int(h)))
            out.append(lead)
        return pd.DataFrame({"doc_id": pdf.doc_id, "leader": out})

    few = ranked.select("doc_id", "score", F.col(hash_col).alias("h")).withColumn("one", F.lit(1))
    return few.groupBy("one").applyInPandas(lambda p: greedy(p.sort_values(["score", "doc_id"], ascending=[False, True])), "doc_id long, leader long")


def mmr(pdf: pd.DataFrame, k: int, balance: float = 0.7) -> pd.DataFrame:
    """Greedy selection of k rows by relevance (0..1) less similarity to those chosen. pdf: doc_id, score, h."""
    rest = pdf.sort_values(["score", "doc_id"], ascending=[False, True]).to_dict("records")
    low, high = pdf.score.min(), pdf.score.max()
    chosen: list[dict] = []

    def alike(a, b) -> float:
        return 0.0 if pd.isna(a) or pd.isna(b) else 1 - ((int(a) ^ int(b)) & 0xFFFFFFFFFFFFFFFF).bit_count() / 64

    while rest and len(chosen) < k:
        value = [balance * ((r["score"] - low) / (high - low) if high > low else 1.0) - (1 - balance) * max((alike(r["h"], c["h"]) for c in chosen), default=0.0) for r in rest]
        best = max(range(len(rest)), key=lambda i: (value[i], -i))
        chosen.append(rest.pop(best) | {"place": len(chosen) + 1})
    return pd.DataFrame(chosen, columns=["doc_id", "score", "h", "place"])[["doc_id", "place"]]


def diversify(ranked: DataFrame, hash_col: str, k: int = 10) -> DataFrame:
    few = ranked.select("doc_id", "score", F.col(hash_col).alias("h")).withColumn("one", F.lit(1))
    return few.groupBy("one").applyInPandas(lambda p: mmr(p, k), "doc_id long, place long")
