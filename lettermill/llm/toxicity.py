"""Toxicity by a weighted finite-state grammar over clauses.

Five transducers are composed: insult, threat, target, negation and reported speech. The first reads the classes of a
clause's words and turns insults into weighted events; the others rewrite what it gives: a threat is an event of its own,
an event that a clause aims at somebody counts more, one under a negation less, and one inside reported speech less. A
document is scored by its matched clauses (their sum, the strongest, and their share of the clauses), not by its words.

The seed words of each class are fixed. More insults, with their weights, are learned from labelled documents: words and
word beginnings by their log-odds in toxic against other documents, one half of the sample; the other half fits the
logistic score of the clause features. Labels enter only through the rows that the caller calls training rows.

Defined results: null and empty texts, and those without a matched clause, have the score of no evidence. Texts are
read whole. Repeated rows get equal scores; a document with several labels is toxic if one says so. Without labelled
rows the seed words alone score. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.llm._common import Written, few_rows, row_batches

# Seed words, in English, French, German and Spanish.
INSULTS = "idiot moron stupid scum trash loser pathetic worthless disgusting clown imbecile dumbass crétin débile ordure connard trottel dummkopf abschaum imbécil estúpido basura".split()
THREATS = "kill hurt destroy beat shoot stab tuer frapper détruire töten schlagen vernichten matar golpear destruir".split()
TARGETS = "you your you're they them he she his her tu toi vous ton votre ils elles du dich dir euch ihr sie tú usted ustedes ellos vosotros".split()
NEGATIONS = "not no never isn't aren't wasn't don't ne pas jamais aucun nicht kein keine nie nunca jamás ningún".split()
REPORTS = "said says wrote called quoted claimed dit écrit déclare sagte schrieb nannte dijo escribió llamó".split()

#: Word classes: insult, threat, target, negation, report.
INSULT, THREAT, TARGET, NEGATION, REPORT = "ITYNR"
_SEEDS = {w: (c, 1.0) for c, ws in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS), (INSULT, INSULTS)) for w in ws}
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE = re.compile(r"[.!?;:\n]+")
STEMS = range(4, 9)


@dataclass
class Transducer:
    """Arcs (state, input) -> (next state, output, weight); any state is final. An input without an arc stays in place
    and comes out as it was, with weight 1. Weights multiply along a path."""

    arcs: dict[tuple, tuple] = field(default_factory=dict)
    start: object = 0

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, symbol, 1.0))

    def compose(self, other: Transducer, alphabet: Iterable[str]) -> Transducer:
        """First this one, then other on its output, over the inputs of alphabet."""
        alphabet = list(alphabet)
        first = (self.start, other.start)
        out, todo, seen = Transducer(start=first), [first], {first}
        while todo:
            a, b = state = todo.pop()
            for symbol in alphabet:
                a2, mid, w1 = self.step(a, symbol)
                b2, done, w2 = other.step(b, mid)
                out.arcs[state, symbol] = ((a2, b2), done, w1 * w2)
                if (a2, b2) not in seen:
                    seen.add((a2, b2))
                    todo.append((a2, b2))
        return out


def grammar(aimed: float = 1.5, denied: float = 0.5, reported: float = 0.7, threat: float = 0.6) -> Transducer:
    """E is an event. Its arc's weight is what the clause's context makes of it."""
    insult = Transducer({(0, INSULT): (0, "E", 1.0)})
    # A threat alone is none: it needs somebody it is aimed at, before or after it.
    threats = Transducer({(0, TARGET): ("aim", TARGET, 1.0), ("aim", THREAT): ("aim", "E", threat), (0, THREAT): ("wait", THREAT, 1.0), ("wait", TARGET): ("aim", "E", threat), ("wait", THREAT): ("wait", THREAT, 1.0)})
    target = Transducer({(0, TARGET): ("you", TARGET, 1.0), ("you", "E"): ("you", "E", aimed)})
    # A negation holds for the next event only.
    negation = Transducer({(0, NEGATION): ("not", NEGATION, 1.0), ("not", NEGATION): (0, NEGATION, 1.0), ("not", "E"): (0, "E", denied)})
    report = Transducer({(0, REPORT): ("told", REPORT, 1.0), ("told", "E"): ("told", "E", reported)})
    whole = insult
    for t in (threats, target, negation, report):
        whole = whole.compose(t, (INSULT, THREAT, TARGET, NEGATION, REPORT))
    return whole


@dataclass
class ToxicityModel:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    #: Of the features of a document, the bias first.
    weights: list[float] = field(default_factory=lambda: [-3.0, 1.5, 1.5, 0.5])
    cache_size: int = 200_000

    def classify(self, word: str) -> tuple[str, float] | None:
        """The class and weight of a lower-case word; None for most."""
        w = self.words.get(word, 0.0)
        for n in STEMS:
            if n <= len(word):
                w = max(w, self.stems.get(word[:n], 0.0))
        if w > 0:
            return INSULT, w
        return _SEEDS.get(word)

    def features(self, text: str | None, automaton: Transducer, cache: dict) -> tuple[float, float, float]:
        """The sum of the clauses' weights and the strongest, both as logarithms, and the share of matched clauses."""
        low = (text or "").lower()
        live = False
        for word in set(_WORD.findall(low)):
            found = cache.get(word, 0)
            if found == 0:
                if len(cache) > self.cache_size:
                    cache.clear()
                found = cache[word] = self.classify(word)
            live = live or found is not None and found[0] in (INSULT, THREAT)
        if not live:
            return 0.0, 0.0, 0.0
        total = strongest = 0.0
        matched = clauses = 0
        for clause in _CLAUSE.split(low):
            state, weight, any_word = automaton.start, 0.0, False
            for word in _WORD.findall(clause):
                any_word = True
                found = cache.get(word, 0)
                if found == 0:
                    found = self.classify(word)
                if found is not None:
                    state, out, w = automaton.step(state, found[0])
                    if out == "E":
                        weight += w * found[1]
            clauses += any_word
            if weight > 0:
                matched += 1
                total += weight
                strongest = max(strongest, weight)
        return math.log1p(total), math.log1p(strongest), matched / max(1, clauses)

    def score(self, text: str | None, automaton: Transducer, cache: dict) -> float:
        x = self.features(text, automaton, cache)
        z = self.weights[0] + sum(w * f for w, f in zip(self.weights[1:], x))
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, z))))


def candidate_terms(text: str | None) -> set[str]:
    """Words, and beginnings of words marked by a star."""
    found = set(_WORD.findall((text or "").lower()))
    return found | {w[:n] + "*" for w in found for n in STEMS if n <= len(w)}


def lexicon(counts: Iterable[tuple[str, int, int]], toxic: int, other: int, *, least: int = 4, odds: float = 3.0) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems with their log-odds, from (term, toxic documents, other documents). A term is kept if at least
    `least` toxic documents have it and its log-odds are at least `odds`."""
    words: dict[str, float] = {}
    stems: dict[str, float] = {}
    for term, t, n in counts:
        if t >= least:
            w = math.log((t + 0.5) / (toxic + 1)) - math.log((n + 0.5) / (other + 1))
            if w >= odds:
                if term.endswith("*"):
                    stems[term[:-1]] = w / 4
                else:
                    words[term] = w / 4
    return words, stems


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 60) -> list[float]:
    """Newton's method with a ridge on all but the bias."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    penalty = np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + penalty @ w
        move = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + penalty, grad)
        w -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return w.tolist()


def _sample(docs: DataFrame, labels: DataFrame, train: Column, id_col: str, text_col: str, label_col: str, sample_docs: int) -> DataFrame:
    """text, toxic and half (0 or 1): about sample_docs documents of either label, by a hash of the id."""
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("toxic")).filter("id IS NOT NULL AND toxic IS NOT NULL")
    marks = marks.groupBy("id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    rows = docs.filter(train).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sizes = {r.toxic: r["count"] for r in rows.select("id").join(marks, "id").groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, sample_docs / max(1, sizes.get(1, 0))))).otherwise(F.lit(min(1.0, sample_docs / max(1, sizes.get(0, 0)))))
    place = F.crc32(F.concat(F.lit("tox-sample:"), F.col("id").cast("string"))) / F.lit(2.0**32)
    # About 2 * sample_docs ids, by the shares above, so they may be sent to all executors and no text is shuffled.
    chosen = F.broadcast(marks.join(rows.select("id").distinct(), "id", "left_semi").filter(place < share))
    half = F.crc32(F.concat(F.lit("tox-half:"), F.col("id").cast("string"))) % 2
    return rows.join(chosen, "id").select("text", "toxic", half.cast("int").alias("half"))


def fit(docs: DataFrame, labels: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_docs: int = 2000, least: int = 4, odds: float = 3.0) -> ToxicityModel:
    """sample_docs bounds the labelled rows of each label that the classifier is fitted on. All terms of theirs that pass
    least and odds (see lexicon) are learned."""
    sample = _sample(docs, labels, train, id_col, text_col, label_col, sample_docs)

    def count(batches):
        for batch in few_rows(batches, 4096):
            texts, toxic, half = row_batches(batch, "text", "toxic", "half")
            seen = {0: Counter(), 1: Counter()}
            n = Counter()
            for text, label, h in zip(texts, toxic, half):
                if h == 0:
                    seen[label].update(candidate_terms(text))
                    n[label] += 1
            rows = [(t, seen[1][t], seen[0][t]) for t in seen[1].keys() | seen[0].keys()] + [("", n[1], n[0])]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["term", "toxic", "other"])

    counts = sample.mapInArrow(count, "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    counts = Written(counts, "terms")
    totals = counts.df.filter("term = ''").select("toxic", "other").first() or (0, 0)
    # The same bounds as the lexicon's, a little wider, so that only what it may keep comes to the driver.
    apart = F.log((F.col("toxic") + 0.5) / (totals[0] + 1)) - F.log((F.col("other") + 0.5) / (totals[1] + 1))
    top = counts.df.filter((F.col("term") != "") & (F.col("toxic") >= least) & (apart >= odds - 1e-6)).collect()
    model = ToxicityModel()
    model.words, model.stems = lexicon(sorted((r.term, r.toxic, r.other) for r in top), *totals, least=least, odds=odds)
    counts.drop()

    def measure(batches):
        automaton, cache = grammar(), {}
        for batch in few_rows(batches):
            texts, toxic, half = row_batches(batch, "text", "toxic", "half")
            rows = [(*model.features(t, automaton, cache), label) for t, label, h in zip(texts, toxic, half) if h == 1]
            yield pa.RecordBatch.from_arrays([pa.array([float(r[i]) for r in rows], pa.float64()) for i in range(4)], names=["a", "b", "c", "y"])

    seen = sample.mapInArrow(measure, "a double, b double, c double, y double").toPandas().sort_values(["a", "b", "c", "y"])
    if seen.y.nunique() == 2:
        model.weights = fit_logistic(seen[["a", "b", "c"]].to_numpy(), seen.y.to_numpy())
    return model


def score_documents(docs: DataFrame, model: ToxicityModel, *, id_cols: list[str], text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """id_cols with score and predicted, one row for each input row."""
    given = docs.select(*id_cols, F.col(text_col).alias("_text_"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])

    def run(batches):
        automaton, cache = grammar(), {}
        for batch in few_rows(batches):
            (texts,) = row_batches(batch, "_text_")
            scores = [model.score(t, automaton, cache) for t in texts]
            own = [batch.column(batch.schema.get_field_index(c)) for c in id_cols]
            yield pa.RecordBatch.from_arrays([*own, pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=[*id_cols, "score", "predicted"])

    return given.mapInArrow(run, f"{kinds}, score double, predicted int")
