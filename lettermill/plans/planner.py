"""What a parsed query is made into before it runs: edit budgets, term weights and the intent."""

from __future__ import annotations

import re

from lettermill.plans.grammar import ParsedQuery

TERM_WEIGHTS = {"original": 1.0, "corrected": 1.2, "expansion": 0.35}  # fixed values
# Words that open a question, that ask for a fact, that ask for a topic, and dates said in words.
QUESTION = set("who what when where why how which whose did does do should could would can is are am".split())
LOOKUP = set("tracking track bill confirmation receipt order number account reference statement package parcel shipment balance".split())
EXPLORATORY = set("everything about anything related regarding stuff discussion discussions thread threads mentions topics overview".split())
RELATIVE_DATES = ["today", "yesterday", "last week", "this week", "last month", "this month", "last year", "this year"]

# Weights of the intent's features, with the bias last. The features: words/8, operator, phrase, question
# word, known contact, date signal, entity pattern, lookup share, exploratory share.
INTENT_WEIGHTS = {
    "navigational": [-0.6, 2.2, 1.4, -2.0, 2.0, 1.6, 0.0, -0.5, -1.0, 0.4],
    "exploratory": [1.4, -1.2, -0.8, 2.4, -0.4, -0.6, -1.0, -0.8, 3.0, 0.0],
    "lookup": [-0.2, -0.4, -0.4, -1.5, -0.3, -0.2, 2.5, 3.5, -0.8, -0.3],
}
_ENTITY = re.compile(r"@|https?://|\b[A-Z]{2}\d{2}[A-Z0-9]{10,}\b|\b\d{6,}\b|\b[A-Z]+-\d+\b")


def edit_budget(term: str) -> int:
    return 0 if len(term) <= 3 else 1 if len(term) <= 5 else 2


def intent_features(terms: list[str], *, raw: str | None = None, phrases: int = 0, operator: bool = False, contact: bool = False, dated: bool = False) -> list[float]:
    """raw: the query as it was typed (its terms, if not given). Only its first word can make it a question, and phrases
    count like terms. dated: a date operator stands in it; a date said in words is found here."""
    raw = " ".join(terms) if raw is None else raw
    low, typed = [t.lower() for t in terms], raw.lower().split()
    n = len(low) + phrases
    return [
        min(n, 8) / 8,
        float(operator),
        float(phrases > 0),
        float(typed[:1] != [] and typed[0] in QUESTION),
        float(contact),
        float(dated or any(f" {x} " in f" {' '.join(typed)} " for x in RELATIVE_DATES)),
        float(bool(_ENTITY.search(raw))),
        sum(t in LOOKUP for t in low) / max(1, n),
        sum(t in EXPLORATORY for t in low) / max(1, n),
    ]


def classify_intent(terms: list[str], **signals) -> str:
    """The intent with the highest score; ties to the first in the table."""
    x = [*intent_features(terms, **signals), 1.0]
    scores = {k: sum(a * b for a, b in zip(w, x)) for k, w in INTENT_WEIGHTS.items()}
    return max(scores, key=lambda k: scores[k])


def plan(query: ParsedQuery) -> dict:
    """Terms with weights, phrases, exclusions and intent."""
    dated = any(f.key in ("before", "after", "on", "date") for f in query.filters)
    return {
        "terms": [(w.lower(), TERM_WEIGHTS["original"]) for w in query.words],
        "phrases": [p.lower() for p in query.phrases],
        "excluded": [t.text.lower() for t in query.terms if t.negated],
        "intent": classify_intent(query.words, raw=query.raw, phrases=len(query.phrases), operator=bool(query.filters), dated=dated),
    }
