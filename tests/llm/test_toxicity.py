import math
import random
import re

from pyspark.sql import functions as F

from lettermill.llm import toxicity
from lettermill.llm.queries import op1_toxicity


def weigh(symbols, automaton=None):
    automaton, state, total = automaton or toxicity.grammar(), None, 0.0
    state = automaton.start
    for s in symbols:
        state, out, w = automaton.step(state, s)
        total += w * (out == "E")
    return total


def test_context_changes_the_weight():
    assert weigh("I") == 1.0
    assert weigh("YI") == 1.5 and weigh("NI") == 0.5 and weigh("NNI") == 1.0
    assert abs(weigh("RI") - 0.7) < 1e-9 and abs(weigh("RYI") - 1.05) < 1e-9
    assert weigh("T") == 0.0 and abs(weigh("TY") - 0.6 * 1.0) < 1e-9 and weigh("YT") > weigh("TY")
    assert weigh("NII") == 1.5  # a negation holds for one event


def test_clauses_not_words():
    m, g = toxicity.ToxicityModel(), toxicity.grammar()
    assert m.features("You are an idiot. Fine.", g, {}) == m.features("Fine. You are an idiot.", g, {})
    assert m.features("never an idiot", g, {})[0] < m.features("an idiot", g, {})[0]
    assert m.features("kill time", g, {})[0] == 0 and m.features(None, g, {}) == (0.0, 0.0, 0.0)


def test_held_out_accuracy(spark):
    root = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.fit(docs, labels, ~held)
    got = toxicity.score_documents(docs.filter(held).join(labels.select("doc_id"), "doc_id"), model, id_cols=["doc_id"]).join(labels, "doc_id")
    n, right, toxic, found, said = got.agg(F.count(F.lit(1)), F.count_if(F.expr("predicted = toxic")), F.count_if(F.expr("toxic = 1")), F.count_if(F.expr("toxic = 1 AND predicted = 1")), F.count_if(F.expr("predicted = 1"))).first()
    assert right / n > 0.95 and found / toxic > 0.75 and found / said > 0.85


def slow_clause(seen):
    """The weight of a clause from its words' classes and weights, one rule after the other over the whole clause."""
    events = [("E" if c == "I" else c, w) for c, w in seen]
    out, aim, wait = [], False, False
    for c, w in events:  # threats: an event after somebody is named, or where somebody is named after it
        if c == "Y" and wait and not aim:
            c, w, aim = "E", 0.6 * w, True
        elif c == "Y":
            aim = True
        elif c == "T" and aim:
            c, w = "E", 0.6 * w
        elif c == "T":
            wait = True
        out.append((c, w))
    events, out, you = out, [], False
    for c, w in events:
        you = you or c == "Y"
        out.append((c, 1.5 * w if c == "E" and you else w))
    events, out, denied = out, [], False
    for c, w in events:
        if c == "E" and denied:
            w, denied = 0.5 * w, False
        elif c == "N":
            denied = not denied
        out.append((c, w))
    total, told = 0.0, False
    for c, w in out:
        told = told or c == "R"
        if c == "E":
            total += 0.7 * w if told else w
    return total


def slow_score(text, model):
    weights = []
    for clause in re.split(r"[.!?;:\n]+", (text or "").lower()):
        words = re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?", clause)
        if words:
            weights.append(slow_clause([k for k in map(model.classify, words) if k]))
    hits = [w for w in weights if w > 0]
    x = [math.log1p(sum(hits)), math.log1p(max(hits, default=0.0)), len(hits) / max(1, len(weights))]
    z = model.weights[0] + sum(a * b for a, b in zip(model.weights[1:], x))
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def test_grammar_as_rules_in_turn():
    whole, rng = toxicity.grammar(), random.Random(3)
    for _ in range(3000):
        symbols = rng.choices("ITYNR", k=rng.randint(0, 9))
        assert abs(weigh(symbols, whole) - slow_clause([(s, 1.0) for s in symbols])) < 1e-9


def test_as_by_brute_force(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    model = toxicity.fit(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = op1_toxicity(spark, small).collect()
    assert len(got) == len(texts)
    for r in got:
        want = slow_score(texts[r.doc_id], model)
        assert abs(r.score - want) < 1e-9 and r.predicted == (r.score >= 0.5)


def test_all_terms_are_learned(spark):
    """More terms than any table of fixed size would hold, and the same as from plain counts."""
    docs = [(i, " ".join(f"bad{chr(97 + j % 26)}{chr(97 + j // 26 % 26)}{chr(97 + j // 676)}" for j in range(2500)) if i % 2 else f"fine words {i}") for i in range(40)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS toxic")
    model = toxicity.fit(docs, labels, F.lit(True))
    assert len(model.words) == 2500 and "bad" not in model.words and "bad" + "a" in model.stems


def test_odd_rows(spark, odd, none_at_all):
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels, F.lit(True))
    got = toxicity.score_documents(odd, model, id_cols=["doc_id"]).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_documents(none_at_all, model, id_cols=["doc_id"]).count() == 0
    assert toxicity.fit(none_at_all, labels, F.lit(True)).words == {}
