import math
import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from lettermill.llm import language
from lettermill.llm.queries import op7_language_id


def test_held_out_accuracy(spark, small):
    got = op7_language_id(spark, small)
    truth = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang")
    both = got.join(truth, "doc_id").filter("held_out AND lang_pred <> 'und'")
    n, right = both.agg(F.count(F.lit(1)), F.count_if(F.expr("lang = lang_pred"))).first()
    assert n > 20 and right / n >= 0.95
    assert got.filter("score < 0 OR score > 1").count() == 0


def model_of(counts, longest=5):
    """A model of all words and n-grams."""
    grams = Counter()
    for lang, word, n in counts:
        for g in language.grams_of(word, longest):
            grams[lang, g] += n
    return language.LanguageModel.from_counts(counts, [(x, g, n) for (x, g), n in grams.items()], longest)


def slow_model(counts, longest=5, word_min=2, gram_min=3):
    """Log frequencies as the method states them: {word: {lang: log}} and {n: {gram: {lang: log}}}."""
    langs = sorted({x[0] for x in counts})
    words, grams = {}, {n: {} for n in range(1, longest + 1)}
    for lang, word, n in counts:
        words.setdefault(word, dict.fromkeys(langs, 0))[lang] += n
        padded = f" {word} "
        for m in grams:
            for i in range(len(padded) - m + 1):
                if padded[i : i + m] != " ":
                    grams[m].setdefault(padded[i : i + m], dict.fromkeys(langs, 0))[lang] += n
    words = {w: v for w, v in words.items() if sum(v.values()) >= word_min}
    grams = {m: {g: v for g, v in t.items() if sum(v.values()) >= gram_min} for m, t in grams.items()}

    def logs(table):
        totals = {x: sum(v[x] + 0.5 for v in table.values()) for x in langs}
        return {w: {x: math.log((v[x] + 0.5) / totals[x]) for x in langs} for w, v in table.items()}

    return langs, logs(words), {m: logs(t) for m, t in grams.items()}


def slow_predict(text, model, evidence=20):
    langs, words, grams = model
    found = language.words_of(text)
    if not found or not langs:
        return "und", 0.0
    total = dict.fromkeys(langs, 0.0)
    for word in found:
        hits = [words[word]] if word in words else []
        for m in sorted(grams, reverse=True):
            if not hits:
                hits = [grams[m][f" {word} "[i : i + m]] for i in range(len(word) + 3 - m) if f" {word} "[i : i + m] in grams[m]]
        for x in langs if hits else ():
            total[x] += sum(h[x] for h in hits) / len(hits)
    best = max(langs, key=lambda x: (total[x], [-ord(c) for c in x]))
    scale = min(len(found), evidence) / len(found)
    return best, 1 / sum(math.exp((total[x] - total[best]) * scale) for x in langs)


def test_as_by_brute_force(spark, small):
    """The query against a plain scorer that learns from the same rows, on every text."""
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang").collect()
    counts = Counter()
    for r in rows:
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:  # fewer than the sample's bound
            counts.update((r.lang, w) for w in language.words_of(r.text))
    model = slow_model([(x, w, n) for (x, w), n in counts.items()])
    got = {r.doc_id: r for r in op7_language_id(spark, small).collect()}
    assert len(got) == len(rows)
    for r in rows:
        lang, score = slow_predict(r.text, model)
        assert got[r.doc_id].lang_pred == lang and abs(got[r.doc_id].score - score) < 1e-9
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_words_first_then_shorter_and_shorter_grams():
    m = model_of([("a", "hello", 50), ("b", "bonjour", 50), ("b", "hello", 1)])
    say = language.Predictor(m).predict
    assert m.word_scores("hello").tolist() == m.logs[m.words["hello"]].tolist()
    assert say("hello")[0] == "a" and say("bonjouuur")[0] == "b"
    assert m.word_scores("qqq") is None
    assert say("日本")[0] == "a"  # no evidence at all: a tie, to the smaller name


def test_ties_go_to_the_smaller_name():
    m = model_of([("b", "same", 3), ("a", "same", 3)])
    assert language.Predictor(m).predict("same samf zzz") == ("a", 0.5)


def test_what_is_kept_changes_nothing():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefg", k=rng.randint(1, 9))) for _ in range(400)]
    m = model_of([("ab"[i % 2], w, 1 + i % 5) for i, w in enumerate(sorted(set(words[:150])))])
    texts = [" ".join(rng.choices(words, k=30)) for _ in range(60)]
    small, large = language.Predictor(m, kept_words=3, at_once=7), language.Predictor(m)
    for t in texts + texts[::-1]:
        a, b = small.predict(t), large.predict(t)
        assert a[0] == b[0] and abs(a[1] - b[1]) < 1e-12 and large.predict(t) == b
    assert len(small.kept) <= 3


def test_odd_rows(odd, none_at_all):
    model = language.fit(odd)
    got = {r.doc_id: r for r in language.identify(odd, model, id_cols=["doc_id"]).collect()}
    assert len(got) == odd.select("doc_id").distinct().count()
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2, 7))
    assert got[3].lang_pred == "en"
    nothing = language.fit(none_at_all)
    assert language.identify(odd, nothing, id_cols=["doc_id"]).filter("lang_pred <> 'und'").count() == 0
    assert language.identify(none_at_all, model, id_cols=["doc_id"]).count() == 0


def test_not_letters():
    assert language.words_of("½ ² x2y ٣ _z_") == ["x", "y", "z"]


def test_long_words_are_read_whole():
    m = model_of([("a", "abcab", 50), ("b", "xyzxy", 50)])
    at_work = language.Predictor(m)
    assert at_work.predict("abc" * 21 + "xyz" * 400)[0] == "b" and not at_work.kept
    # No word end is put behind the 64th letter.
    m = model_of([("a", "aq", 50), ("b", "bz", 20)])
    assert m.word_scores("y" * 62 + "aq" + "y" * 9).tolist() == m.logs[m.grams["aq"]].tolist() != m.logs[m.grams["aq "]].tolist()


def test_all_words_of_the_sample_are_learned(spark):
    docs = spark.createDataFrame([(i, " ".join(f"{chr(97 + i)}{chr(97 + j // 26)}{chr(97 + j % 26)}" for j in range(26 * 26)), "en") for i in [*range(26), *range(26)]], "doc_id long, text string, lang string")
    assert len(language.fit(docs).words) == 26**3
    # More languages than are sent to all executors.
    more = docs.withColumn("lang", F.concat(F.lit("l"), F.col("doc_id").cast("string")))
    assert len(language.fit(more, few_langs=5).langs) == 26
