"""Language identification: words first, character n-grams for words never seen.

A word that the training text holds scores by its log frequency in each language. Any other word falls back: the
longest n (5, then 4, 3, 2, 1) for which some of its n-grams are known gives the score, as the mean of their log
frequencies. A text's language is the one with the highest sum over its words.

Defined results: a null or empty text, or one without a letter, is `und` with score 0, and so is every text when nothing
was learned. Ties between languages go to the smaller name. Repeated rows get the same answer each. Columns other than
those named are ignored, whatever they are called.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm._common import Written, few_rows, row_batches

UND = "und"
_RUN = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased. Digits, marks and numerals that Python counts as word characters are left out."""
    found = _RUN.findall((text or "").lower())
    if (text or "").isascii():
        return found
    out = []
    for w in found:
        out.append(w) if w.isalpha() else out.extend(x for x in re.split("|".join({re.escape(c) for c in w if not c.isalpha()}), w) if x)
    return out


@dataclass
class LanguageModel:
    """langs: sorted. words and grams: the row of `logs` that each has: its log frequency in every language."""

    langs: list[str]
    words: dict[str, int] = field(default_factory=dict)
    grams: dict[str, int] = field(default_factory=dict)
    logs: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    longest: int = 5
    #: A score counts this many words' evidence at most, so that it stays a confidence and not the length of the text.
    evidence: int = 20

    @classmethod
    def from_counts(cls, words: list[tuple[str, str, int]], grams: list[tuple[str, str, int]], longest: int = 5) -> LanguageModel:
        """words and grams: (language, word or n-gram, occurrences), each pair once."""
        langs = sorted({x[0] for x in [*words, *grams]})
        at = {lang: i for i, lang in enumerate(langs)}
        model, tables = cls(langs, longest=longest), [np.zeros((0, len(langs)))]

        def add(index: dict[str, int], counts: list[tuple[str, str, int]]) -> None:
            """Half an occurrence more for each entry, so that none is impossible."""
            start = sum(map(len, tables))
            own = {w: start + i for i, w in enumerate(dict.fromkeys(w for _, w, _ in counts))}
            seen = np.full((len(own), len(langs)), 0.5)
            for lang, w, n in counts:
                seen[own[w] - start, at[lang]] += n
            tables.append(np.log(seen / seen.sum(axis=0)))
            index.update(own)

        add(model.words, words)
        for m in range(1, longest + 1):
            add(model.grams, [x for x in grams if len(x[1]) == m])
        model.logs = np.concatenate(tables)
        return model

    def word_scores(self, word: str) -> np.ndarray | None:
        """Log frequencies by language; None if not even a letter of the word is known."""
        if (row := self.words.get(word)) is not None:
            return self.logs[row]
        return self.gram_scores(word)

    def gram_scores(self, word: str) -> np.ndarray | None:
        padded = f" {word} "
        known = self.grams.get
        for m in range(min(self.longest, len(padded)), 0, -1):
            found = [row for i in range(len(padded) - m + 1) if (row := known(padded[i : i + m])) is not None]
            if found:
                return np.add.reduce(self.logs.take(found, axis=0)) / len(found)
        return None


class _Known(dict):
    """Rows of known words. Any other word has the row after the last, of zeros, and is noted."""

    def __init__(self, rows: dict[str, int], none: int):
        super().__init__(rows)
        self.none, self.unseen = none, []

    def __missing__(self, word: str) -> int:
        self.unseen.append(word)
        return self.none


def grams_of(word: str, longest: int) -> list[str]:
    """The n-grams of a word between spaces, the space alone left out."""
    padded = f" {word} "
    return [g for m in range(1, longest + 1) for i in range(len(padded) - m + 1) if (g := padded[i : i + m]) != " "]


class Predictor:
    """A model at work. Scores of unseen words are kept, at most kept_words of them; words of more than kept_letters are
    scored whole like all others, but anew each time."""

    def __init__(self, model: LanguageModel, kept_words: int = 100_000, kept_letters: int = 64, at_once: int = 1 << 16):
        self.model, self.kept_words, self.kept_letters, self.at_once = model, kept_words, kept_letters, at_once
        self.logs = np.concatenate((model.logs, np.zeros((1, model.logs.shape[1]))))
        self.known = _Known(model.words, len(model.logs))
        self.kept: dict[str, np.ndarray | None] = {}

    def _scores(self, word: str) -> np.ndarray | None:
        if word in self.kept:
            return self.kept[word]
        found = self.model.gram_scores(word)
        if len(word) <= self.kept_letters:
            if len(self.kept) >= self.kept_words:
                self.kept.clear()
            self.kept[word] = found
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.model.langs:
            return UND, 0.0
        rows = np.fromiter(map(self.known.__getitem__, words), np.intp, len(words))
        total = np.zeros(len(self.model.langs))
        for i in range(0, len(rows), self.at_once):
            total += np.add.reduce(self.logs.take(rows[i : i + self.at_once], axis=0))
        # The order of the sums follows from the text alone, so equal texts have equal scores.
        for word, n in sorted(Counter(self.known.unseen).items()):
            if (found := self._scores(word)) is not None:
                total += n * found
        self.known.unseen.clear()
        scale = min(len(words), self.model.evidence) / len(words)
        best = int(total.argmax())
        return self.model.langs[best], float(1.0 / np.exp((total - total[best]) * scale).sum())


def _batch(counts: dict[str, Counter]) -> pa.RecordBatch:
    rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "word", "n"])


def _count_words(batches):
    for batch in few_rows(batches, 1024):
        langs, texts = row_batches(batch, "lang", "text")
        counts: dict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(langs, texts):
            counts[lang].update(words_of(text))
        yield _batch(counts)


def _count_grams(longest: int):
    def run(batches):
        for batch in few_rows(batches, 4096):
            counts: dict[str, Counter] = defaultdict(Counter)
            for lang, word, n in zip(*row_batches(batch, "lang", "word", "n")):
                for g in grams_of(word, longest):
                    counts[lang][g] += n
            yield _batch(counts)

    return run


def fit(docs: DataFrame, train: F.Column | None = None, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 1500, longest: int = 5, word_min: int = 2, gram_min: int = 3, few_langs: int = 10_000) -> LanguageModel:
    """Learns from the rows where train holds (all, if None) and the language is not null.

    sample_docs bounds the classifier's training sample: about so many documents of each language, chosen by a hash of
    the id that does not depend on how rows are stored. Words that stand at least word_min times in the sample are known
    ones, and n-grams that its words hold at least gram_min times; there is no other bound on what is learned. Up to
    few_langs languages the shares of the sample, a number for each, go to all executors; only beyond it are texts dealt
    out by language."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), (F.lit(True) if train is None else train).alias("train"))
    rows = rows.filter(F.col("train") & F.col("lang").isNotNull())
    sizes = Written(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("docs")), "languages")
    shares = sizes.df.withColumn("share", F.least(F.lit(1.0), F.lit(float(sample_docs)) / F.col("docs"))).drop("docs")
    place = F.coalesce(F.crc32(F.concat(F.lit("lang-sample:"), F.col("id").cast("string"))), F.lit(0)) / F.lit(2.0**32)
    shares = F.broadcast(shares) if sizes.df.count() <= few_langs else shares
    sample = rows.join(shares, "lang").filter(place < F.col("share")).select("lang", "text")
    kinds = "lang string, word string, n long"
    words = Written(sample.mapInArrow(_count_words, kinds).groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    grams = Written(words.df.mapInArrow(_count_grams(longest), kinds).groupBy("lang", "word").agg(F.sum("n").alias("n")), "grams")

    def often(counts: DataFrame, least: int) -> list[tuple[str, str, int]]:
        enough = counts.groupBy("word").agg(F.sum("n").alias("all")).filter(F.col("all") >= least).select("word")
        return sorted((r.lang, r.word, r.n) for r in counts.join(enough, "word").select("lang", "word", "n").collect())

    model = LanguageModel.from_counts(often(words.df, word_min), often(grams.df, gram_min), longest)
    for done in (sizes, words, grams):
        done.drop()
    return model


def predictor(model: LanguageModel, id_cols: list[str], text_col: str = "text"):
    """The function for mapInArrow; it passes id_cols on."""

    def run(batches):
        at_work = Predictor(model)
        for batch in few_rows(batches):
            (texts,) = row_batches(batch, text_col)
            found = [at_work.predict(t) for t in texts]
            own = [batch.column(batch.schema.get_field_index(c)) for c in id_cols]
            yield pa.RecordBatch.from_arrays([*own, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[*id_cols, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: LanguageModel, *, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """id_cols (the text may be one of them) with lang_pred and score, one row for each input row. Texts are read whole."""
    own = text_col if text_col in id_cols else "_text_"
    given = docs.select(*id_cols) if own == text_col else docs.select(*id_cols, F.col(text_col).alias(own))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields if f.name != "_text_")
    return given.mapInArrow(predictor(model, id_cols, own), f"{kinds}, lang_pred string, score double")
