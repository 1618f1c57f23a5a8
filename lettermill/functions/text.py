"""Scalar text functions: JVM expressions where there are such, Arrow functions elsewhere."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What replies and forwards begin with.
REPLY = "re aw sv antw antwoord odp ynt rif res".split()
FORWARD = "fw fwd wg tr rv vs enc doorst".split()
_PREFIX = re.compile(rf"^\s*({'|'.join(REPLY + FORWARD)})\s*(?:\[\d+\]|\(\d+\))?\s*[:：]\s*", re.I)
_LIST = re.compile(r"^\s*\[[^\]]{1,40}\]\s*")
_TAIL = re.compile(r"\s*\((fwd|fw)\)\s*$", re.I)


def normalise_subject(subject: str | None, strips: int = 16) -> tuple[str, str]:
    """The bare subject, lower-case with single spaces, and whether it began as a reply, a forward or neither."""
    s, kind = subject or "", "new"
    for _ in range(strips):
        if m := _PREFIX.match(s):
            word = m[1].lower()
            kind = kind if kind != "new" else ("reply" if word in REPLY else "forward")
            s = s[m.end() :]
        elif m := _LIST.match(s):
            s = s[m.end() :]
        elif m := _TAIL.search(s):
            s = s[: m.start()]
        else:
            break
    return " ".join(s.lower().split()), kind


def subject_column():
    @F.pandas_udf("base string, kind string")
    def normalise(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([normalise_subject(x) for x in s], columns=["base", "kind"])

    return normalise


def normalise_text(text: str | None) -> str:
    """NFC, white space collapsed, without zero-width, direction and control characters; a zero-width non-joiner is a
    space."""
    s = unicodedata.normalize("NFC", (text or "").replace("‌", " "))
    s = "".join(c for c in s if c in "\n\t" or unicodedata.category(c) not in ("Cf", "Cc"))
    return " ".join(s.split())


def fold(text: str) -> str:
    """Without diacritics, lower-case."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


class _Text(HTMLParser):
    SKIP = {"script", "style", "head", "title", "noscript"}
    BREAK = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "table", "article", "nav", "ul"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.SKIP
        if tag in self.BREAK:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.depth = max(0, self.depth - (tag in self.SKIP))
        if tag in self.BREAK:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.depth:
            self.out.append(data)


def html_to_text(html: str | None) -> str:
    p = _Text()
    p.feed(html or "")
    p.close()
    lines = (" ".join(x.split()) for x in "".join(p.out).split("\n"))
    return "\n".join(x for x in lines if x)


def html_text_column():
    @F.pandas_udf("string")
    def convert(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(html_to_text)

    return convert


def registrable(host: Column) -> Column:
    """The last two labels of a host."""
    parts = F.split(F.lower(host), r"\.")
    return F.array_join(F.when(F.size(parts) >= 2, F.slice(parts, -2, 2)).otherwise(parts), ".")


def mask_of(letters: str) -> int:
    """One bit for each letter and digit, and one for anything else."""
    m = 0
    for c in letters.lower():
        m |= 1 << (ord(c) - 97 if "a" <= c <= "z" else 26 + ord(c) - 48 if "0" <= c <= "9" else 36)
    return m


def letter_mask(text: Column) -> Column:
    low = F.lower(text)
    bits = F.lit(0).cast("long")
    for c in "abcdefghijklmnopqrstuvwxyz0123456789":
        bits = bits.bitwiseOR(F.when(F.contains(low, F.lit(c)), F.lit(mask_of(c)).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits.bitwiseOR(F.when(low.rlike("[^a-z0-9]"), F.lit(1 << 36)).otherwise(F.lit(0).cast("long")))


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def iban(text: str) -> bool:
    """Whether the letters and digits of text are an IBAN: moved head, letters as numbers, remainder 1 by 97."""
    s = re.sub(r"\s", "", text).upper()
    if not re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", s):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def money_minor(text: str) -> tuple[int, str | None] | None:
    """`€1.234,50` as (123450, EUR): the last separator with one or two digits after it is the decimal one."""
    m = re.search(r"(?P<a>[€$£]|[A-Z]{3})?\s*(?P<n>\d[\d.,' ]*\d|\d)\s*(?P<b>[€$£]|[A-Z]{3})?", text)
    if not m:
        return None
    sign = {"€": "EUR", "$": "USD", "£": "GBP"}
    unit = m["a"] or m["b"]
    n = re.sub(r"[ ']", "", m["n"])
    cents = re.search(r"[.,](\d{1,2})$", n)
    whole = re.sub(r"[.,]", "", n[: cents.start()] if cents else n)
    return int(whole or 0) * 100 + (int(cents[1].ljust(2, "0")) if cents else 0), sign.get(unit, unit)


def parse_number(text: str) -> float | None:
    """`(1,200)` is negative, `5%` a hundredth, currency signs and separators go."""
    s = text.strip()
    negative = s.startswith("(") and s.endswith(")")
    s = re.sub(r"[€$£,_\s]", "", s.strip("()"))
    percent = s.endswith("%")
    try:
        v = float(s.rstrip("%"))
    except ValueError:
        return None
    return (-v if negative else v) / (100 if percent else 1)


def detect_language(text: str, least: int = 24, sure: float = 0.6) -> str | None:
    """By function words, for texts long enough where one language has most of those found."""
    if len(text) < least:
        return None
    words = re.findall(r"[^\W\d_]+", text.lower())
    known = {"en": {"the", "and", "of", "to", "is", "in", "that"}, "fr": {"le", "la", "les", "des", "et", "un", "une", "que"}, "de": {"der", "die", "und", "das", "nicht", "ist", "mit"}, "es": {"el", "los", "las", "y", "que", "una", "por"}}
    hits = {k: sum(w in v for w in words) for k, v in known.items()}
    best = max(hits, key=lambda k: hits[k])
    return best if hits[best] and hits[best] / sum(hits.values()) >= sure else None


# Patterns of written dates, from the least to the most ambiguous.
DATE_FORMATS = ["yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy", "d MMM yyyy", "MMM d, yyyy", "dd/MM/yyyy"]


def written_date(text: Column, formats: list[str] | None = None, years: tuple[int, int] = (1970, 2100)) -> Column:
    """The date that text states in the first format that reads it, if its year is plausible; else null."""
    found = F.coalesce(*(F.try_to_timestamp(F.trim(text), F.lit(f)).cast("date") for f in formats or DATE_FORMATS))
    return F.when(F.year(found).between(*years), found)


def fnv1a(text: str) -> int:
    """The 64-bit FNV-1a hash of the text's UTF-8 bytes."""
    h = 0xCBF29CE484222325  # fixed values: the hash's offset and prime
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def fnv_bucket(buckets: int):
    """A column function from texts to their bucket; null stays null."""

    @F.pandas_udf("long")
    def bucket(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if t is None else fnv1a(t) % buckets for t in s], dtype="Int64")

    return bucket
