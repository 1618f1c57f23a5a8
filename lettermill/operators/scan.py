"""Named things in running text: addresses, accounts, sums, dates, parcels, references and telephone numbers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.functions.text import iban, money_minor

_MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
# Currencies that are read, and words that stand before a reference or the number of a parcel.
_CODES = "USD|EUR|GBP|JPY|CHF|CAD|AUD"
_REFERENCE = "invoice|reference|receipt|order|inv|ref"
_PARCEL = r"track(?:ing)?|shipment|consignment|awb|waybill"
_MONTH = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept|Sep|Oct|Nov|Dec"
_SUM = r"(?:\d{1,3}(?:[.,]\d{3})+(?:[.,]\d{1,2})?|\d+(?:[.,]\d{1,2})?)(?![.,]?\d)"


def _url(v: str) -> str:
    """Scheme and host in lower case, without the fragment."""
    scheme, rest = v.split("://", 1)
    host = re.match(r"[^/?#]*", rest)[0]
    return f"{scheme.lower()}://{host.lower()}{rest[len(host) :].partition('#')[0]}"


def _sum(v: str) -> str | None:
    found = money_minor(v.upper().replace("¥", "JPY"))
    return None if found is None or found[1] is None else f"{found[1]} {found[0]}"


def _date(v: str) -> str | None:
    """In ISO form; None for a day that no calendar has."""
    words = re.findall(r"[A-Za-z]+|\d+", v.partition("T")[0] if v[0].isdigit() and v[4:5] == "-" else v)
    try:
        if words[0].isdigit() and len(words[0]) == 4:
            y, m, d = map(int, words[:3])
        else:
            name = next(w for w in words if w.isalpha())
            d, y = (int(w) for w in words if w.isdigit())
            m = _MONTHS[name[:3].lower()]
        return date(y, m, d).isoformat()
    except ValueError:
        return None


def _phone(v: str) -> str | None:
    digits = re.sub(r"\D", "", v)
    return ("+" if v[0] == "+" else "") + digits if 8 <= len(digits) <= 15 else None


def _compact(v: str) -> str:
    return re.sub(r"\s", "", v).upper()


#: kind, the pattern (its value is group v) and what makes a value's normal form, or None if it is none after all. A
#: pattern starts at the beginning of a run only, so that long runs are read once.
KINDS: list[tuple[str, re.Pattern, Callable[[str], str | None]]] = [
    ("url", re.compile(r"(?P<v>https?://[^\s<>\"]*[^\s<>\".,;:!?\]}])", re.I), _url),
    ("email", re.compile(r"(?<![a-z0-9._%+-])(?P<v>[a-z0-9._%+-]+@(?:[a-z0-9-]+\.)+[a-z]{2,63})\b", re.I), str.lower),
    ("iban", re.compile(r"\b(?P<v>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)\b", re.I), lambda v: _compact(v) if iban(v) else None),
    ("amount", re.compile(rf"(?P<v>(?:[$£€¥]|\b(?:{_CODES})) ?{_SUM})", re.I), _sum),
    ("amount", re.compile(rf"(?<![\d.,])(?P<v>{_SUM} ?(?:[$£€¥]|(?:{_CODES})\b))", re.I), _sum),
    ("date", re.compile(rf"\b(?P<v>\d{{4}}-\d\d-\d\d(?:T\d\d:\d\d(?::\d\d)?(?:Z|[+-]\d\d:?\d\d)?)?|\d{{1,2}} (?:{_MONTH})\b,? \d{{4}}|(?:{_MONTH}) \d{{1,2}},? \d{{4}})\b", re.I), _date),
    ("tracking", re.compile(r"\b(?P<v>1Z[0-9A-Z]{16}|9\d{21})\b", re.I), _compact),
    ("tracking", re.compile(rf"\b(?:{_PARCEL})\s*(?:number|no\.?|#|:)?\s*\b(?P<v>\d{{10,15}})\b", re.I), _compact),
    ("reference", re.compile(rf"\b(?:{_REFERENCE})\b\s*(?:number|no\.?)?\s*#?\s*:?\s*(?P<v>[A-Z0-9][A-Z0-9_/-]{{2,31}})\b", re.I), lambda v: _compact(v) if any(c.isdigit() for c in v) else None),
    ("phone", re.compile(r"(?<![0-9+])(?P<v>\+\d{1,3}(?:[-. ]?\(?\d{2,4}\)?){2}[-. ]?\d{2,6})(?!\d)"), _phone),
    ("phone", re.compile(r"(?<![0-9.-])(?P<v>\(?\d{3}\)?[-. ]\d{3}[-. ]\d{4})(?![0-9-])"), _phone),
]

#: What a text must hold for a kind to be in it at all; every other kind holds a digit.
_NEEDS = {"url": "://", "email": "@"}
_DIGIT = re.compile(r"\d")


def _end(kind: str, value: str) -> int:
    """How much of a value counts: a URL gives up closing parentheses that it doesn't open."""
    n = len(value)
    while kind == "url" and value[n - 1] == ")" and value.count(")", 0, n) > value.count("(", 0, n):
        n -= 1
    return n


def scan(text: str | None, most: int = 64, each: int = 8) -> list[tuple[str, str, int, int]]:
    """kind, normal form, start and end of what the text names, without overlaps: what starts first stays, of two that
    start together the longer. The first `most` different things count, each at most `each` times; null names nothing."""
    text, found = text or "", []
    digit = _DIGIT.search(text) is not None
    for kind, pattern, normal in KINDS:
        if not (_NEEDS[kind] in text if kind in _NEEDS else digit):
            continue
        for m in pattern.finditer(text):
            value = m["v"][: _end(kind, m["v"])]
            if (norm := normal(value)) is not None:
                found.append((m.start("v"), -m.start("v") - len(value), kind, norm))
    out, reach, times = [], 0, {}
    for start, minus, kind, norm in sorted(found):
        if start < reach:
            continue
        reach, key = -minus, (kind, norm)
        if times.get(key, 0) < each and (key in times or len(times) < most):
            times[key] = times.get(key, 0) + 1
            out.append((kind, norm, start, reach))
    return out


def mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, most: int = 64, each: int = 8) -> DataFrame:
    """id, kind, norm, start, stop, one row for each mention; one pass over the texts, no shuffle."""

    @F.pandas_udf("array<struct<kind:string,norm:string,start:int,stop:int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: [{"kind": k, "norm": v, "start": a, "stop": b} for k, v, a, b in scan(t, most, each)])

    return docs.select(id_col, F.explode(run(F.col(text_col))).alias("m")).select(id_col, "m.*")
