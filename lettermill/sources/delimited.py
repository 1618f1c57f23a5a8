"""Tables inside texts: delimited text, HTML tables, typed columns, and formula-safe CSV out."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from datetime import datetime
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.functions.text import parse_number


def sniff_delimiter(text: str) -> str:
    """The most frequent of comma, semicolon and tab outside quotes on the first line that isn't blank."""
    line = next((x for x in text.splitlines() if x.strip()), "")
    bare = re.sub(r'"(?:[^"]|"")*"?', "", line)
    return max(",;\t", key=lambda c: (bare.count(c), -",;\t".index(c)))


def rows_of(text: str) -> list[list[str]]:
    return [r for r in csv.reader(io.StringIO(text), delimiter=sniff_delimiter(text)) if any(c.strip() for c in r)]


class _Tables(HTMLParser):
    """Rows of every table, nested ones apart, to a depth of 8."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[list[list[str]]] = []
        self.done: list[list[list[str]]] = []
        self.cell: list[list[str] | None] = []

    def handle_starttag(self, tag, attrs):
        if tag == "table" and len(self.open) < 8:
            self.open.append([])
            self.cell.append(None)
        elif self.open and tag == "tr":
            self.open[-1].append([])
        elif self.open and tag in ("td", "th"):
            if not self.open[-1]:
                self.open[-1].append([])
            self._close()
            self.cell[-1] = []

    def _close(self):
        if self.cell and self.cell[-1] is not None:
            self.open[-1][-1].append(" ".join("".join(self.cell[-1]).split()))
            self.cell[-1] = None

    def handle_endtag(self, tag):
        if self.open and tag in ("td", "th", "tr"):
            self._close()
        elif tag == "table" and self.open:
            self._close()
            self.done.append(self.open.pop())
            self.cell.pop()

    def handle_data(self, data):
        if self.cell and self.cell[-1] is not None:
            self.cell[-1].append(data)


def html_tables(html: str | None) -> list[list[list[str]]]:
    p = _Tables()
    p.feed(html or "")
    p.close()
    return [[r for r in t if r] for t in p.done]


def cell_type(cell: str) -> str:
    s = cell.strip()
    if not s:
        return "empty"
    if s.lower() in ("true", "false", "yes", "no"):
        return "bool"
    if parse_number(s) is not None:
        return "number"
    for f in ("%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y", "%d %b %Y"):
        try:
            datetime.strptime(s, f)
            return "date"
        except ValueError:
            pass
    return "text"


def column_types(rows: list[list[str]]) -> list[str]:
    """A type for each column: the one that all its filled cells share, else text."""
    width = max(map(len, rows), default=0)
    out = []
    for i in range(width):
        kinds = {cell_type(r[i]) for r in rows if i < len(r)} - {"empty"}
        out.append(kinds.pop() if len(kinds) == 1 else "text" if kinds else "empty")
    return out


def has_header(rows: list[list[str]]) -> bool:
    """The first row is text all over while the rest has a column that isn't."""
    return len(rows) > 1 and set(column_types(rows[:1])) <= {"text"} and any(t not in ("text", "empty") for t in column_types(rows[1:]))


EXTRACTED = "array<struct<header:array<string>,types:array<string>,rows:array<array<string>>>>"


def extract(text: str | None, kind: str) -> list[dict]:
    tables = html_tables(text) if kind == "html" else [rows_of(text or "")]
    out = []
    for rows in tables:
        if rows:
            head = has_header(rows)
            body = rows[1:] if head else rows
            width = max(map(len, rows))
            pad = lambda r: r + [""] * (width - len(r))
            out.append({"header": pad(rows[0]) if head else [f"c{i}" for i in range(width)], "types": column_types(list(map(pad, body))), "rows": list(map(pad, body))})
    return out


def tables_column(kind: str):
    @F.pandas_udf(EXTRACTED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: extract(t, kind))

    return run


def safe_cell(c: Column) -> Column:
    """Quoted where needed; text that a spreadsheet would run as a formula begins with an apostrophe."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    s = F.when(s.rlike(r"^[=+\-@\t\r]") & ~s.rlike(r"^[+-]?[0-9.]+$"), F.concat(F.lit("'"), s)).otherwise(s)
    return F.when(s.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.regexp_replace(s, '"', '""'), F.lit('"'))).otherwise(s)


def csv_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(F.concat_ws(",", *(safe_cell(F.col(c)) for c in columns)).alias("line"))
