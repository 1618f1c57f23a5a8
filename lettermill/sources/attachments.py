"""The text of attachments, with a status for each one instead of a failure."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.functions.text import html_to_text

_BY_NAME = {"html": "html", "htm": "html", "csv": "csv", "tsv": "csv", "txt": "txt", "text": "txt", "md": "txt", "log": "txt", "pdf": "pdf", "docx": "office", "xlsx": "office", "pptx": "office"}
_BY_HEAD = [(b"%PDF-", "pdf"), (b"PK\x03\x04", "office"), (b"\xd0\xcf\x11\xe0", "sealed")]  # fixed values: signatures
READ = ("html", "csv", "txt")


def detect(name: str | None, content: bytes) -> str | None:
    """The kind by how the content begins, else by the name's ending; None if neither tells."""
    for head, kind in _BY_HEAD:
        if content.startswith(head):
            return kind
    if content[:512].lstrip().lower().startswith((b"<!doctype html", b"<html")):
        return "html"
    return _BY_NAME.get((name or "").rpartition(".")[2].lower())


def extract(name: str | None, content: bytes | None) -> tuple[str, str | None]:
    """status and text. empty: nothing in it, or no text. encrypted: a sealed container, or a PDF that says so.
    unsupported: a kind that is not read here. failed: bytes that are not UTF-8, where the kind says text."""
    if not content:
        return "empty", None
    kind = detect(name, content)
    if kind == "sealed" or kind == "pdf" and b"/Encrypt" in content:
        return "encrypted", None
    if kind not in READ:
        return "unsupported", None
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return "failed", None
    text = html_to_text(text) if kind == "html" else text
    return ("ok", text) if text.strip() else ("empty", None)


def texts(files: DataFrame, name_col: str, content_col: str, *, most: int = 32 << 20) -> DataFrame:
    """files with status and text. Content over `most` bytes is too_large and never leaves the JVM."""

    @F.pandas_udf("status string, text string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for names, contents in batches:
            yield pd.DataFrame([extract(n, c) for n, c in zip(names, contents)], columns=["status", "text"])

    large = F.coalesce(F.octet_length(content_col) > most, F.lit(False))
    found = files.withColumn("_found", run(F.col(name_col), F.when(~large, F.col(content_col))))
    return found.withColumns({"status": F.when(large, "too_large").otherwise(F.col("_found.status")), "text": F.col("_found.text")}).drop("_found")
