"""Messages in and out: RFC 5322 parsing, header probes, and mbox, Maildir, EML and JSON exports."""

from __future__ import annotations

import email
import email.policy
import email.utils
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROBE = 32 * 1024  # fixed value: bytes of a message that a header probe reads

PARSED = "message_id string, in_reply_to string, references array<string>, subject string, from_name string, from_addr string, to_addrs array<string>, cc_addrs array<string>, at long, body_text string, body_html string, attachments array<struct<name:string,type:string,size:long>>"


def _addresses(value: str | None) -> list[str]:
    return [a.lower() for _, a in email.utils.getaddresses([value or ""]) if a]


def parse_message(raw: bytes | None) -> dict | None:
    """Headers, bodies and attachments; null for null. A date that is none is null; bytes that are no text are replaced."""
    if raw is None:
        return None
    m = email.message_from_bytes(bytes(raw), policy=email.policy.compat32)
    names = email.utils.getaddresses([str(m.get("From", ""))])
    try:
        at = int(email.utils.parsedate_to_datetime(m["Date"]).timestamp()) if m["Date"] else None
    except (TypeError, ValueError):
        at = None
    bodies: dict[str, str | None] = {"text/plain": None, "text/html": None}
    attached = []
    for part in m.walk():
        if part.is_multipart():
            continue
        kind, data = part.get_content_type(), part.get_payload(decode=True) or b""
        if part.get_filename() or part.get_content_disposition() == "attachment":
            attached.append({"name": part.get_filename(), "type": kind, "size": len(data)})
        elif kind in bodies and bodies[kind] is None:
            try:
                bodies[kind] = data.decode(part.get_content_charset() or "utf-8", "replace")
            except LookupError:
                bodies[kind] = data.decode("utf-8", "replace")
    decode = lambda v: None if v is None else str(email.header.make_header(email.header.decode_header(str(v))))
    return {
        "message_id": bare_id(m["Message-ID"]), "in_reply_to": bare_id(m["In-Reply-To"]), "references": re.findall(r"<([^<>\s]+)>", str(m.get("References", ""))),
        "subject": decode(m["Subject"]), "from_name": decode(names[0][0]) if names else None, "from_addr": names[0][1].lower() or None if names else None,
        "to_addrs": _addresses(m["To"]), "cc_addrs": _addresses(m["Cc"]), "at": at, "body_text": bodies["text/plain"], "body_html": bodies["text/html"], "attachments": attached,
    }


def bare_id(value: str | None) -> str | None:
    return (str(value).strip().strip("<>").strip() or None) if value else None


def parse_column():
    @F.pandas_udf(PARSED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cols = [c.strip().split(" ")[0] for c in re.split(r",(?![^<]*>)", PARSED)]
        for s in batches:
            yield pd.DataFrame([parse_message(x) or dict.fromkeys(cols) for x in s], columns=cols)

    return run


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """A folder of .eml files or a Maildir, one message a row."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select("path", "length", parse_column()(F.col("content")).alias("m")).select("path", "length", "m.*")


def header_probe(raw: bytes, names: tuple[str, ...]) -> dict[str, str]:
    """The first value of each header, unfolded, from the first 32 KiB."""
    head = re.split(rb"\r?\n\r?\n", raw[:PROBE], maxsplit=1)[0].decode("utf-8", "replace")
    lines = re.sub(r"\r?\n[ \t]+", " ", head).splitlines()
    found: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if colon and name.lower() in {n.lower() for n in names}:
            found.setdefault(name.lower(), value.strip())
    return found


def eml(columns: dict[str, str]) -> F.Column:
    """A message's text from columns: from, to, subject, date (already formatted), id, body."""
    line = lambda name, c: F.concat(F.lit(f"{name}: "), F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\r\n]+", " "), F.lit("\n"))
    head = [line(n, columns[k]) for n, k in (("From", "from"), ("To", "to"), ("Subject", "subject"), ("Date", "date"), ("Message-ID", "id")) if k in columns]
    return F.concat(*head, F.lit("\n"), F.coalesce(F.col(columns["body"]), F.lit("")), F.lit("\n"))


def mbox(message: F.Column, sender: F.Column) -> F.Column:
    """One mbox entry: a From_ line, and body lines that look like one quoted."""
    quoted = F.regexp_replace(message, r"(?m)^(>*From )", ">$1")
    return F.concat(F.lit("From "), F.coalesce(sender, F.lit("MAILER-DAEMON")), F.lit(" Thu Jan  1 00:00:00 1970\n"), quoted, F.lit("\n"))


def export_mbox(messages: DataFrame, columns: dict[str, str], path: str) -> None:
    messages.select(mbox(eml(columns), F.col(columns["from"])).alias("value")).write.option("lineSep", "").text(path)


def export_json(messages: DataFrame, path: str) -> None:
    messages.write.json(path)


def export_eml(messages: DataFrame, columns: dict[str, str], id_col: str) -> DataFrame:
    """name and content of one file for each message, in the Maildir manner, for a sink that writes files."""
    name = F.concat(F.col(id_col).cast("string"), F.lit(".lettermill:2,S"))
    return messages.select(name.alias("name"), eml(columns).alias("content"))
