"""Media columns: what a binary value really is, whatever its declared type, and which media lie inside it.

One Aho-Corasick pass over the bytes finds every magic number. Each hit is a candidate only: a validator for its format
reads the structure from that place (chunk lengths, checksums, block chains) and returns the length of the whole object,
or nothing. A candidate at offset 0 that fills the value gives the true type, and so corrects the declared one. Valid
objects at other places, or followed by other bytes, are carved, outermost first.

Defined results: null is type null with no parts; empty or unrecognised bytes are application/octet-stream, text where
they are UTF-8 without control characters. Equal values give equal results. Values are read whole. Extra columns are
ignored by name and position.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm._common import few_rows, row_batches

OCTETS, TEXT = "application/octet-stream", "text/plain"
_CONTROL = re.compile(rb"[\x00-\x08\x0b\x0c\x0e-\x1f]")

# The magic numbers of the formats, with the distance from the object's start to the number.
MAGIC = [
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"BM", 0, "image/bmp"),
    (b"WAVEfmt ", 8, "audio/wav"),
    (b"fLaC", 0, "audio/flac"),
    (b"OggS", 0, "audio/ogg"),
    (b"%PDF-", 0, "application/pdf"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
]


def _png(b: bytes, at: int) -> int | None:
    here, first = at + 8, True
    while here + 12 <= len(b):
        (size,) = struct.unpack_from(">I", b, here)
        kind, end = b[here + 4 : here + 8], here + 12 + size
        if end > len(b) or first and (kind != b"IHDR" or size != 13):
            return None
        if zlib.crc32(memoryview(b)[here + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return None
        if kind == b"IEND":
            return end - at
        here, first = end, False
    return None


def _gif(b: bytes, at: int) -> int | None:
    if at + 13 > len(b):
        return None

    def table(flags: int) -> int:
        return 3 << (flags & 7) + 1 if flags & 128 else 0

    def blocks(here: int) -> int:
        while here < len(b) and b[here]:
            here += b[here] + 1
        return here + 1

    here = at + 13 + table(b[at + 10])
    while here < len(b):
        mark = b[here]
        if mark == 0x3B:
            return here + 1 - at
        if mark == 0x21:
            here = blocks(here + 2)
        elif mark == 0x2C and here + 10 <= len(b):
            here = blocks(here + 11 + table(b[here + 9]))
        else:
            return None
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    here, framed = at + 2, False
    while here + 4 <= len(b):
        if b[here] != 0xFF:
            return None
        mark = b[here + 1]
        if mark == 0xFF:
            here += 1
            continue
        if mark in (0x00, 0xD8) or mark == 0xD9 and not framed:
            return None
        (size,) = struct.unpack_from(">H", b, here + 2)
        if size < 2 or here + 2 + size > len(b):
            return None
        framed |= 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        here += 2 + size
        if mark == 0xDA:  # entropy-coded bytes up to the next marker that isn't stuffing or a restart
            if not framed:
                return None
            while (here := b.find(b"\xff", here)) >= 0 and here + 1 < len(b) and (b[here + 1] == 0 or 0xD0 <= b[here + 1] <= 0xD7):
                here += 2
            if here < 0 or here + 1 >= len(b):
                return None
            if b[here + 1] == 0xD9:
                return here + 2 - at
    return None


def _bmp(b: bytes, at: int) -> int | None:
    if at + 26 > len(b):
        return None
    size, zero, offset, header = struct.unpack_from("<IIII", b, at + 2)
    return size if zero == 0 and header in (12, 40, 52, 56, 108, 124) and 14 + header <= offset <= size <= len(b) - at else None


def _wav(b: bytes, at: int) -> int | None:
    if at < 0 or at + 12 > len(b) or b[at : at + 4] != b"RIFF":
        return None
    end, here, seen = at + 8 + struct.unpack_from("<I", b, at + 4)[0], at + 12, set()
    if end > len(b):
        return None
    while here + 8 <= end:
        kind, (size,) = b[here : here + 4], struct.unpack_from("<I", b, here + 4)
        seen.add(kind)
        here += 8 + size + (size & 1)
    return end - at if here == end and {b"fmt ", b"data"} <= seen else None


def _flac(b: bytes, at: int) -> int | None:
    here, first = at + 4, True
    while here + 4 <= len(b):
        kind, size = b[here] & 127, int.from_bytes(b[here + 1 : here + 4], "big")
        if first and (kind != 0 or size != 34) or kind == 127:
            return None
        last, here, first = b[here] & 128, here + 4 + size, False
        if last:
            return len(b) - at if here + 2 <= len(b) and b[here] == 0xFF and b[here + 1] & 0xFC == 0xF8 else None
    return None


def _ogg(b: bytes, at: int) -> int | None:
    here, serial = at, None
    while here + 27 <= len(b) and b[here : here + 4] == b"OggS" and b[here + 4] == 0:
        flags, own, n = b[here + 5], b[here + 14 : here + 18], b[here + 26]
        end = here + 27 + n + sum(b[here + 27 : here + 27 + n])
        if end > len(b) or serial is None and not flags & 2:
            return None
        serial, here = own if serial is None else serial, end
        if flags & 4 and own == serial:
            return here - at
    return None


def _pdf(b: bytes, at: int) -> int | None:
    end = b.find(b"%%EOF", at)
    while end >= 0 and (more := b.find(b"%%EOF", end + 5)) >= 0 and b.find(b"%PDF-", end, more) < 0:
        end = more
    if end < 0 or b.find(b"startxref", at, end) < 0:
        return None
    end += 5
    while end < len(b) and b[end] in b"\r\n":
        end += 1
    return end - at


def _zip(b: bytes, at: int) -> int | None:
    end = b.find(b"PK\x05\x06", at)
    while end >= 0 and end + 22 <= len(b):
        size, offset, note = struct.unpack_from("<IIH", b, end + 12)
        if at + offset + size == end and b[at + offset : at + offset + 4] in (b"PK\x01\x02", b"PK\x05\x06"):
            stop = end + 22 + note
            return stop - at if stop <= len(b) else None
        end = b.find(b"PK\x05\x06", end + 4)
    return None


def _gzip(b: bytes, at: int) -> int | None:
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return None
    unpack = zlib.decompressobj(31)
    try:
        view = memoryview(b)
        for i in range(at, len(b), 1 << 16):
            rest = unpack.decompress(view[i : i + (1 << 16)], 1 << 20)
            while not unpack.eof and unpack.unconsumed_tail and rest:
                rest = unpack.decompress(unpack.unconsumed_tail, 1 << 20)
            if unpack.eof:
                return min(i + (1 << 16), len(b)) - len(unpack.unused_data) - at
    except zlib.error:
        return None
    return None


VALIDATE = {"image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "image/bmp": _bmp, "audio/wav": _wav, "audio/flac": _flac, "audio/ogg": _ogg, "application/pdf": _pdf, "application/zip": _zip, "application/gzip": _gzip}


@functools.lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, (magic, _, _) in enumerate(MAGIC):
        found.add_word(magic.decode("latin-1"), i)
    found.make_automaton()
    return found


@dataclass(frozen=True)
class Part:
    kind: str
    start: int
    length: int


def objects(b: bytes) -> list[Part]:
    """Valid media objects, in order, none inside another."""
    out: list[Part] = []
    free = 0
    hits = []
    for last, i in _automaton().iter(b.decode("latin-1")):
        magic, before, kind = MAGIC[i]
        hits.append((last - len(magic) + 1 - before, kind))
    for start, kind in sorted(hits):
        if start >= free and (size := VALIDATE[kind](b, start)):
            out.append(Part(kind, start, size))
            free = start + size
    return out


def sniff(b: bytes | None) -> tuple[str | None, list[Part]]:
    """The true type, and the objects that are not the whole value."""
    if b is None:
        return None, []
    found = objects(b)
    if found and found[0].start == 0 and found[0].length == len(b):
        return found[0].kind, []
    if found and found[0].start == 0:  # an object with bytes after it keeps its type; those are its tail
        return found[0].kind, found
    if b and not found:
        try:
            b.decode("utf-8")
            if not _CONTROL.search(b):
                return TEXT, []
        except UnicodeDecodeError:
            pass
    return OCTETS, found


def wav_of(samples: bytes, rate: int = 8000) -> bytes:
    """8-bit mono PCM. samples: an even number of bytes."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples


def wav_samples(b: bytes) -> bytes:
    """The data chunk of a WAV object that _wav found valid."""
    here = 12
    while b[here : here + 4] != b"data":
        size = struct.unpack_from("<I", b, here + 4)[0]
        here += 8 + size + (size & 1)
    return b[here + 8 : here + 8 + struct.unpack_from("<I", b, here + 4)[0]]


def padded(text: str | None, unit: int = 64) -> tuple[bytes, int]:
    """The text's bytes with zeros up to a positive multiple of unit, and how many were its own."""
    own = (text or "").encode("utf-8", "replace")
    return own + bytes(-len(own) % unit if own else unit), len(own)


def store_text(docs: DataFrame, *, id_cols: list[str], text_col: str = "text", declared: str = OCTETS) -> DataFrame:
    """id_cols with n_bytes, declared_type and content: each text as a lossless 8-bit WAV, declared as something else."""
    given = docs.select(*id_cols, F.col(text_col).alias("_text_"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])

    def run(batches):
        for batch in few_rows(batches):
            (texts,) = row_batches(batch, "_text_")
            own = [batch.column(batch.schema.get_field_index(c)) for c in id_cols]
            made = [padded(t) for t in texts]
            yield pa.RecordBatch.from_arrays([*own, pa.array([n for _, n in made], pa.int64()), pa.array([declared] * len(made), pa.string()), pa.array([wav_of(b) for b, _ in made], pa.binary())], names=[*id_cols, "n_bytes", "declared_type", "content"])

    return given.mapInArrow(run, f"{kinds}, n_bytes long, declared_type string, content binary")


SNIFFED = "true_type string, corrected boolean, parts array<struct<kind:string,start:long,length:long>>"
_PARTS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))


def sniff_media(media: DataFrame, *, keep: list[str], content_col: str = "content", declared_col: str = "declared_type") -> DataFrame:
    """keep with true_type, corrected (the declared type was another or null) and parts, the media to carve."""
    given = media.select(*keep, F.col(declared_col).alias("_declared_"), F.col(content_col).alias("_content_"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-2])

    def run(batches):
        for batch in few_rows(batches):
            declared, contents = row_batches(batch, "_declared_", "_content_")
            found = [sniff(c) for c in contents]
            out = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            out.append(pa.array([k for k, _ in found], pa.string()))
            out.append(pa.array([k is not None and k != d for (k, _), d in zip(found, declared)], pa.bool_()))
            out.append(pa.array([[{"kind": p.kind, "start": p.start, "length": p.length} for p in parts] for _, parts in found], _PARTS))
            yield pa.RecordBatch.from_arrays(out, names=[*keep, "true_type", "corrected", "parts"])

    return given.mapInArrow(run, f"{kinds}{', ' * bool(kinds)}{SNIFFED}")


def carve(sniffed: DataFrame, *, id_cols: list[str], content_col: str = "content") -> DataFrame:
    """One row for each part: id_cols, kind, start, length and its bytes."""
    each = sniffed.select(*id_cols, content_col, F.explode("parts").alias("_p"))
    return each.select(*id_cols, F.col("_p.kind").alias("kind"), F.col("_p.start").alias("start"), F.col("_p.length").alias("length"), F.expr(f"substring({content_col}, cast(_p.start + 1 as int), cast(_p.length as int))").alias("content"))


def said_parts(parts: list[Part]) -> str:
    return ",".join(f"{p.kind}:{p.start}:{p.length}" for p in parts)


def embedded(b: bytes) -> list[Part]:
    """The objects inside the samples of a valid WAV, by their places in these."""
    return objects(wav_samples(b))


def stored_features(media: DataFrame, *, keep: list[str], content_col: str = "content", declared_col: str = "declared_type", unit: int = 64) -> DataFrame:
    """keep with what the stored bytes say when sniffed and read back: payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature, `true type|corrected or declared|objects|mean level|zero crossings|distinct
    levels`, and carved, `kind:start:length` of each object that the same search finds within the payload. Content that is
    no WAV gives nulls for the payload, and its own objects in carved."""
    given = media.select(*keep, F.col(declared_col).alias("_declared_"), F.col(content_col).alias("_content_"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-2])

    def run(batches):
        for batch in few_rows(batches):
            declared, contents = row_batches(batch, "_declared_", "_content_")
            rows = []
            for said, b in zip(declared, contents):
                kind, parts = sniff(b)
                if kind != "audio/wav" or parts:
                    rows.append((None, None, None, None if b is None else len(b), None if b is None else hashlib.sha256(b).hexdigest(), f"{kind}|{len(parts)}", said_parts(parts)))
                    continue
                payload, inner = wav_samples(b), embedded(b)
                level = np.frombuffer(payload, np.uint8)
                up = level >= 128
                feature = f"{kind}|{'corrected' if kind != said else 'declared'}|{len(inner)}|{int(level.sum(dtype=np.int64)) / len(level):.6f}|{int(np.count_nonzero(up[1:] != up[:-1]))}|{len(np.flatnonzero(np.bincount(level, minlength=256)))}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-unit:]), len(b), hashlib.sha256(b).hexdigest(), feature, said_parts(inner)))
            cols = list(zip(*rows)) if rows else [[]] * 7
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            own = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(list(c), t) for c, t in zip(cols, types))], names=[*keep, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "carved"])

    return given.mapInArrow(run, f"{kinds}{', ' * bool(kinds)}payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, carved string")
