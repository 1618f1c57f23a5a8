import re
import gzip
import hashlib
import io
import struct
import zipfile
import zlib

from lettermill.llm import media


def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def archive():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello" * 50)
    return out.getvalue()


GIF = b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff!\xf9\x04\0\0\0\0\0,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
BMP = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0\0\0\0"
WHOLE = {"image/png": png(), "image/gif": GIF, "image/bmp": BMP, "audio/wav": media.wav_of(bytes(64)), "application/zip": archive(), "application/gzip": gzip.compress(b"x" * 99)}


def test_types_and_lengths():
    for kind, b in WHOLE.items():
        assert media.sniff(b) == (kind, []), kind
        assert media.objects(b"junk" + b + b"tail")[0] == media.Part(kind, 4, len(b)), kind
        assert media.objects(b[: len(b) // 2]) == [], kind
    assert media.sniff(None) == (None, []) and media.sniff(b"")[0] == media.OCTETS
    assert media.sniff(b"plain words")[0] == media.TEXT and media.sniff(b"\x00\x01")[0] == media.OCTETS


def test_control_characters_anywhere():
    for at in (0, 4095, 4096, 9999):
        for c in (b"\x00", b"\x01", b"\x0b", b"\x1f"):
            assert media.sniff(b"a" * at + c + b"a" * 100)[0] == media.OCTETS, (at, c)
    assert media.sniff(b"a\t\r\n" * 3000 + b"\x7f")[0] == media.TEXT
    assert media.sniff(b"a" * 9999 + b"\xff")[0] == media.OCTETS


def test_several_and_nested():
    both = b"--" + WHOLE["image/png"] + b"~~" + WHOLE["image/gif"]
    assert [p.kind for p in media.objects(both)] == ["image/png", "image/gif"]
    inside = media.wav_of(WHOLE["image/gif"] + bytes(len(WHOLE["image/gif"]) % 2))
    assert media.sniff(inside) == ("audio/wav", [])


def test_text_round_trip(odd, none_at_all):
    stored = media.store_text(odd, id_cols=["doc_id"])
    got = {r.doc_id: r for r in media.stored_features(stored, keep=["doc_id", "n_bytes"]).collect()}
    for r in odd.collect():
        raw = (r.text or "").encode()
        full = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        x = got[r.doc_id]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256) == (len(raw), len(full), hashlib.sha256(full).hexdigest())
        assert x.tail_crc32 == zlib.crc32(full[-64:]) and x.feature.startswith("audio/wav|corrected|0|")
        assert x.media_sha256 == hashlib.sha256(media.wav_of(full)).hexdigest() and x.media_bytes == len(full) + 44
    assert media.store_text(none_at_all, id_cols=["doc_id"]).count() == 0


def test_search_of_the_payload(spark):
    """A text may hold a whole document of a text format; the query's path finds it in the samples read back."""
    pdf = "%PDF-1.4\n1 0 obj\nstartxref\n9\n%%EOF\n"
    texts = {1: "plain", 2: f"before {pdf}after", 3: pdf, 4: "BM GIF89a %PDF- fLaC PK only numbers", 5: f"{pdf} x {pdf}"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in media.stored_features(media.store_text(df, id_cols=["doc_id"]), keep=["doc_id"]).collect()}
    for i, text in texts.items():
        samples = media.padded(text)[0]
        level = [abs(x) for x in samples]
        want = [f"application/pdf:{m.start()}:{len(pdf)}" for m in re.finditer(re.escape(pdf), text)]
        assert got[i].carved == ",".join(want)
        crossings = sum((a >= 128) != (b >= 128) for a, b in zip(samples, samples[1:]))
        assert got[i].feature == f"audio/wav|corrected|{len(want)}|{sum(level) / len(level):.6f}|{crossings}|{len(set(samples))}"


def test_carving(spark):
    df = spark.createDataFrame([(1, "image/png", bytearray(b"--" + GIF + b"--")), (2, None, None)], "id int, declared_type string, content binary")
    s = media.sniff_media(df, keep=["id", "content"])
    assert [(r.kind, bytes(r.content)) for r in media.carve(s, id_cols=["id"]).collect()] == [("image/gif", GIF)]
    assert {r.id: r.corrected for r in s.collect()} == {1: True, 2: False}
