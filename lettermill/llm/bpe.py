"""Byte-level BPE through sentencepiece.

The rank file's vocabulary is serialised as a sentencepiece BPE model: each byte stands as one printable character,
each token as the characters of its bytes with score -rank, and the normaliser changes nothing. Texts are split by the
pre-token pattern; each pre-token is encoded alone, so its merges are those of the ranks. Decoding maps each id to its
bytes.

Defined results: a null text counts as empty and an empty text has no tokens. Lone surrogates, which UTF-8 cannot hold,
become `?`. Very long texts and pre-tokens are encoded whole. Repeated rows get the same ids.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from itertools import accumulate, chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm._common import few_rows, row_batches

UNKNOWN = "<unk>"


def default_vocabulary() -> tuple[str, str]:
    """The path of the rank file and the pre-token pattern, from the installed tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return [ranks[i] for i in range(len(ranks))]


#: One character for each byte, all letters of one block that no normaliser or splitter touches.
BYTE_CHAR = [chr(0x4E00 + b) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_bytes(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: pieces in rank order, then the unknown piece that the library asks for."""
    import struct

    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(BYTE_CHAR[b] for b in token).encode()
        out += _field(1, _field(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)) + _field(3, 1))
    out += _field(1, _field(1, UNKNOWN.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + b"".join(_varint(n << 3) + _varint((1 << 64) - 1) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(out + _field(2, trainer) + _field(3, normaliser))


class ByteBpe:
    """encode and decode whole texts. The ids of short pre-tokens are kept, at most cache_size of them."""

    def __init__(self, path: str, pattern: str, cache_size: int = 200_000, cached_length: int = 48):
        import sentencepiece

        self.tokens = read_ranks(path)
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.tokens))
        # White space as Unicode defines it, which some engines' \s widens by four control characters.
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"), regex.V0).findall
        self.decimal = [str(i) for i in range(len(self.tokens))]
        #: One object for each id, which all that is kept of texts shares.
        self.ids = list(range(len(self.tokens) + 1))
        self.cache: dict[str, tuple[int, ...]] = {}
        self.cache_size, self.cached_length = cache_size, cached_length
        self.chars = {b: c for b, c in enumerate(BYTE_CHAR)}

    def _pieces(self, pre_tokens: list[str]) -> list[list[int]]:
        return self.processor.encode([p.encode("utf-8", "replace").decode("latin-1").translate(self.chars) for p in pre_tokens], out_type=int, num_threads=1)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        cache, pre = self.cache, self.split(text)
        if missing := [p for p in set(pre) if p not in cache]:
            if len(cache) + len(missing) > self.cache_size:
                cache.clear()
                missing = list(set(pre))
            fresh = {p: tuple(map(self.ids.__getitem__, found)) for p, found in zip(missing, self._pieces(missing))}
            table = cache | fresh if len(fresh) > self.cache_size else cache
            if table is cache:
                cache.update(fresh)
            ids = list(chain.from_iterable(map(table.__getitem__, pre)))
            for p in fresh:
                if len(p) > self.cached_length:
                    cache.pop(p, None)
            return ids
        return list(chain.from_iterable(map(cache.__getitem__, pre)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> ByteBpe:
    """One for each Python worker."""
    return ByteBpe(path, pattern)


def encode_documents(docs: DataFrame, *, id_cols: list[str], text_col: str = "text", path: str | None = None, pattern: str | None = None, digests: bool = True, ids: bool = False) -> DataFrame:
    """id_cols with n_tokens and, as asked for, ids (array<int>), ids_sha256 and decoded_sha256 of the ids decoded again."""
    own_path, own_pattern = default_vocabulary()
    path, pattern = path or own_path, pattern or own_pattern
    given = docs.select(*id_cols, F.col(text_col).alias("_text_"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])

    def run(batches):
        bpe = tokenizer(path, pattern)
        for batch in few_rows(batches):
            (texts,) = row_batches(batch, "_text_")
            rows = []
            for text in texts:
                own = bpe.encode(text)
                said = hashlib.sha256(" ".join(map(bpe.decimal.__getitem__, own)).encode()).hexdigest() if digests else None
                rows.append((len(own), pa.array(own, pa.int32()) if ids else None, said, hashlib.sha256(bpe.decode(own)).hexdigest() if digests else None))
            out = [batch.column(batch.schema.get_field_index(c)) for c in id_cols]
            out.append(pa.array([r[0] for r in rows], pa.int64()))
            names = [*id_cols, "n_tokens"]
            if ids:
                ends = list(accumulate((r[0] for r in rows), initial=0))
                out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays([r[1] for r in rows]) if rows else pa.array([], pa.int32())))
                names.append("ids")
            if digests:
                out += [pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.string())]
                names += ["ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    more = ", ids array<int>" * ids + ", ids_sha256 string, decoded_sha256 string" * digests
    return given.mapInArrow(run, f"{kinds}, n_tokens long{more}")
