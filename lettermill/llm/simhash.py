"""Near duplicates by 64-bit SimHash, linked through a byte-position inverted index with count filtering.

Fingerprints with at most 3 differing bits differ in at most 3 bytes, so they share at least 5 of 8 positional bytes.
Equal fingerprints are first put together, so that groups of copies count once. Each distinct fingerprint is then posted
under compound keys of positional bytes. The keys are chosen so that any 5 shared positions contain one of them
(positions in two halves of four, all triples of each half: a set of 5 positions has 3 in one half). Where two meet in a
posting list, the positional bytes that they share are tallied, all eight; pairs with fewer than 5 are not retained, the
rest are verified by their differing bits.

A posting list that is long because one text has very many near copies would give pairs by the square of its length.
Such lists are not paired: their members are linked exactly, in linear work, by what lies between them. Two fingerprints
at most 3 bits apart have a value v at most 1 bit from one and at most 2 bits from the other. For each v near both kinds,
all members within 2 bits are linked to the smallest member within 1 bit, which is at most 3 bits from each of them.
Nothing is capped and no link between components is lost.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm._common import Written, few_rows, give_back, join_by_key, row_batches
from lettermill.llm.graph import components

BITS, BYTES = 64, 8
_PLACE = (np.arange(BYTES) * 256).astype(np.int64)
_HAS_BIT = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


#: The primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def xxh64_spans(data: bytes, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of data[a:b] for each span. Spans under 32 bytes, nearly all shingles, are hashed as one array; others by
    the library."""
    padded = data + bytes(8)
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    fours = np.ndarray((len(data) + 1,), "<u4", padded, strides=(1,))
    ones = np.frombuffer(padded, np.uint8)
    size = ends - starts
    with np.errstate(over="ignore"):
        acc = np.uint64(seed) + P5 + size.astype(np.uint64)
        lanes, at = size >> 3, starts.copy()
        for lane in range(3):
            i = np.flatnonzero(lanes > lane)
            k = _rotl(eights[at[i]] * P2, 31) * P1
            acc[i] = _rotl(acc[i] ^ k, 27) * P1 + P4
            at[i] += 8
        i = np.flatnonzero(size & 4)
        acc[i] = _rotl(acc[i] ^ (fours[at[i]].astype(np.uint64) * P1), 23) * P2 + P3
        at[i] += 4
        for left in range(3):
            i = np.flatnonzero((size & 3) > left)
            acc[i] = _rotl(acc[i] ^ (ones[at[i]].astype(np.uint64) * P5), 11) * P1
            at[i] += 1
        acc = (acc ^ (acc >> np.uint64(33))) * P2
        acc = (acc ^ (acc >> np.uint64(29))) * P3
        acc ^= acc >> np.uint64(32)
    for i in np.flatnonzero(size >= 32).tolist():
        acc[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]], seed)
    return acc


def text_fingerprints(texts: list[str | None], words: int = 3, seed: int = 42, at_once: int = 1 << 20) -> np.ndarray:
    """Unsigned fingerprints. Null and empty texts, and those of white space alone, have 0. Shingles are hashed in
    arrays of about at_once bytes of text; a longer text makes one array of its own, in pieces of that many shingles."""
    out = np.zeros(len(texts), np.uint64)
    group: list[tuple[int, bytes, int]] = []
    size = 0

    def flush() -> None:
        data = b" ".join(b for _, b, _ in group)
        gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
        starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(data)]))
        first = 0
        for doc, _, n in group:
            k = min(words, n)
            a, b = starts[first : first + n - k + 1], ends[first + k - 1 : first + n]
            ranges.append((doc, len(a)))
            spans.append((a, b))
            first += n
        a, b = (np.concatenate(x) for x in zip(*spans))
        hashes = np.concatenate([xxh64_spans(data, a[i : i + at_once], b[i : i + at_once], seed) for i in range(0, len(a), at_once)])
        # How often each byte value stands at each position; a bit's votes are the counts of the values that have it.
        values = hashes.astype("<u8").view(np.uint8).reshape(-1, BYTES)
        done = 0
        for doc, n in ranges:
            seen = np.bincount((values[done : done + n] + _PLACE).ravel(), minlength=256 * BYTES).reshape(BYTES, 256)
            votes = (seen @ _HAS_BIT).ravel()
            out[doc] = np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0]
            done += n
        group.clear()
        ranges.clear()
        spans.clear()

    ranges: list[tuple[int, int]] = []
    spans: list[tuple[np.ndarray, np.ndarray]] = []
    for doc, text in enumerate(texts):
        parts = (text or "").encode("utf-8", "replace").lower().split()
        if parts:
            group.append((doc, b" ".join(parts), len(parts)))
            size += len(group[-1][1])
            if size >= at_once:
                flush()
                size = 0
    if group:
        flush()
    return out


def fingerprints(docs: DataFrame, *, id_cols: list[str], text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """id_cols with fp, the fingerprint as a signed long."""
    given = docs.select(*id_cols, F.col(text_col).alias("_text_"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])

    def run(batches):
        for batch in few_rows(batches):
            (texts,) = row_batches(batch, "_text_")
            fps = text_fingerprints(texts, words, seed).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in id_cols), pa.array(fps)], names=[*id_cols, "fp"])

    return given.mapInArrow(run, f"{kinds}, fp long")


def key_positions(distance: int = 3, half: int = 4) -> list[tuple[int, ...]]:
    """Sets of byte positions such that any BYTES - distance shared positions contain one of them."""
    need = BYTES - distance
    halves = [range(i, i + half) for i in range(0, BYTES, half)]
    size = -(-need // len(halves))
    return [c for h in halves for c in itertools.combinations(h, size)]


def _mask(positions: tuple[int, ...]) -> int:
    m = sum(255 << 8 * p for p in positions)
    return m - (1 << 64) if m >> 63 else m


def _near(fps: DataFrame, bits: int) -> DataFrame:
    """v, fp: for each of fps (column fp) the values at most so many bits from it, itself among them."""
    flips = [0, *(1 << i for i in range(BITS)), *((1 << i) | (1 << j) for i in range(BITS) for j in range(i))]
    flips = np.array(flips[: 1 + BITS * bits if bits < 2 else None], np.uint64)

    def run(batches):
        for batch in batches:
            own = batch.column(0).to_numpy().astype(np.int64).view(np.uint64)
            for i in range(0, len(own), 128):
                part = own[i : i + 128]
                v, who = (part[:, None] ^ flips).ravel(), np.repeat(part, len(flips))
                yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(who.view(np.int64))], names=["v", "fp"])

    return fps.select("fp").mapInArrow(run, "v long, fp long")


def _between(fps: DataFrame) -> DataFrame:
    """a, b: links among the members of long posting lists (column fp), by what lies between them, for distance 3."""
    hubs = _near(fps, 1).groupBy("v").agg(F.min("fp").alias("hub"))
    return _near(fps, 2).join(hubs, "v").filter("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct()


def posting_keys(distance: int = 3) -> list:
    """The compound keys of column fp: which positions, and their bytes."""
    return [F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_mask(p))).alias("bytes")) for i, p in enumerate(key_positions(distance))]


def tallied(postings: DataFrame) -> DataFrame:
    """a, b, shared: for every pair that meets in a posting list (part, bytes, fp) how many of the eight positional bytes
    they share. A pair that meets in several lists is there as often."""
    a, b = postings.alias("a"), postings.alias("b")
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    shared = sum((F.when(differ.bitwiseAND(F.lit(_mask((p,)))) == 0, 1).otherwise(0) for p in range(BYTES)), F.lit(0))
    met = a.join(b, F.expr("a.part = b.part AND a.bytes = b.bytes AND a.fp < b.fp"))
    return met.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"), shared.alias("shared"))


def links(fps: DataFrame, *, distance: int = 3, long_list: int = 1024) -> Written:
    """The table of a, b: links between distinct fingerprints (column fp, each once; a written table) that lead to the
    exact components. Pairs from posting lists of up to long_list members are all the pairs within the distance; longer
    lists give enough links to connect what is connected."""
    if distance != 3:
        raise ValueError("the keys and the linear path are laid out for a distance of 3")
    posted = fps.select("fp", F.explode(F.array(*posting_keys(distance))).alias("k")).select("fp", "k.part", "k.bytes")
    lists = Written(posted.groupBy("part", "bytes").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "postings")
    size = F.col("n").alias("size")
    total = lists.df.agg(F.sum("n")).first()[0] or 0
    kept = Written(join_by_key(posted, lists.df.select("part", "bytes", "n", size), ["part", "bytes"], "n", total), "kept")
    retained = tallied(kept.df.filter(F.col("size") <= long_list).select("part", "bytes", "fp")).filter(F.col("shared") >= BYTES - distance)
    pairs = retained.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b")
    crowded = kept.df.filter(F.col("size") > long_list).select("fp").distinct()
    out = Written(pairs.union(_between(crowded)).distinct(), "links")
    lists.drop(), kept.drop()
    return out


def _rooted(each: DataFrame, distance: int) -> Written:
    """each: a written table with fp, each once. The same with root, the smallest fingerprint of its component."""
    edges = links(each.select("fp"), distance=distance)
    roots = components(edges.df)
    out = Written(each.join(roots.df.select("node", F.col("root").alias("_root")), each.fp == F.col("node"), "left").select(*each.columns, F.coalesce("_root", "fp").alias("root")), "roots")
    edges.drop(), roots.drop()
    return out


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3) -> DataFrame:
    """id_col, fingerprint (16 hexadecimal digits) and component_id: the smallest id among the documents that can be
    reached over links of at most distance bits. One row for each input row.

    Defined results: null, empty and wordless texts have fingerprint zero and link like any others. Rows with a null id
    get a row too; they take part in links but never name a component, unless all its ids are null. Repeated rows are
    each kept. An empty table gives an empty table. Other columns are ignored. A fingerprint or a component with a large
    part of all rows is split (join_by_key).
    """
    own = Written(fingerprints(docs.select(F.col(id_col).alias("_id_"), F.col(text_col).alias("_t_")), id_cols=["_id_"], text_col="_t_", words=words), "fingerprints")
    each = Written(own.df.groupBy("fp").agg(F.min("_id_").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    totals = each.df.agg(F.count(F.lit(1)).alias("prints"), F.sum("n").alias("rows")).first()
    placed = _rooted(each.df, distance)
    named = Written(placed.df.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members")), "named")
    by_fp = Written(join_by_key(placed.df.select("fp", "n", "root"), named.df, ["root"], "members", totals.prints).select("fp", "n", "component_id"), "by-print")
    for done in (each, placed, named):
        done.drop()
    out = join_by_key(own.df, by_fp.df, ["fp"], "n", totals.rows or 0)
    return out.select(F.col("_id_").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3) -> DataFrame:
    """The documents without near copies of others: of each component the row with the smallest id stays, and of rows
    that tie on it the one with the smallest hash of its columns (but maps), then the first as stored. Null ids come
    last. Rows are whole, with their own columns only, whatever they are called; an empty table gives an empty table.

    The documents are written once with a number for each row; all that decides works on numbers, ids and fingerprints,
    and one join by row number, which no two rows share, takes the documents that stay."""
    own = docs.schema.fields

    @F.pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(text_fingerprints(texts.tolist(), words).view(np.int64))
        give_back()

    hashed = [F.col(f"`{f.name}`") for f in own if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    full = docs.select(F.struct(*(F.col(f"`{f.name}`") for f in own)).alias("doc"), prints(F.col(text_col)).alias("fp"), F.xxhash64(*hashed).alias("hash"), F.monotonically_increasing_id().alias("row"))
    full = Written(full, "documents").df
    id_ = F.col("doc")[id_col]
    each = Written(full.groupBy("fp").agg(F.min(F.struct(id_.isNull().alias("none"), id_.alias("id"), "hash", "row")).alias("least")), "distinct")
    placed = _rooted(each.df, distance)
    stay = Written(placed.df.groupBy("root").agg(F.min("least").alias("least")).select("least.row"), "stay")
    each.drop(), placed.drop()
    # The numbers of a partition are few bytes, so they are hashed and the documents need no sort.
    return full.join(stay.df.hint("shuffle_hash"), "row").select("doc.*")
