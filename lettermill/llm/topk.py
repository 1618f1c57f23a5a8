"""Exact top-k inner products by distributed histogram selection.

All scores are integers, so a histogram can find the k-th highest exactly. Candidates and queries are cut into blocks,
and each pair of blocks is scored by one matrix product. In each round every pair of blocks counts, for each of its
queries, its scores by bins of the query's current range; counts are summed over all pairs of blocks, and the bin that
holds the k-th highest becomes the next range, until a bin is one score wide. Then the scores above the k-th are kept,
and of those equal to it the smallest ids that fill up k. A pair of blocks leaves out bins below the one in which it
alone reaches k (the k-th of all cannot be lower), and of the scores equal to the k-th all but the smallest ids that
could be needed, so neither counts nor ties grow with the candidates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermill.llm._common import Written, row_batches

NO_STATE = np.iinfo(np.int64).max
LARGEST = np.finfo(np.float64).max
MOST = np.iinfo(np.int64).max  #: scores beyond what the result's long holds stand as it
#: Of each vector its id, whether it has none, and its row number; the numbers in row-major order.
_BLOCK = "block long, rows int, dim int, ids binary, none binary, keys binary, data binary"


def quantise(vectors: list, scale: float = 64.0) -> list[np.ndarray | None]:
    """floor(scale * x) for each component as double; None for vectors that are null or hold null or non-finite ones. What
    a double cannot hold stands as the largest that it does."""
    out = []
    for v in vectors:
        if v is None or any(x is None for x in v):
            out.append(None)
            continue
        x = np.asarray(v, np.float64)
        if np.isfinite(x).all():
            with np.errstate(over="ignore"):
                out.append(np.clip(np.floor(x * scale), -LARGEST, LARGEST))
        else:
            out.append(None)
    return out


def _blocks(df: DataFrame, rows: int | None) -> DataFrame:
    """df: id, key, vec. Blocks of up to rows vectors (None: one for each partition, numbered like it), as numbers in
    row-major order; shorter vectors end in zeros."""

    def run(batches):
        ids, keys, vecs = [], [], []

        def block():
            dim = max((len(v) for v in vecs), default=0)
            data = np.zeros((len(vecs), dim), "<f8")
            for i, v in enumerate(vecs):
                data[i, : len(v)] = v
            # Numbers that fit take an eighth of the room.
            kind = "<i1" if data.size and np.abs(data).max() <= 127 else "<f8"
            own = np.array([i or 0 for i in ids], "<i8").tobytes()
            none = np.array([i is None for i in ids], bool).tobytes()
            out = pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([len(vecs)], pa.int32()), pa.array([dim], pa.int32()), pa.array([own]), pa.array([none]), pa.array([np.array(keys, "<i8").tobytes()]), pa.array([data.astype(kind).tobytes()])], names=["block", "rows", "dim", "ids", "none", "keys", "data"])
            ids.clear(), keys.clear(), vecs.clear()
            return out

        for batch in batches:
            i, k, v = row_batches(batch, "id", "key", "vec")
            for own, key, vec in zip(i, k, quantise(v)):
                if vec is not None:
                    ids.append(own)
                    keys.append(key)
                    vecs.append(vec)
                    if len(vecs) == rows:
                        yield block()
        if vecs:
            yield block()

    number = F.spark_partition_id().cast("long") if rows is None else F.monotonically_increasing_id()
    return df.mapInArrow(run, _BLOCK).withColumn("block", number)


def _matrix(rows: int, dim: int, data: bytes) -> np.ndarray:
    kind = "<i1" if len(data) == rows * dim else "<f8"
    return np.frombuffer(data, kind).reshape(rows, dim).astype(np.float64)


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products as int64: in float32 or float64 where those hold every partial sum exactly, in Python's integers
    beyond that."""
    dim = min(q.shape[1], c.shape[1])
    q, c = q[:, :dim], c[:, :dim]
    if not dim:
        return np.zeros((len(q), len(c)), np.int64)
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * dim
    if most < 2**24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return (q @ c.T).astype(np.int64)
    whole = np.array([[int(x) for x in row] for row in q], object) @ np.array([[int(x) for x in row] for row in c], object).T
    return np.clip(whole, -int(MOST), int(MOST)).astype(np.int64)


def _cells(batches, at_once: int, *names: str):
    """Of each pair of blocks the scores of at_once queries at a time: the row of the first, its slices of the named arrays
    (null stays null), which candidates are the query itself, the scores, and the pair."""
    for batch in batches:
        for i in range(batch.num_rows):
            r = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
            q, c = _matrix(r["q_rows"], r["dim"], r["q_data"]), _matrix(r["c_rows"], r["c_dim"], r["c_data"])
            keys, c_keys = np.frombuffer(r["q_keys"], "<i8"), np.frombuffer(r["c_keys"], "<i8")
            arrays = [None if r[n] is None else np.frombuffer(r[n], bool if n == "q_none" else "<i8") for n in names]
            for a in range(0, len(q), at_once):
                part = slice(a, a + at_once)
                yield a, keys[part], [x if x is None else x[part] for x in arrays], keys[part, None] == c_keys[None, :], _scores(q[part], c), r


def _count(bins: int, k: int, at_once: int):
    """Counts by bins of a width. Each query's range is [low, low + span), without an end where span is null; scores above it
    are of no interest here, as their number is known, and those below cannot hold the k-th. Distances from low are
    unsigned, as they can be twice what a long holds."""

    def run(batches):
        for first, keys, (low,), own, s, r in _cells(batches, at_once, "low"):
            low = np.full(len(keys), r["first_low"]) if low is None else low
            at, below = s.astype("<u8") - low.astype("<u8")[:, None], s < low[:, None]
            above = ~below & (at >= np.uint64(r["span"])) if r["span"] is not None else np.zeros_like(below)
            at = np.where(above | below | own, bins, (at // np.uint64(r["width"])).astype(np.int64)) + np.arange(len(keys))[:, None] * (bins + 1)
            counts = np.bincount(at.ravel(), minlength=len(keys) * (bins + 1)).reshape(len(keys), bins + 1)[:, :bins]
            higher = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts + (above & ~own).sum(axis=1)[:, None]
            row, bin_ = np.nonzero((counts > 0) & (higher < k))
            yield pa.RecordBatch.from_arrays([pa.array(keys[row]), pa.array(np.full(len(row), r["q_block"])), pa.array((first + row).astype(np.int32)), pa.array(bin_.astype(np.int64)), pa.array(counts[row, bin_])], names=["query", "q_block", "row", "bin", "n"])

    return run


def _select(at_once: int):
    """The scores above the k-th, and of those equal to it the smallest ids that could be needed; no id is after all ids."""

    def run(batches):
        for _, keys, (ids, none, kth, need), own, s, r in _cells(batches, at_once, "q_ids", "q_none", "low", "need"):
            if kth is None:
                continue
            c_ids, c_none = np.frombuffer(r["c_ids"], "<i8"), np.frombuffer(r["c_none"], bool)
            row, col = np.nonzero((s > kth[:, None]) & ~own)
            t_row, t_col = np.nonzero((s == kth[:, None]) & ~own)
            order = np.lexsort((c_ids[t_col], c_none[t_col], t_row))
            t_row, t_col = t_row[order], t_col[order]
            start = np.searchsorted(t_row, np.arange(len(keys)))
            keep = np.arange(len(t_row)) - start[t_row] < need[t_row]
            row, col = np.concatenate((row, t_row[keep])), np.concatenate((col, t_col[keep]))
            yield pa.RecordBatch.from_arrays([pa.array(keys[row]), pa.array(ids[row], mask=none[row]), pa.array(c_ids[col], mask=c_none[col]), pa.array(s[row, col])], names=["query", "query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, bins: int = 256, query_rows: int = 2048, candidate_rows: int = 4096, at_once: int = 256, few_bytes: int = 1 << 25) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: for each row where is_query holds its k highest scores against every
    other row (all, if there are fewer), ties to the smaller id.

    Defined results: vectors that are null, or hold null or non-finite components, take no part. Vectors of different
    lengths are scored as if the shorter ended in zeros. Empty vectors score 0. Repeated rows are rows of their own, each
    the other's candidate. Scores are exact as far as a long holds them. bins is 3 or more. A null id is no query (unless
    is_query says so) and ranks after all ids. An empty table gives an empty table. Other columns are ignored. Memory is
    bounded by a pair of blocks and the scores of at_once of its queries. Query blocks of up to few_bytes together go to
    all executors, so that candidates stay where they are; beyond that both are dealt out over a grid.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("key"))
    base = Written(base, "vectors").df
    c = Written(_blocks(base.select("id", "key", "vec"), candidate_rows), "candidates").df
    asking = base.filter("asks").select("id", "key", "vec")
    parts = max(1, -(-asking.count() // query_rows))
    q = Written(_blocks(asking.repartition(parts, "key"), None), "queries").df
    c = c.select(F.col("block").alias("c_block"), F.col("rows").alias("c_rows"), F.col("dim").alias("c_dim"), F.col("ids").alias("c_ids"), F.col("none").alias("c_none"), F.col("keys").alias("c_keys"), F.col("data").alias("c_data"))
    q = q.select(F.col("block").alias("q_block"), F.col("rows").alias("q_rows"), "dim", F.col("ids").alias("q_ids"), F.col("none").alias("q_none"), F.col("keys").alias("q_keys"), F.col("data").alias("q_data"))
    blocks, asked = c.count(), q.agg(F.sum(F.length("q_data") + 17 * F.col("q_rows")).alias("bytes")).first().bytes
    if not asked or not blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def cells(own: DataFrame) -> DataFrame:
        """own: the query blocks with what is known of each. Every one meets every candidate block: the stated queries
        against all rows, in blocks."""
        each = c.withColumn("q_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        if asked <= few_bytes:
            return each.join(F.broadcast(own), "q_block")
        # A cell of the grid is one query block and up to 64 candidate blocks.
        grid = -(-blocks // 64)
        own = own.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(grid - 1).cast("long"))))
        return each.withColumn("part", F.pmod(F.xxhash64("c_block"), F.lit(grid))).join(own, ["q_block", "part"])

    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.pow(F.floor(x.cast("double") * 64), 2)))
    ok = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    top = base.filter(F.col("vec").isNotNull() & ok).agg(F.max(F.when(F.col("asks"), norm(F.col("vec")))).alias("q"), F.max(norm(F.col("vec"))).alias("c")).first()
    reach = (top.q or 0.0) * (top.c or 0.0) * (1 + 1e-9)
    bound = int(reach) + 1 if reach < 2.0**62 else int(MOST)
    low = -bound
    width = -(-(2 * bound + 1) // bins)
    span = None
    state = None  # query, q_block, row, low, above: where the k-th score lies, and how many are higher
    wide = lambda x: x.cast("decimal(20,0)")
    while True:
        # The state is joined to the few query blocks, so the candidates move once in a round at most.
        known = q.withColumn("low", F.lit(None).cast("binary")) if state is None else q.join(_by_block(state, q), "q_block", "left")
        given = cells(known).withColumn("first_low", F.lit(low)).withColumn("width", F.lit(width)).withColumn("span", F.lit(span).cast("long"))
        counts = given.select("q_block", "q_rows", "dim", "q_keys", "q_data", "c_rows", "c_dim", "c_keys", "c_data", "low", "first_low", "width", "span").mapInArrow(_count(bins, k, at_once), "query long, q_block long, row int, bin long, n long")
        counts = counts.groupBy("query", "q_block", "row", "bin").agg(F.sum("n").alias("n"))
        if state is not None:
            counts = counts.join(state.select("query", F.col("low").alias("from"), "above"), "query")
        else:
            counts = counts.withColumn("from", F.lit(low)).withColumn("above", F.lit(0))
        down = Window.partitionBy("query").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = counts.withColumn("upto", F.sum("n").over(down) + F.col("above"))
        # The bin where the count reaches k; the lowest bin with any score, if it never does.
        reach = ranked.groupBy("query", "q_block", "row").agg(F.coalesce(F.max(F.when(F.col("upto") >= k, F.struct("bin", (F.col("upto") - F.col("n")).alias("above"), "from"))), F.min(F.struct("bin", (F.col("upto") - F.col("n")).alias("above"), "from"))).alias("at"))
        state = Written(reach.select("query", "q_block", "row", (wide(F.col("at.from")) + wide(F.col("at.bin")) * wide(F.lit(width))).cast("long").alias("low"), F.col("at.above").alias("above")), "state").df
        if width == 1:
            break
        span, width = width, -(-width // bins)
    final = cells(q.join(_by_block(state.withColumn("need", F.lit(k) - F.col("above")), q), "q_block", "left"))
    picked = final.select("q_rows", "dim", "q_ids", "q_none", "q_keys", "q_data", "c_rows", "c_dim", "c_ids", "c_none", "c_keys", "c_data", "low", "need").mapInArrow(_select(at_once), "query long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return picked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _by_block(state: DataFrame, q: DataFrame) -> DataFrame:
    """The state of each query block's rows (at most query_rows) as arrays of bytes, in the order of the rows. A query
    without any candidate, in the only block, has a range above all scores."""
    cols = [c for c in ("low", "need") if c in state.columns]
    each = state.groupBy("q_block").agg(F.collect_list(F.struct("row", *cols)).alias("each")).join(q.select("q_block", "q_rows"), "q_block")

    def run(batches):
        for batch in batches:
            blocks, states, rows = row_batches(batch, "q_block", "each", "q_rows")
            out: dict[str, list] = {c: [] for c in cols}
            for own, n in zip(states, rows):
                full = {c: np.full(n, NO_STATE if c == "low" else 0, "<i8") for c in cols}
                for s in own:
                    for c in cols:
                        full[c][s["row"]] = s[c]
                for c in cols:
                    out[c].append(full[c].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), *(pa.array(out[c], pa.binary()) for c in cols)], names=["q_block", *cols])

    return each.mapInArrow(run, "q_block long, " + ", ".join(f"{c} binary" for c in cols))


#: Brute force in DuckDB's SQL, over the view embeddings.
SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 20
"""
