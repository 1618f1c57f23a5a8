import math

import numpy as np
from pyspark.sql import functions as F

from lettermill.llm import topk
from lettermill.llm.queries import op2_exact_top_k


def brute(rows, k=20, every=20):
    """rows: (id, vector)."""
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(good):
        if q is not None and q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), math.inf if i is None else i) for m, (i, b) in enumerate(good) if m != n)
            out += [(q, r + 1, None if i == math.inf else i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out, key=str)


def test_as_by_brute_force(spark, small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert sorted(map(tuple, op2_exact_top_k(spark, small).collect()), key=str) == brute(rows)


def test_ties_nulls_lengths_and_large_values(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [0.5, 0.5]) for i in range(60)] + [(i, list(map(float, rng.integers(-3, 3, 3) / 4))) for i in range(60, 100)]
    rows += [(100, None), (101, [1.0, None]), (102, [float("nan")]), (103, [float("inf")]), (104, []), (None, [0.25, 0.5]), (105, [1e6, -1e6]), (20, [0.5, 0.5])]
    df = spark.createDataFrame([(i, v, 9, 9.0) for i, v in rows], "vec_id long, embedding array<double>, rank int, score double")
    for few in (1 << 25, 0):  # query blocks sent to all, and over a grid
        got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=7, query_rows=3, candidate_rows=16, bins=16, at_once=2, few_bytes=few)
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 7)
    # More asked for than there is, at the usual sizes: all, ties by id over all blocks.
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0, k=500).collect()), key=str) == brute(rows, 500)


def test_ends_of_the_types(spark):
    rows = [(0, [1.0, 0.0]), (2**63 - 1, [1.0, 2.0]), (None, [1.0, 1.0]), (5, [1e308, 0.0]), (6, [-1.7e308, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r)[2:] for r in topk.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(5, 2**63 - 1), (2**63 - 1, 4096), (None, 4096), (6, 1 - 2**63)]


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [0.5])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2048)]
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0
    assert topk.top_k(df.filter("vec_id = 0"), F.lit(True)).count() == 0


def test_scores_up_to_the_end_of_long(spark):
    big = 2.0**25
    rows = [(i, [big - i / 64, 0.25]) for i in range(60)] + [(i, [i / 64 - big, 0.5]) for i in range(60, 90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, 70)
    assert len({s for _, _, _, s in want if s > 1 << 60}) > 60
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0, k=70, query_rows=3, candidate_rows=16, bins=16).collect()), key=str) == want
    # Beyond what a long holds.
    df = spark.createDataFrame([(0, [1e12]), (1, [2e12]), (2, [-1e12]), (3, [1e-2 * 2**25])], "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(1, 2**63 - 1), (3, 2**63 - 1), (2, 1 - 2**63)]
