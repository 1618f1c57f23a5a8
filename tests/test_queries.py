"""Every registered query with SQL against DuckDB on the smallest tables; every other one must run."""

import duckdb
import pandas as pd
import pytest

from lettermill.queries import mail, relational, search, sources, upkeep

QUERIES = {n: f for m in (relational, search, mail, sources, upkeep) for n, f in m.QUERIES.items()}
ORACLE = {n: f for m in (relational, search, mail, sources, upkeep) for n, f in m.ORACLE.items()}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def cell(v) -> str:
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
        return "~"
    if isinstance(v, pd.Timestamp):
        return str(v)
    try:
        return f"{float(v):.5f}" if not isinstance(v, (str, bool)) else str(v)
    except (TypeError, ValueError):
        return str(v)


def rows(p: pd.DataFrame) -> list[tuple[str, ...]]:
    return sorted(tuple(map(cell, r)) for r in p[sorted(p.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    got = QUERIES[name](spark, small).toPandas()
    if name in ORACLE:
        want = duck.execute(ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


SMALL_FIGURES = [3e-4, -4e-4, -3e-5, 3e-5, 0.0, 1e-3, -2e-3, 0.5, *[0.125] * 56]
VECTORS = {
    "figures below a thousandth or rounded up to zero": [(1, SMALL_FIGURES), (None, SMALL_FIGURES), (2, SMALL_FIGURES), (2, [-x for x in SMALL_FIGURES[:8]] + SMALL_FIGURES[8:])],
    "short, long, missing": [(1, [0.6, -0.8]), (2, [0.5] * 66), (3, None), (4, []), (5, None), (5, [1.0] + [0.0] * 63), (6, [None, *SMALL_FIGURES[1:]])],
    "of zeros, not finite": [(1, [0.0] * 64), (2, [float("inf"), -1.0] + [0.0] * 62), (3, [float("nan"), 1.0] + [0.0] * 62)],
}


@pytest.mark.parametrize("kind", VECTORS)
def test_mean_vectors_as_the_sql_writes_them(spark, tmp_path, kind):
    rows = [(i, v, label) for i, (label, v) in enumerate(VECTORS[kind])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = QUERIES["mean_vectors"](spark, str(tmp_path)).collect()
    assert {(r.label, r["head"]) for r in got} == set(c.execute(ORACLE["mean_vectors"]).fetchall()) and len(got) == len({label for label, _ in VECTORS[kind]})
