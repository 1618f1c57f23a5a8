import duckdb

from lettermill.llm import mixing
from lettermill.llm.queries import op10_mixing


def test_as_the_sql(spark, small):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = {r[0]: tuple(r[1:]) for r in c.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.SQL})").fetchall()}
    got = {r.doc_id: (r["size"], r.source_size, r.target, r.taken) for r in op10_mixing(spark, small).collect()}
    assert got == want


def test_law(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    mix = mixing.plan_mix(docs)
    rows = mix.rows.collect()
    longest = max(r["size"] for r in rows)
    by = {}
    for r in rows:
        assert r.taken in (0, r["size"], 2 * r["size"])
        s = by.setdefault((r.source_size, r.target), [0])
        s[0] += r.taken
    assert all(abs(s[0] - target) <= longest for (_, target), s in by.items())
    assert all(target <= 2 * size + 1e-6 for size, target in by)
    assert sum(r.taken for r in rows) <= 1.5 * sum(r["size"] for r in rows)
    applied = mixing.apply_mix(docs, mix)
    assert applied.columns == docs.columns
    assert applied.count() == sum(r.passes for r in rows)


def test_targets_are_shared_again(spark):
    t = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(t).collect()}
    # 3015 words in all; a stops at 20, what is left goes to b and c as 1 to 2
    assert got["a"] == 20.0 and got[None] == 0.0
    assert abs(got["b"] - 2995 / 3) < 1e-6 * 3000 or got["c"] == 2000.0
    assert abs(sum(got.values()) - 3015) < 1e-6


def taken(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return docs, mixing.plan_mix(docs, **options)


def by_sql(rows):
    import pandas as pd

    c = duckdb.connect()
    c.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source"]))
    return sorted(c.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.SQL})").fetchall(), key=str)


def test_many_tasks_as_one(spark):
    """The ways for many sources and for many rows at the cut, on few."""
    rows = [(i, "w " * (i % 7), f"s{i % 23}" if i % 3 else "hot") for i in range(900)]
    want = by_sql(rows)
    for options in ({}, {"few": 0, "single": 4}):
        docs, mix = taken(spark, rows, **options)
        got = sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mix.rows.collect()), key=str)
        assert got == want
        assert mixing.apply_mix(docs, mix).count() == sum(r.passes for r in mix.rows.collect())


def test_sources_of_one_document_and_one_id(spark):
    # Every source has one document and all finish at the same times; then a source whose every row shares one id.
    rows = [(i, "w w w", f"s{i:04d}") for i in range(300)]
    _, mix = taken(spark, rows, single=4)
    assert sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mix.rows.collect()), key=str) == by_sql(rows)
    rows = [(5, "w w", "a")] * 400 + [(i, "w w", "b") for i in range(200)]
    docs, mix = taken(spark, rows)
    got = mix.rows.collect()
    assert len({r.passes for r in got if r.doc_id == 5 and r.source_size == 800}) == 1
    assert sum(r.taken for r in got) <= 1.5 * 1200
    assert mixing.apply_mix(docs, mix).count() == sum(r.passes for r in got)


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(i, "a b", "s", 1, 2, 3, 4, 5) for i in range(6)], "doc_id long, text string, source string, _mix_source int, doc int, n int, last0 int, _source int")
    mix = mixing.plan_mix(docs)
    out = mixing.apply_mix(docs, mix)
    assert out.columns == docs.columns and out.count() == sum(r.passes for r in mix.rows.collect())
    assert {tuple(r)[3:] for r in out.collect()} == {(1, 2, 3, 4, 5)}


def test_odd_rows(odd, none_at_all):
    one, two = (sorted(map(tuple, mixing.plan_mix(odd).rows.collect()), key=str) for _ in range(2))
    assert one == two and len(one) == odd.count()
    assert all(r[4] <= 2 * r[1] for r in one)
    assert mixing.plan_mix(none_at_all).rows.count() == 0
    assert mixing.apply_mix(odd, mixing.plan_mix(odd)).columns == odd.columns
