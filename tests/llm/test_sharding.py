from collections import Counter

import pytest
from pyspark.sql import functions as F

from lettermill.llm import sharding
from lettermill.llm.graph import components
from lettermill.llm.queries import op5_sharding


def check(rows, n, shards):
    counts = Counter(r.shard for r in rows)
    assert len(rows) == n and max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))


def test_even_and_whole(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = op5_sharding(spark, small).collect()
    check(rows, docs.count(), 40)
    text = {r.doc_id: r.text for r in docs.collect()}
    groups = {}
    for r in rows:
        assert r.law == "rows" and r.grown_shard is None and r["size"] == len((text[r.doc_id] or "").encode()) + 16
        groups.setdefault(text[r.doc_id], []).append(r.shard)
    copies = [g for g in groups.values() if 1 < len(g) <= len(rows) // 40]
    assert sum(len(set(g)) == 1 for g in copies) >= 0.8 * len(copies)


def test_hot_group_is_cut_into_few_shards(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 700, "same").otherwise(F.col("id").cast("string")).alias("text"))
    rows = sharding.shard_rows(docs, shards=10, chunk=50).collect()
    check(rows, 2000, 10)
    held = Counter(r.shard for r in rows if r.doc_id < 700)
    # A random deal leaves 70 in each; kept together, most shards hold whole hubs' worth of them or few.
    assert sum(n * (n - 1) for n in held.values()) > 1.25 * 10 * 70 * 69


def test_odd_rows(odd, none_at_all):
    check(sharding.shard_rows(odd, shards=4).collect(), odd.count(), 4)
    assert sharding.shard_rows(none_at_all).count() == 0


def test_only_groups_beyond_a_shard_are_cut(spark):
    nodes = spark.range(3000).select(F.col("id").alias("node"), F.when(F.col("id") < 900, "fits").when(F.col("id") < 2950, "large").otherwise(F.col("id").cast("string")).alias("g"))
    links = sharding.copy_links(nodes, group_col="g", most=1000, chunk=50)
    whole = Counter(Counter(r.root for r in components(links).df.collect()).values())
    assert whole == Counter({900: 1, 1000: 2, 50: 1})
    spokes = Counter(r.b for r in links.filter("w = 1").collect())
    assert all(r.w > spokes[r.a] for r in links.filter("w > 1").collect())


def slow_labels(links):
    """Label propagation over lists of neighbours, all nodes at once, until nobody moves."""
    near = {}
    for a, b, w in links:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    labels = {n: n for n in near}
    while True:
        new = {}
        for n, others in near.items():
            votes = Counter()
            for b, w in others:
                votes[labels[b]] += w
            new[n] = min(labels[n], min(votes, key=lambda x: (-votes[x], x)))
        if new == labels:
            return labels
        labels = new


def test_as_by_brute_force(spark):
    """Labels against plain propagation, and their shards against first fit, the largest first, one label at a time."""
    group = lambda i: "large" if i < 700 else i // 130 if i < 1500 else i // 7 if i < 2200 else i
    docs = spark.createDataFrame([(i, str(group(i))) for i in range(3000)], "doc_id long, text string").coalesce(1)
    links = sharding.copy_links(docs.selectExpr("doc_id AS node", "text AS g"), group_col="g", most=300, chunk=20)
    want = slow_labels([tuple(r) for r in links.collect()])
    assert {r.node: r.hub for r in sharding.propagate(links).collect()} == want
    assert len({want[i] for i in range(700)}) == 3 and all(len({want[j] for j in want if group(j) == group(i)}) == 1 for i in range(700, 2200, 50))
    sizes = Counter(want.values())
    room, to = sharding.quotas(3000, 10), {}
    for label in sorted(sizes, key=lambda x: (-sizes[x], x)):
        to[label] = next((s for s in range(10) if room[s] >= sizes[label]), None)
        if to[label] is not None:
            room[to[label]] -= sizes[label]
    rows = {r.doc_id: r.shard for r in sharding.shard_rows(docs, shards=10, chunk=20).collect()}
    assert all(rows[n] == to[label] for n, label in want.items() if to[label] is not None)


def test_hot_groups_without_skew_handling(spark):
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        group = lambda i: 0 if i < 2000 else i // 4
        docs = spark.createDataFrame([(i, str(group(i))) for i in range(6000)], "doc_id long, text string")
        rows = sharding.shard_rows(docs, shards=10).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.skewJoin.enabled")
    check(rows, 6000, 10)
    assert len({r.shard for r in rows if r.doc_id < 2000}) == 4


def held_by(rows, group):
    found = {}
    for r in rows:
        found.setdefault(group(r.doc_id), set()).add(r.shard)
    return found


def test_groups_stay_whole_where_all_rows_have_copies(spark):
    # 10 shards of 600: groups of 300 (more than a hub), 30, and 3, which fit without a rest.
    group = lambda i: i // 300 if i < 3000 else 100 + i // 30 if i < 4500 else 1000 + i // 3
    docs = spark.createDataFrame([(i, str(group(i))) for i in range(6000)], "doc_id long, text string")
    rows = sharding.shard_rows(docs, shards=10).collect()
    check(rows, 6000, 10)
    assert all(len(s) == 1 for s in held_by(rows, group).values())


def test_groups_beyond_a_shard_fall_into_the_fewest(spark):
    group = lambda i: "large" if i < 2500 else i // 700 if i < 7000 else i
    docs = spark.createDataFrame([(i, str(group(i))) for i in range(10000)], "doc_id long, text string")
    rows = sharding.shard_rows(docs, shards=10).collect()
    check(rows, 10000, 10)
    found = held_by(rows, group)
    assert len(found.pop("large")) == 3 and all(len(s) == 1 for s in found.values())


def test_unsettled_raises(spark):
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(20)], "a long, b long, w double")
    with pytest.raises(RuntimeError, match="settle"):
        sharding.propagate(edges, rounds=2)
