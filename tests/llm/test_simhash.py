import numpy as np
import xxhash
from pyspark.sql import functions as F

from lettermill.llm import simhash


def slow_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows):
    """rows: (id, fingerprint). Smallest id by row, by comparing all."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (own, _) in enumerate(rows):
        if own is not None:
            least[find(i)] = min(own, least.get(find(i), own))
    return [least.get(find(i)) for i in range(len(rows))]


def test_prints(odd):
    texts = ["a b c d", "é" * 40 + " x " + "y" * 90, "\x00 \x1c b c", "A B\x0bC d e f g", None, "", " ", "w " * 999]
    assert simhash.text_fingerprints(texts).tolist() == [slow_print(t) for t in texts]
    assert simhash.text_fingerprints(texts, at_once=8).tolist() == [slow_print(t) for t in texts]


def test_components_as_by_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, slow_print(r.text)) for r in docs.select("doc_id", "text").collect()]
    want = dict(zip((r[0] for r in rows), slow_components(rows)))
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == dict(rows)


def test_long_lists_give_the_same_components(spark):
    rng = np.random.default_rng(4)
    base = [int(x) for x in rng.integers(0, 2**63, 6)]
    fps = set(base)
    for b in base[:3]:
        for _ in range(120):
            x = b
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    rows = sorted((i, f) for i, f in enumerate(sorted(fps)))
    want = slow_components(rows)
    signed = [(f - (1 << 64) if f >> 63 else f,) for _, f in rows]
    df = spark.createDataFrame(signed, "fp long")
    for limit in (2, 1024):
        links = simhash.links(df, long_list=limit).df
        assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 3 for r in links.collect())
        roots = {r.node: r.root for r in simhash.components(links).df.collect()}
        groups = {}
        for (i, f), (s,), w in zip(rows, signed, want):
            groups.setdefault(roots.get(s, s), set()).add(w)
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want))


def test_tally_of_shared_bytes(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 256, (6, 8))
    rows = {tuple(x) for x in base}
    for b in base:
        for _ in range(30):
            x = b.copy()
            at = rng.choice(8, rng.integers(1, 7), replace=False)
            x[at] = rng.integers(0, 256, len(at))
            rows.add(tuple(x))
    fps = sorted(sum(int(v) << 8 * i for i, v in enumerate(x)) for x in rows)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    share = lambda a, b: sum((a ^ b) >> 8 * i & 255 == 0 for i in range(8))
    want = {(a, b): share(a, b) for a in signed for b in signed if a < b}
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    posted = df.select("fp", F.explode(F.array(*simhash.posting_keys())).alias("k")).select("fp", "k.part", "k.bytes")
    got = {(r.a, r.b): r.shared for r in simhash.tallied(posted).collect()}
    assert all(want[p] == n for p, n in got.items())
    # Every pair with the guaranteed 5 meets in a list; some that meet have fewer and are not retained.
    assert {p for p, n in want.items() if n >= 5} <= set(got) and min(got.values()) == 3
    # Some of those retained differ in too many bits and go when verified.
    links = {(r.a, r.b) for r in simhash.links(df).df.collect()}
    assert links < {p for p, n in got.items() if n >= 5}
    assert links == {p for p in want if ((p[0] ^ p[1]) & (2**64 - 1)).bit_count() <= 3}


def test_hot_groups_without_skew_handling(spark):
    """A third of all rows are copies of one text and a third near copies of another; Spark's own handling is off."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, "one text that very many copy") for i in range(1500)]
    rows += [(i, " ".join([*words[:150], words[i % 300], *words[150:]])) for i in range(1500, 3000)]
    rows += [(i, f"own{i} text{i * 7} of{i * 11} row{i * 13}") for i in range(3000, 4500)]
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = simhash.near_duplicates(docs).collect()
        kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.skewJoin.enabled")
    prints = [(r.doc_id, int(r.fingerprint, 16)) for r in sorted(got)]
    first = {}
    for own, f in prints:
        first.setdefault(f, own)
    firsts = sorted((own, f) for f, own in first.items())
    roots = dict(zip((f for _, f in firsts), slow_components(firsts)))
    assert {r.doc_id: r.component_id for r in got} == {own: roots[f] for own, f in prints}
    assert kept == {roots[f] for _, f in prints}


def test_names_that_clash(spark):
    names = "doc, fp, hash, row, _simhash_fp, node, root, least".split(", ")
    rows = [(i, text, *([i] * len(names)), {"k": i}) for i, text in enumerate(["a b c d", "a b c d", "other words stand here"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} long" for n in names) + ", extra map<string,long>")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]


def test_ties_of_one_id(spark):
    rows = [(7, "a b c d", i % 2) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    one, two = simhash.keep_one(docs).collect(), simhash.keep_one(docs.repartition(3)).collect()
    assert len(one) == 1 and one == two


def test_odd_rows(odd, none_at_all):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert {r.component_id for r in got if r.doc_id in (0, 1, 2)} == {0}
    assert simhash.near_duplicates(none_at_all).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 0 in ids and 1 not in ids and None in ids
    assert simhash.keep_one(none_at_all).count() == 0
