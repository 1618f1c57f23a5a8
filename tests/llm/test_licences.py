import random

from lettermill.llm import licences


def best(text, template):
    words, want = licences.template_words(text or ""), licences.template_words(template)
    need, n = set(licences.shingles_of(want)), len(want)
    step = max(1, n // 8)
    top = 0.0
    for i in range(max(1, len(words) - n + 1)):
        reach = words[max(0, i - step) : i + n + step]
        size = min(licences.SHINGLE, n)
        have = {" ".join(reach[j : j + size]) for j in range(max(1, len(reach) - size + 1))}
        top = max(top, len(need & have) / len(need))
    return top


def test_as_by_brute_force(spark):
    rng = random.Random(3)
    filler = "the and of water over lamp tree quick stone river under sky apple version source use".split()
    rows = []
    for i in range(60):
        words = [rng.choice(filler) for _ in range(rng.randrange(0, 120))]
        if i % 2:
            t = rng.choice(licences.TEMPLATES)[1].split()
            if i % 4 == 1 and len(t) > 20:
                t[rng.randrange(len(t))] = "changed"
            at = rng.randrange(len(words) + 1)
            words[at:at] = t
        rows.append((i, " ".join(words)))
    rows += [(100, None), (101, ""), (102, "ALL rights -- reserved!"), (102, "licensed under cc by nc 4 0")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.licence) for r in licences.scan(df).collect()}
    sure = {(i, name) for i, text in rows for name, t in licences.TEMPLATES if best(text, t) == 1.0}
    near = {(i, name) for i, text in rows for name, t in licences.TEMPLATES if best(text, t) >= 0.8}
    assert sure <= got <= near
    assert len(got & near) >= 0.95 * len(near)


def test_anchors_hit_every_shingle():
    marks = set(licences.anchors(licences.TEMPLATES))
    assert all(marks & set(s.split()) for _, t in licences.TEMPLATES for s in licences.shingles_of(licences.template_words(t)))


def test_odd_rows(odd, none_at_all):
    assert licences.scan(odd).count() == 0
    assert licences.scan(none_at_all).count() == 0
    assert licences.scan(odd, templates=[]).count() == 0


def test_rows_that_share_an_id(spark):
    """A full notice counts beside near misses under its id, in either order, and so it does under a null id."""
    whole = dict(enumerate(t for _, t in licences.TEMPLATES))[1]
    words = whole.split()
    miss = " ".join([*words[:14], "other", "words", "stand", "in", "this", "place", *words[20:]])
    for own in (7, None):
        rows = [(own, miss)] * 6 + [(own, whole)]
        for order in (rows, rows[::-1]):
            got = [(r.doc_id, r.licence, r.containment) for r in licences.scan(spark.createDataFrame(order, "doc_id long, text string")).collect()]
            assert (own, "Apache-2.0", 1.0) in got
