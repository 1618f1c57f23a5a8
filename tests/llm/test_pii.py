import re

import numpy as np

from lettermill.llm import pii


def slow_base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(0, m.start(), m.end()) for m in pii.EMAIL.finditer(text)]
    out += [(1, m.start(), m.end()) for m in pii.IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(2, m.start(), m.end()) for m in pii.CARD.finditer(text) if 13 <= len(d := digits(m.group())) <= 19 and pii.luhn(d)]
    return out + [(3, m.start(), m.end()) for m in pii.PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]


TRICKY = ["a@b.c@d.e", "x@y é@z.com a.b+c@d-e.f.g.", "1.2.3.4.5.6.7.8 256.1.1.1 01.2.3.4", "0000000000000000000000001.0.0.0255 1.2.3.0256", "4111 1111 1111 1111-1 4111111111111111", "+1 (487) 555-7209 + 12 +123456789", "@@a@b.c..d", "日本 4111-1111-1111-1111 x@日.jp", ""]


def test_base_rules_whole_text(spark, small):
    texts = TRICKY + [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect() if len(r.text) < 4000]
    assert all(pii.base_spans(t) == slow_base(t) for t in texts)


def trained():
    rng = np.random.default_rng(1)
    words = "the and lamp tree river stone over into quick water".split()
    texts = []
    for i in range(150):
        w = [str(rng.choice(words)) for _ in range(20)]
        n = "".join(map(str, rng.integers(0, 10, 10)))
        w.insert(10, [f"{n[:2]}@mail{n[2]}.example.com", f"{rng.integers(1, 255)}.{rng.integers(1, 255)}.{rng.integers(1, 255)}.{rng.integers(1, 255)}", f"+1 ({n[:3]}) {n[3:6]}-{n[6:]}", "4111111111111111"][i % 4])
        texts.append(" ".join(w))
    windows = sorted({e for t in texts for e in pii.examples(t, 64)})
    return pii.train(windows, steps=150), texts


def test_network_finds_and_adds():
    model, texts = trained()
    found = model.spans(texts[:60])
    base = [pii.base_spans(t) for t in texts[:60]]
    assert sum(s in {f[:3] for f in fs} for b, fs in zip(base, found) for s in b) >= 0.7 * sum(map(len, base))
    # Alone or among others, and with other windows beside them, texts have the same spans.
    model.at_once = 7
    long = "water " * 400 + texts[2] + " water" * 400
    assert model.spans([long, texts[0]])[1] == model.spans([texts[0]])[0] == found[0]
    for bs, every in pii.find_spans(texts, model):
        assert set(bs) <= set(every)


def test_gradients():
    rng = np.random.default_rng(0)
    e, t = rng.standard_normal((5, pii.TAGS, 2)), rng.standard_normal((pii.TAGS, pii.TAGS))
    y = np.array([[0, 1], [1, 2], [2, 0], [0, 0], [0, 0]])
    loss, de, da = pii.crf_loss(e, t, y)
    for at in [(1, 1, 0), (3, 0, 1)]:
        moved = e.copy()
        moved[at] += 1e-3
        assert abs((pii.crf_loss(moved, t, y)[0] - loss) / 1e-3 - de[at]) < 5e-3
    moved = t.copy()
    moved[0, 1] += 1e-3
    assert abs((pii.crf_loss(e, moved, y)[0] - loss) / 1e-3 - da[0, 1]) < 5e-3


def slow_decode(e, trans):
    """All tags against all tags."""
    a = trans + pii.allowed()
    score = e[0].copy()
    score[2::2] = pii.NEVER
    back = []
    for t in range(1, len(e)):
        each = score[:, None, :] + a[:, :, None]
        back.append(each.argmax(axis=0))
        score = each.max(axis=0) + e[t]
    score[1::2] = pii.NEVER
    tags = [score.argmax(axis=0)]
    for b in reversed(back):
        tags.append(b[tags[-1], np.arange(e.shape[2])])
    return np.array(tags[::-1])


def test_decoding_as_by_all_transitions():
    rng = np.random.default_rng(8)
    model = pii.Tagger.fresh(4, 3)
    model.trans = rng.standard_normal((pii.TAGS, pii.TAGS)).astype(np.float32)
    e = rng.standard_normal((15, pii.TAGS, 500)).astype(np.float32)
    assert (model.decode(e) == slow_decode(e, model.trans)).all()


def test_odd_rows(odd, none_at_all):
    model = pii.fit(odd, steps=3)
    got = pii.scan(odd, model, id_cols=["doc_id"])
    assert got.count() == odd.count()
    one = got.filter("doc_id = 8").first()
    assert one.n_email == 1 and "email:5:22" in one.spans
    assert pii.fit(none_at_all) is None
    assert pii.scan(none_at_all, None, id_cols=["doc_id"]).count() == 0
    masked = odd.select("doc_id", pii.masker(None)("text").alias("text")).filter("doc_id = 8 OR doc_id = 0").orderBy("doc_id").collect()
    assert masked[0].text is None and masked[1].text == "mail [EMAIL] now"
