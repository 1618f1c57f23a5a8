import hashlib
from collections import Counter

import duckdb
import pandas as pd
import pytest

from lettermill.llm import language, mixing, pii, simhash
from tests.llm.test_bpe import reference
from tests.llm.test_language import slow_model, slow_predict
from tests.llm.test_pii import slow_base
from tests.llm.test_simhash import slow_components, slow_print

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_take_effect(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    one = corpus_pipeline.identify_languages(spark, docs, small)
    assert one.columns == docs.columns
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in docs.collect() if language.words_of(r.text)}
    two = corpus_pipeline.drop_near_duplicates(spark, one, small)
    kept = {r.doc_id for r in two.collect()}
    assert kept == {r.component_id for r in simhash.near_duplicates(one).collect()}
    three = corpus_pipeline.mask_personal_data(spark, two, small)
    masked = three.collect()
    assert {r.doc_id for r in masked} == kept
    assert not any(pii.base_spans(r.text) for r in masked) and all(r.n_chars == len(r.text) for r in masked)
    four = corpus_pipeline.mix_sources(spark, three, small)
    assert four.columns == docs.columns
    words = sum(len(r.text.encode().split()) for r in masked)
    assert 0.9 * 1.5 * words <= sum(len(r.text.encode().split()) for r in four.collect()) <= 1.5 * words
    five = corpus_pipeline.encode_tokens(spark, four, small)
    assert five.count() == four.count() and all(r.n_tokens == len(r.ids) for r in five.collect())


def test_empty_and_odd(spark, odd, none_at_all):
    for docs in (odd, none_at_all):
        rows = docs
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, "")
        rows.collect()


def slow_language(rows):
    """rows: dicts with the columns of documents. Fewer than the sample's bound, so all are learned from."""
    counts = Counter((r["lang"], w) for r in rows if r["lang"] is not None for w in language.words_of(r["text"]))
    model = slow_model([(lang, w, n) for (lang, w), n in counts.items()])
    kept = [r for r in rows if language.words_of(r["text"])]
    return [r | {"lang": r["lang"] or slow_predict(r["text"], model)[0]} for r in kept]


def slow_near_duplicates(rows):
    components = slow_components([(r["doc_id"], slow_print(r["text"])) for r in rows])
    return [r for r, c in zip(rows, components) if r["doc_id"] == c]


def slow_masking(rows, model):
    """The rules are found again; what the network adds is taken from it, as its weights are trained."""
    out = []
    for r in rows:
        text, base = r["text"], slow_base(r["text"])
        (_, every), = pii.find_spans([text], model)
        assert set(base) <= set(every)
        for kind, start, end in sorted(every, key=lambda s: -s[1]):
            text = text[:start] + f"[{pii.KINDS[kind].upper()}]" + text[end:]
        out.append(r | {"text": text})
    return out


def slow_mix(rows):
    c = duckdb.connect()
    c.register("documents", pd.DataFrame(rows).astype({"doc_id": "int64"}))
    times = {i: taken // size for i, size, taken in c.execute(f"SELECT doc_id, size, taken FROM ({mixing.SQL})").fetchall()}
    return [r for r in rows for _ in range(times[r["doc_id"]])]


def slow_tokens(rows):
    encoding, out = reference(), []
    for r in rows:
        ids = encoding.encode_ordinary(r["text"])
        said = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        out.append((r["doc_id"], r["lang"], r["source"], len(ids), tuple(ids), said, hashlib.sha256(r["text"].encode()).hexdigest()))
    return out


def test_run_as_by_brute_force(spark, small, tmp_path):
    """run() over the small table, with copies, near copies, personal data, and rows without text or language planted."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    given = [r.asDict() for r in docs.collect()]
    first = max(r["doc_id"] for r in given) + 1
    long = [r for r in given if len((r["text"] or "").split()) > 150][:12]
    planted = [r | {"text": r["text"] + " end"} for r in long[:4]] + [dict(r) for r in long[4:8]] + [r | {"lang": None} for r in long[8:]]
    planted[-4:] = [r | {"text": " ".join(r["text"].split()[::-1])} for r in planted[-4:]]
    planted += [long[0] | {"text": t} for t in (None, "", "12 34 !", "mail a.b@c.example.com or call +1 (487) 555-7209 from 10.1.2.3")]
    planted += [long[0] | {"text": "card 4111 1111 1111 1111 is not mine", "lang": None, "source": None}]
    rows = given + [r | {"doc_id": first + i} for i, r in enumerate(planted)]
    spark.createDataFrame([tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in rows], docs.schema).write.parquet(f"{tmp_path}/documents.parquet")

    named = slow_language(rows)
    kept = slow_near_duplicates(named)
    assert len(rows) > len(named) > len(kept)
    model = pii.fit(spark.createDataFrame([(r["doc_id"], r["text"]) for r in kept], "doc_id long, text string"))
    masked = slow_masking(kept, model)
    assert any("[EMAIL]" in r["text"] and "[PHONE]" in r["text"] and "[IP]" in r["text"] for r in masked)
    want = slow_tokens(slow_mix(masked))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    found = [(r.doc_id, r.lang, r.source, r.n_tokens, tuple(r.ids), r.ids_sha256, r.decoded_sha256) for r in got]
    assert Counter(found) == Counter(want) and len(want) > 0
