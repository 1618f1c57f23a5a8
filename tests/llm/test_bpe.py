import hashlib
import random

import public_tokenizers
import tiktoken

from lettermill.llm import bpe


def reference():
    path, _ = bpe.default_vocabulary()
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(path))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_the_library_and_back():
    own, other, rng = bpe.ByteBpe(*bpe.default_vocabulary()), reference(), random.Random(5)
    letters = "abc 'sTé日\n\t\x0b\x1c\x85 　​0 12,.\U0001f600\x00"
    texts = ["", "a" * 5000, "  x  ", "don't we'll", *("".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(1500))]
    for t in texts:
        ids = own.encode(t)
        assert ids == other.encode_ordinary(t), ascii(t)
        assert own.decode(ids) == t.encode()


def test_small_cache_changes_nothing():
    small, other = bpe.ByteBpe(*bpe.default_vocabulary(), cache_size=3), reference()
    for t in ("the cat sat on the mat", "a b c d e f g", "the cat"):
        assert small.encode(t) == other.encode_ordinary(t)


def test_documents(spark, odd, none_at_all):
    out = {r.doc_id: r for r in bpe.encode_documents(odd.filter("doc_id IS NOT NULL"), id_cols=["doc_id"]).collect()}
    other = reference()
    for r in odd.filter("doc_id IS NOT NULL").collect():
        ids = other.encode_ordinary(r.text or "")
        assert out[r.doc_id].n_tokens == len(ids)
        assert out[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert out[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.encode_documents(odd, id_cols=["doc_id"]).count() == odd.count()
    assert bpe.encode_documents(none_at_all, id_cols=["doc_id"]).count() == 0
