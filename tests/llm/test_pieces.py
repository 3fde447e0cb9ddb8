"""SentencePiece encoding against the library."""

import random

import public_tokenizers
import pytest
import sentencepiece

from geoscore.llm import pieces

from .conftest import ODD

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def library(texts):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids = [model.encode(t or "", add_eos=True) for t in texts]
    return [(i, model.decode(i)) for i in ids]


def test_odd_texts_and_ids(spark, odd):
    got = {r.doc_id: (r.ids, r.decoded) for r in pieces.encode_decode(odd, MODEL).collect()}
    assert [got[i] for i in range(len(ODD))] == library(ODD)


def test_random_texts(spark, documents):
    rng = random.Random(4)
    letters = "ab \n\x00▁é👩<>0x.,"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(2000)]
    got = {r.doc_id: (r.ids, r.decoded) for r in pieces.encode_decode(documents(texts), MODEL).collect()}
    assert [got[i] for i in range(len(texts))] == library(texts)


def test_in_step_equals_heap():
    vocabulary = pieces.Vocabulary(MODEL)
    words = ["▁internationalisation", "▁hello", "▁ab", "▁zzzzzz", "▁naïve", "▁👩x", "▁don't"]
    for word in words:
        assert vocabulary.merge_in_step([word]) == [vocabulary.merge(word)]


def test_a_difference_fails(monkeypatch):
    vocabulary = pieces.Vocabulary(MODEL)
    with pytest.raises(ValueError, match="in the library"):
        vocabulary.check({"▁hello": [5]}, vocabulary.library())


def test_empty_table(documents):
    assert pieces.digests(pieces.encode_decode(documents([]), MODEL)).count() == 0
