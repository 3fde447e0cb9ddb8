"""Alignment of two tokenizers against sets of offsets and plain loops."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from geoscore.llm import align

from .conftest import ODD

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")
FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
TEXTS = [
    "  a  b", "▁x", "日本語 text é", "=" * 700, "<|endoftext|> <s> </s> <0x41>", "a\x00b", "\n\n\t x", "é" * 50,
    " " * 300, "ab" * 900, "don't won't I'll", "ŵ ɐ ɑ ʼn 𝔘 ½ ²", "    　.",
]


def plain(texts):
    """Each text's groups of ids by common ends, then counts of documents per pair."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters, documents = align.byte_letters(), []
    for t in texts:
        groups = []
        ids = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ((), ())
        spelt = (
            [bytes(letters[c] for c in a.id_to_token(i)) for i in ids[0]],
            [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]],
        )
        if t and all(b"".join(s) == (" " + t).encode() for s in spelt):
            ends = [np.cumsum([len(x) for x in s]).tolist() for s in spelt]
            for end in sorted(set(ends[0]) & set(ends[1])):
                begin = groups[-1][2] if groups else 0
                both = [[i for i, e in zip(x, es) if begin < e <= end] for x, es in zip(ids, ends)]
                groups.append((*both, end))
        documents.append([g[:2] for g in groups])
    pairs = [[(x, y) for ga, gb in d for x in ga for y in gb] for d in documents]
    count = Counter(p for each in pairs for p in set(each))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for d, links in zip(documents, pairs):
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in d)
        out.append(
            (
                sum(len(ga) for ga, _ in d),
                sum(len(gb) for _, gb in d),
                len(d),
                len(links),
                sum(count[p] == best[p[0]] for p in links),
                sum(count[p] for p in links),
                hashlib.sha256(text.encode()).hexdigest() if d else "",
            )
        )
    return out


def aligned(docs):
    rows = align.digests(align.align(docs, A, B, public_tokenizers.PATTERN)).collect()
    return {r.doc_id: tuple(r[f] for f in FIELDS) for r in rows}


def test_against_plain_loops(spark, documents, monkeypatch):
    """Small lanes, batches and blocks, so that each kind of seam is met."""
    for name, value in {"LANE_BYTES": 40, "BATCH_BYTES": 2000, "BLOCK_BYTES": 4000, "TOGETHER": 300}.items():
        monkeypatch.setattr(align, name, value)
    rng = random.Random(8)
    letters = "ab cde\n\té▁<=>0.,'👩日ɐ"
    texts = [*ODD, *TEXTS, *("".join(rng.choice(letters) for _ in range(rng.randint(1, 300))) for _ in range(150))]
    texts += ["the same sentence, in several documents."] * 3
    got = aligned(documents(texts).repartition(3, "doc_id"))
    expected = plain(texts)
    for i, t in enumerate(texts):
        assert got[i] == expected[i], t
    assert sum(e[0] == 0 for e in expected) >= 3  # null, empty, and what sentencepiece rewrites
    monkeypatch.setattr(align, "SENT", 0)  # the other plan
    assert aligned(documents(texts).repartition(3, "doc_id")) == got


def test_real_outputs(spark, documents):
    found = align.align(documents(["a long word: internationalisation"]), A, B, public_tokenizers.PATTERN)
    row = align.expanded(found).first()
    assert row.a_cuts[-1] == len(row.a_ids) and row.b_cuts[-1] == len(row.b_ids)
    assert len(row.a_cuts) == len(row.b_cuts) and row.n_links >= len(row.a_ids)


def test_repeated_and_null_ids(spark):
    rows = [(None, "a b"), (None, "a b"), (2**60 + 1, "a b c"), (2**60 + 1, None)]
    got = align.digests(align.align(spark.createDataFrame(rows, "doc_id bigint, text string"), A, B, public_tokenizers.PATTERN))
    found = sorted((r.doc_id or 0, r.n_a, r.count_sum) for r in got.collect())
    assert found == [(0, 2, 6), (0, 2, 6), (2**60 + 1, 0, 0), (2**60 + 1, 3, 7)]


def test_libraries_agree_on_settled_characters():
    tokenizer = align.ByteTokenizer(A, public_tokenizers.PATTERN)
    assert tokenizer.fast is not None
    rng = random.Random(9)
    chars = [chr(c) for c in range(ord(align.SETTLED))]
    texts = ["".join(rng.choice(chars) for _ in range(60)) for _ in range(800)]
    texts += ["".join(f"{c}{d} " for c in chars[:256]) for d in "a1. \n'"]
    theirs = [e.ids for e in tokenizer.library.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert tokenizer.encode(texts) == theirs


def test_long_groups_meet_once_per_distinct_pair():
    """A group of many equal tokens on both sides makes few pairs, with all their numbers."""
    a, b = np.full(5000, 3, np.int32), np.array([7] * 2999 + [8], np.int32)
    found = [(g.tolist(), k.tolist(), n.tolist()) for g, k, n in align.links(a, b, np.array([[5000, 3000]]))]
    rows = [r for r in found if r[0]]
    assert rows == [([0, 0], [3 << align.ID_BITS | 7, 3 << align.ID_BITS | 8], [5000 * 2999, 5000])]


def test_empty_table(documents):
    assert aligned(documents([])) == {}
