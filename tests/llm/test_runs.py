"""Periodic runs of words against a plain search over all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from geoscore.llm import runs
from geoscore.llm.queries import op11_runs

from .conftest import ODD


def plain(w):
    """Runs by trying every period at every place."""
    found, n = [], len(w)
    for q in range(1, n // runs.TIMES + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(runs.LEAST, runs.TIMES * q):
                smaller = any(all(w[x] == w[x + d] for x in range(i, i + size - d)) for d in range(1, q))
                found += [] if smaller else [(i, size, q)]
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(text):
    w = (text or "").encode().split()
    found = plain(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (len(found), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def changed(doc_id, text):
    """The stretch of words that the query plants, by its rule."""
    w = [x.decode() for x in (text or "").encode().split()]
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not w:
        return text
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return " ".join(w[i] if i < a else w[a + (i - a) % p] for i in range(n))


FIELDS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def repetitive(rng):
    w = [rng.choice("abcde"[: rng.choice([1, 2, 2, 3, 5])]) for _ in range(rng.randint(0, 50))]
    block = [rng.choice("abcd") for _ in range(rng.randint(1, 12))]
    cut = rng.randint(0, len(w))
    return w[:cut] + block * rng.randint(0, 7) + block[: rng.randint(0, len(block))] + w[cut:]


def test_runs_of_sequences():
    rng = random.Random(3)
    for _ in range(1500):
        w = repetitive(rng)
        got = runs.find_runs(np.array([ord(x) for x in w], np.int64))
        assert list(zip(*(x.tolist() for x in got))) == plain(w)


def test_nested_and_long_runs():
    inner = ["a"] * 8 + ["b"]
    for w in (inner * 5, (inner * 4 + ["c"]) * 4, list("ab") * 700 + ["c"] * 900, [str(i) for i in range(300)] * 4):
        got = runs.find_runs(np.array([hash(x) & 0xFFFF for x in w], np.int64))
        assert list(zip(*(x.tolist() for x in got))) == plain([hash(x) & 0xFFFF for x in w])


def test_documents(documents):
    """Whole rows; equal words of neighbouring documents make no run; letter case counts."""
    rng = random.Random(4)
    texts = [*ODD, "a a a", "a a a a a", "A a A a A a A a", "x\ty\x0bx\x0cy\rx\ny x y x y", "\xa0a\xa0a"]
    texts += [rng.choice([" ", "\n"]).join(repetitive(rng)) for _ in range(200)]
    rows = runs.digests(runs.periodic_runs(documents(texts))).collect()
    got = {r.doc_id: tuple(r[f] for f in FIELDS) for r in rows}
    assert got == {i: plain_row(t) for i, t in enumerate(texts)}
    found = {r.doc_id: r for r in runs.periodic_runs(documents(texts)).collect()}
    assert all(found[i].n_words == len((t or "").encode().split()) for i, t in enumerate(texts))
    assert runs.digests(runs.periodic_runs(documents([]))).count() == 0


def test_the_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r[f] for f in FIELDS) for r in op11_runs(spark, sf_dir).collect()}
    short = [d for d in docs if len((d.text or "").split()) < 400]
    assert len(got) == len(docs) and len(short) > 50
    assert any(changed(d.doc_id, d.text) != d.text for d in short)
    for d in short:
        assert got[d.doc_id] == plain_row(changed(d.doc_id, d.text))


@pytest.mark.parametrize("rows", [[(None, "a b a b a b a b"), (7, None)], []])
def test_planting_odd_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = docs.select("doc_id", runs.planted().alias("text")).collect()
    assert [tuple(r) for r in got] == rows
