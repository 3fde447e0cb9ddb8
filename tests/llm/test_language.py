"""Language identification against a plain kernel in dense arithmetic, and by held-out accuracy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoscore.llm import language

from .conftest import ODD

SYLLABLES = {"aa": "ka to mi re su".split(), "bb": "stra chen ung hei lo".split(), "cc": "ção ñe él oux ie".split()}


def prose(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def told(spark):
    rng = random.Random(5)
    rows = [(i, prose(lang, rng.randint(1, 60), rng), lang) for i, lang in enumerate(list(SYLLABLES) * 60)]
    rows += [(1000, "who knows", None), (1001, None, "dd"), (1002, "123 !", "ee")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def plain_set(text):
    """The distinct n-grams of a text, as bytes."""
    folded = "".join(c if c.isascii() and c.isalpha() or not c.isascii() else " " for c in text).lower().encode()
    t = b" " + b" ".join(folded.split()) + b" "
    t = b" " if not folded.split() else t
    return {t[i : i + n] for n in language.LENGTHS for i in range(len(t) - n + 1)}


def test_presence_is_of_whole_ngrams():
    texts = ["aé b", "abc", "abc", "x", "123", "Abc!", "ab c"]
    rows = language.presence([t.encode() for t in texts])
    alone = np.concatenate([language.presence([t.encode()]) for t in texts])
    assert (rows == alone).all()
    for t, row in zip(texts, rows):
        assert 0 < row.sum() <= len(plain_set(t))
    assert row_equal(rows[1], rows[2]) and row_equal(rows[1], rows[5]) and not row_equal(rows[1], rows[6])


def row_equal(a, b):
    return bool((a == b).all())


def test_predictions_are_the_ridge_solution(spark, told):
    """Nyström features and ridge regression written out, without sums over tasks."""
    s = language.Settings(per_language=30, landmarks=20, tasks=3)
    model = language.fit(told, s)
    assert model.langs == ["aa", "bb", "cc"]
    rows = told.filter("lang is not null").select("text", "lang", F.xxhash64("doc_id", "text").alias("h")).collect()
    rows = [r for r in rows if r.text and any(c.isalpha() for c in r.text)]
    low = {lang: sorted((r for r in rows if r.lang == lang), key=lambda r: r.h % (1 << 30))[:30] for lang in model.langs}
    marks = [low[lang][k] for k in range(7) for lang in model.langs][:20]
    bits = [language.presence([r.text.encode()])[0] for r in marks]
    kernel = lambda x, y: (x & y).sum() / np.sqrt(x.sum() * y.sum())
    own = np.array([[kernel(x, y) for y in bits] for x in bits])
    values, vectors = np.linalg.eigh(own)
    good = values > values.max() * 1e-6
    root = vectors[:, good] / np.sqrt(values[good])

    def features(text):
        x = language.presence([text.encode()])[0]
        return np.r_[np.array([kernel(x, y) for y in bits]) @ root, 1.0]

    sample = [r for lang in model.langs for r in low[lang]]
    x = np.array([features(r.text) for r in sample])
    y = np.array([[1.0 if r.lang == lang else -1.0 for lang in model.langs] for r in sample])
    penalty = np.eye(x.shape[1]) * s.ridge * len(x)
    penalty[-1, -1] = 0
    weights = np.linalg.solve(x.T @ x + penalty, x.T @ y)
    got = {r.doc_id: r for r in language.predict(told, model).collect()}
    for r in told.collect():
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        f = features(r.text) @ weights
        odds = np.exp(s.sharpness * (f - f.max()))
        assert got[r.doc_id].lang_pred == model.langs[int(f.argmax())]
        assert abs(got[r.doc_id].score - 1 / odds.sum()) < 1e-3


def test_held_out_accuracy(spark, told):
    held = language.held_out()
    model = language.fit(told.filter(~held))
    got = language.predict(told.filter(held & F.col("lang").isin(*SYLLABLES)), model).join(told, "doc_id").collect()
    assert len(got) > 40 and sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)


def test_nothing_or_one_language_learned(spark, odd, documents):
    none = language.fit(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in language.predict(odd, none).collect()} == {("und", 0.0)}
    one = language.fit(odd)
    got = language.predictions(language.predict(odd, one)).collect()
    for r in got:
        letter = any(c.isalpha() for c in ODD[r.doc_id] or "")
        assert (r.lang_pred, r.score) == (("en", 1.0) if letter else ("und", 0.0))
    assert len(got) == len(ODD)
    assert language.predict(documents([]), language.fit(documents([]))).count() == 0


def test_rows_that_repeat_teach_once(spark):
    """A language whose rows are all alike is learned, and from one row."""
    rows = [(None, "lo re mi", "xx")] * 3000 + [(i, f"stra chen {'u' * i}", "yy") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(5)
    model = language.fit(docs, language.Settings(per_language=8, landmarks=6))
    assert model.langs == ["xx", "yy"] and model.base.shape[1] == 6
    assert {r.lang_pred for r in language.predict(docs.filter("lang = 'xx'"), model).distinct().collect()} == {"xx"}
