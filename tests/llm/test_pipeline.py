"""The corpus pipeline: every stage against brute force, and the whole."""

import hashlib
import random

import pytest
import sentencepiece

import corpus_pipeline
from geoscore.llm import decontaminate, personal, toxicity
from geoscore.llm.queries import tokenizer

from .conftest import ODD
from .test_duplicates import brute_components, edited, prose

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def documents_of(spark):
    def make(texts):
        rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, COLUMNS)

    return make


@pytest.fixture(scope="module")
def whole(spark, sf_dir):
    """Every stage's rows as stored, and the last one's, for the smallest tables."""
    stored = {}
    with pytest.MonkeyPatch.context() as patch:
        from geoscore.sources import storage

        def keep(df, name, *args):
            stored[name.removeprefix("pipeline-")] = storage.store(df, name, *args)
            return stored[name.removeprefix("pipeline-")]

        patch.setattr(corpus_pipeline, "store", keep)
        out = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    return {name: df.collect() for name, df in stored.items()}, out


def texts_by_id(rows):
    return {r.doc_id: r.text for r in rows}


def hashed(library, text):
    ids = [*library.encode(text or ""), library.eos_id()]
    decoded = library.decode(ids)
    return (
        len(ids),
        hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
        hashlib.sha256(decoded.encode()).hexdigest(),
    )


def test_near_duplicates_keep_the_smallest_id(spark, sf_dir, documents_of):
    rng = random.Random(5)
    texts = list(ODD)
    for _ in range(5):
        base = prose(rng.randint(20, 120), rng)
        texts += [base, *(edited(base, rng.randint(0, 6), rng) for _ in range(6))]
    docs = documents_of(texts)
    labels, _ = brute_components(texts, 5)
    left = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [i for i, c in enumerate(labels) if i == c]
    # Rows without an id stay; of rows that repeat one, the smallest text does.
    odd_ids = spark.createDataFrame([(None, "p q r", "en", "s", 5), (1, "b b", "en", "s", 3), (1, "a a", "en", "s", 3)], COLUMNS)
    rows = corpus_pipeline.drop_near_duplicates(spark, odd_ids, sf_dir).collect()
    assert sorted((r.doc_id or 0, r.text) for r in rows) == [(0, "p q r"), (1, "a a")]


def test_contaminated_documents_go(spark, sf_dir, documents_of):
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").limit(5).collect()]
    rng = random.Random(6)
    leaking = [f"{prose(40, rng)} {item} {prose(30, rng)}" for item in items]
    texts = [*ODD, *leaking, *(prose(90, rng) for _ in range(6))]
    left = corpus_pipeline.drop_contaminated(spark, documents_of(texts), sf_dir).collect()
    gone = range(len(ODD), len(ODD) + len(leaking))
    assert sorted(r.doc_id for r in left) == [i for i in range(len(texts)) if i not in gone]


def test_personal_data_is_masked(spark, sf_dir, documents_of):
    texts = [*ODD, "mail ann.b@mail.example.org or call +49 (30) 1234-5678 now", "host 10.1.2.3 card 4111 1111 1111 1111."]
    rows = corpus_pipeline.mask_personal_data(spark, documents_of(texts), sf_dir).collect()
    got = texts_by_id(rows)
    assert got == {i: t if t is None else personal.replaced(t, personal.seeds(t)) for i, t in enumerate(texts)}
    assert "@" not in got[len(ODD)] and "1111" not in got[len(ODD) + 1]
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)


def test_encoding_is_the_librarys(spark, sf_dir, documents_of):
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    rows = corpus_pipeline.encode(spark, documents_of(ODD), sf_dir).collect()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows}
    assert got == {i: hashed(library, t) for i, t in enumerate(ODD)}


def test_documents_at_their_languages_cut_go(spark, sf_dir, whole):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages, _ = whole
    left = texts_by_id(stages["toxicity"])
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert set(left) == {i for i in score if score[i] < model.cuts.get(lang[i], toxicity.CUT)}


@pytest.mark.xfail(reason="with the 87 labels of the smallest table 49 of 76 clean documents stay", strict=True)
def test_clean_documents_stay(spark, sf_dir, whole):
    left = texts_by_id(whole[0]["toxicity"])
    clean = [r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if not r.toxic]
    assert sum(i in left for i in clean) >= 0.9 * len(clean)


def test_the_whole_follows_its_stages(spark, sf_dir, whole):
    stages, out = whole
    assert [name for name, _ in corpus_pipeline.STAGES[:-1]] == list(stages)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert all(set(rows[0].asDict()) == set(docs.columns) for rows in stages.values())
    first = stages["toxicity"]
    ids = [r.doc_id for r in sorted(first, key=lambda r: r.doc_id)]
    labels, _ = brute_components([texts_by_id(first)[i] for i in ids], 5)
    assert set(texts_by_id(stages["near_duplicates"])) == {i for n, i in enumerate(ids) if labels[n] == n}
    unique = spark.createDataFrame(stages["near_duplicates"], COLUMNS)
    found = decontaminate.leaks(unique, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaked = {r.doc_id for r in found.collect()}
    assert set(texts_by_id(stages["decontamination"])) == set(texts_by_id(stages["near_duplicates"])) - leaked
    # Masking keeps every document, and leaves no base span.
    masked = texts_by_id(stages["personal_data"])
    assert set(masked) == set(texts_by_id(stages["decontamination"])) == set(out)
    assert not any(personal.seeds(t or "") for t in masked.values())
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    for i, text in masked.items():
        assert (out[i].n_tokens, out[i].ids_sha256, out[i].decoded_sha256) == hashed(library, text)


def test_no_documents_and_extra_columns_pass(spark, sf_dir, documents_of):
    empty = documents_of([]).selectExpr("*", "'k' AS _key", "1 AS toxicity_")
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, empty, sf_dir)
        assert out.count() == 0 and out.columns == empty.columns
