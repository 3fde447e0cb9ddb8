"""Training from counts: whole models, equal trees however rows are dealt, bounded tasks, splits by brute force."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoscore.plans import histograms as h
from geoscore.plans import learners, model, training, validation
from geoscore.workload import queries
from geoscore.workload.views import view


@pytest.fixture(scope="module")
def observations(spark, sf_dir):
    return view(spark, sf_dir, "observations").cache()


def test_registered_queries_fit_whole_models(spark, sf_dir, monkeypatch):
    asked = []

    def kept(rows, row_id, wanted, *args, **kwargs):
        asked.append({m.name: m.estimator.getNumTrees() if m.kind == "forest" else m.estimator.getMaxIter() for m in wanted})
        asked[-1] |= {f"{m.name} depth": m.estimator.getMaxDepth() for m in wanted}
        raise InterruptedError

    monkeypatch.setattr(queries, "_STATE", {})
    monkeypatch.setattr(queries, "fit", kept)
    monkeypatch.setattr(validation, "fit", kept)
    names = "boosted_a_oof boosted_b_oof ensemble_oof forest_oof oof_model_comparison model_roundtrip scored_heat_layer".split()
    for name in names:
        asked.clear()
        with pytest.raises(InterruptedError):
            queries.QUERIES[name](spark, sf_dir)
        sizes = {"a": 500, "b": 500, "forest": 100, "a depth": 5, "b depth": 5, "forest depth": 10}
        assert asked and all(fit == {k: sizes[k] for k in fit} for fit in asked), name


def test_one_task_and_many_give_the_same_trees(observations, monkeypatch):
    wanted = [learners.boosted_a(3), learners.boosted_b(3), learners.forest(9, 6)]
    # Blocks are drawn from one by one, so both fits pack the same.
    monkeypatch.setattr(training, "PACKED_ROWS", 100)
    monkeypatch.setattr(learners, "FIT_TASKS", 3)
    monkeypatch.setattr(learners, "LAYOUT_FEW_ROWS", 300)
    monkeypatch.setattr(training, "CHECKPOINT_ROUNDS", 2)
    trees = []
    for alone, chunk in ((10**6, 10**6), (0, 450)):
        monkeypatch.setattr(training, "ALONE_ROWS", alone)
        monkeypatch.setattr(h, "CHUNK_ROWS", chunk)
        fitted = model.fit(observations, "event_id", wanted)
        trees.append([m.model.toDebugString.split("\n", 1)[1] for m in fitted.learners])
    assert trees[0] == trees[1] and all("Predict" in t for t in trees[0])


def test_large_ensembles_score_as_spark_ml_does(observations, monkeypatch):
    monkeypatch.setattr(training, "MANY_TREES", 3)
    fitted = model.fit(observations, "event_id", [learners.boosted_a(4), learners.boosted_b(2), learners.forest(5, 6)])
    assert [m.flat is None for m in fitted.learners] == [False, True, False]
    plain = replace(fitted, learners=tuple(replace(m, flat=None) for m in fitted.learners))
    ours = fitted.transform(observations).select("event_id", *[F.col(f"p_{n}").alias(n) for n in ("a", "b", "forest")])
    both = ours.join(plain.transform(observations), "event_id")
    gaps = [F.max(F.abs(F.col(n) - F.col(f"p_{n}"))) for n in ("a", "b", "forest")]
    assert max(both.agg(*gaps).first()) < 1e-12
    assert fitted.transform(observations).filter("p_a > 0.5").count() > 0


def test_chunks_are_bounded(monkeypatch):
    monkeypatch.setattr(h, "CHUNK_ROWS", 250)
    blocks = [h.Chunk(np.zeros((2, 100), np.uint8), np.zeros(100, np.uint8), (((0, i), 100),), np.zeros(100)) for i in range(7)]
    sizes = [len(c.label) for c in h.merge(blocks)]
    assert sizes == [200, 200, 200, 100]


def _rows(n=400):
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.integers(0, 3, n) == k for k in range(2)] + [rng.normal(size=n), rng.integers(0, 5, n)]).astype(float)
    y = (x[:, 2] + x[:, 0] + rng.normal(0, 0.5, n) > 0.5).astype(int)
    columns = h.Columns((2, 3), ((0, 2),))
    raw = h.pack(columns, (0, 0), x, y)
    cuts = tuple(h.cuts_of([s], 1000) for _, s in h.sketch(raw))
    return x, y, replace(columns, cuts=cuts), raw


def test_root_split_is_the_best_by_brute_force():
    x, y, columns, raw = _rows()
    pw, sign = 2.5, 2.0 * y - 1
    w = np.where(y == 1, pw, 1.0)
    plan = h.Plan("boosted", columns, 1, 1, 42, 0.1, 1.0, 4, 20, pw, len(y))
    (tree,) = h.boosted_alone(plan, h.bin_rows(columns, raw))

    def squares(mask):
        return (w * sign)[mask].sum() ** 2 / w[mask].sum()

    best = max(
        (squares(left) + squares(~left), f, cut)
        for f in range(4)
        for cut in (np.unique(x[:, f])[:-1] + np.unique(x[:, f])[1:]) / 2
        if min((left := x[:, f] <= cut).sum(), (~left).sum()) >= 20
    )
    root = dict(zip(h.FIELDS, tree.nodes[0]))
    assert (root["feature"], root["threshold"]) == pytest.approx(best[1:])
    assert root["gain"] * w.sum() == pytest.approx(best[0] - squares(np.ones(len(y), bool)))
    left = x[:, root["feature"]] <= root["threshold"]
    leaves = h.leaf_values(plan, tree.arrays())[1:]
    assert leaves == pytest.approx([(w * sign)[m].sum() / w[m].sum() for m in (left, ~left)])


def test_cuts_hold_even_shares_of_all_rows():
    values = np.random.default_rng(2).lognormal(size=90_000)
    parts = [(0, values[i::9]) for i in range(9)]
    raws = [h.Raw((0, i), v[None], np.empty((0, len(v)), np.uint32), np.zeros(len(v), np.uint8)) for i, (_, v) in enumerate(parts)]
    cuts = h.cuts_of([s for r in raws for _, s in h.sketch(r)], 256)
    shares = np.diff([0, *np.searchsorted(np.sort(values), cuts), len(values)]) / len(values)
    assert len(cuts) == 255 and shares.max() < 1.5 / 256 and shares.min() > 0.5 / 256
    few = h.cuts_of([(np.array([1.0, 2.0, 4.0]), np.array([5, 1, 1]))], 256)
    assert few.tolist() == [1.5, 3.0] and h.cuts_of([(np.array([7.0]), np.array([9]))], 256).size == 0
