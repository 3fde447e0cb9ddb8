"""Daily counts, heavy cells, level tables, two stream outputs and permutation importance."""

import random

import pytest
from pyspark.sql import functions as F

from geoscore.operators import folds, ledger, ranking
from geoscore.plans import importance, learners, levels
from geoscore.plans.model import fit
from geoscore.streaming.two_outputs import TwoOutputs
from geoscore.workload import queries
from geoscore.workload.queries import _observations


def scored(spark, n, salt):
    rng = random.Random(salt)
    rows = [(rng.randrange(40) / 40, rng.randrange(2)) for _ in range(n)]
    return spark.createDataFrame(rows, "score double, label int")


def test_days_merge_to_the_whole(spark, tmp_path):
    path = str(tmp_path / "ledger")
    days = {f"2024-01-0{i}": scored(spark, 50 * i, i) for i in (1, 2, 3)}
    for day, rows in days.items():
        ledger.record_day(rows, path, day, "score", "label")
    both = days["2024-01-01"].unionByName(days["2024-01-03"])
    got = ledger.record_of_days(spark, path, ["2024-01-01", "2024-01-03", "2024-01-01"]).first()
    want = ranking.rank_metrics(both, "score", "label").first()
    assert got.roc_auc == pytest.approx(want.roc_auc) and got.pr_auc == pytest.approx(want.average_precision)
    # One day is read from that day's folder alone.
    plan = ledger.merged_counts(spark, path, ["2024-01-02"])
    held = ledger.recorded_days(spark, path)
    assert len(plan.inputFiles()) > 0 and all(held["2024-01-02"] in f for f in plan.inputFiles())


def test_a_failed_day_changes_nothing_and_a_corrected_one_counts_once(spark, tmp_path):
    path = str(tmp_path / "ledger")
    ledger.record_day(scored(spark, 10, 1), path, "d", "score", "label")
    bad = spark.createDataFrame([(None, 1)], "score double, label int")
    with pytest.raises(Exception, match="score"):
        ledger.record_day(bad, path, "d", "score", "label")
    total = lambda: ledger.merged_counts(spark, path).agg(F.sum(F.col("pos") + F.col("neg"))).first()[0]
    assert total() == 10
    for n in (7, 8, 9):
        ledger.record_day(scored(spark, n, 2), path, "d", "score", "label")
        assert total() == n
    folders = [p for p in (tmp_path / "ledger" / "counts").iterdir() if any(p.glob("*.parquet"))]
    assert ledger.recorded_days(spark, path)["d"] in {p.name for p in folders}
    ledger.record_day(scored(spark, 0, 2), path, "empty", "score", "label")
    assert total() == 9
    with pytest.raises(ValueError, match="no counts"):
        ledger.merged_counts(spark, path, ["other"])


def test_ledger_by_key(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = scored(spark, 80, 5).withColumn("state", F.when(F.col("score") < 0.5, "x").otherwise("y"))
    for part in (0, 1):
        own = rows.filter(F.pmod(F.hash("score", "label"), F.lit(2)) == part)
        ledger.record_day(own, path, str(part), "score", "label", by=["state"])
    got = {r.state: r.roc_auc for r in ledger.record_of_days(spark, path, by=["state"]).collect()}
    want = {r.state: r.roc_auc for r in ranking.rank_metrics(rows, "score", "label", by=["state"]).collect()}
    assert got == pytest.approx(want)


def unevenness(rows, k):
    total = [sum(r[c] for r in rows) or 1 for c in (0, 1)]
    sums = [[0, 0] for _ in range(k)]
    for pos, neg, fold in rows:
        sums[fold][0] += pos
        sums[fold][1] += neg
    return sum((s[c] / total[c]) ** 2 for s in sums for c in (0, 1))


def test_placing_takes_the_least_upsetting_fold():
    rng = random.Random(3)
    shares = [(rng.random(), rng.random()) for _ in range(60)]
    placed = folds.balanced_placing(shares, 4)

    def squares(rows):
        return sum(sum(s[c] for s, f in rows if f == k) ** 2 for k in range(4) for c in (0, 1))

    for i in range(60):
        before = list(zip(shares[:i], placed))
        costs = [squares([*before, (shares[i], k)]) for k in range(4)]
        assert costs[placed[i]] <= min(costs) + 1e-9


@pytest.mark.parametrize("bound", [None, 1000])
def test_heavy_cells_are_spread(spark, bound):
    rng = random.Random(8)
    cells = [(f"c{i:03}", rng.randrange(9), rng.randrange(30)) for i in range(300)]
    cells += [("big", 900, 400), ("wide", 5, 6000), ("positive", 700, 0)]
    frame = spark.createDataFrame(cells, "cell string, pos long, neg long")
    dealt = folds.deal_heavy(frame, "cell", most_groups=bound, parts=50).collect()
    assert sorted((r.cell, r.pos, r.neg) for r in dealt) == sorted(cells)
    plain = folds.deal_folds(frame, "cell", most_groups=1000).collect()
    ours, theirs = (unevenness([(r.pos, r.neg, r.fold) for r in d], 5) for d in (dealt, plain))
    assert ours < theirs
    again = folds.deal_heavy(frame.repartition(5), "cell", most_groups=bound, parts=50).collect()
    assert sorted(again) == sorted(dealt)


def test_heavy_deal_of_no_and_one_class(spark):
    schema = "cell string, pos long, neg long"
    assert folds.deal_heavy(spark.createDataFrame([], schema), "cell").count() == 0
    rows = [("a", 0, 5), ("b", 0, 5), ("c", 0, 1)]
    dealt = {r.cell: r.fold for r in folds.deal_heavy(spark.createDataFrame(rows, schema), "cell", folds=3).collect()}
    assert len(set(dealt.values())) == 3


@pytest.mark.parametrize("sent", [0, 10])
def test_level_slots(spark, sent, monkeypatch):
    monkeypatch.setattr(levels, "SENT_LEVELS", sent)
    rows = spark.createDataFrame(
        [(1, "b", "x"), (2, "a", None), (3, None, "y"), (4, "c", "x"), (5, "a", "z")], "id int, u string, v string"
    )
    indexes = levels.level_indexes(rows.filter("id < 5"), ["u", "v"])
    found, size = levels.with_slots(rows, indexes)
    assert size == 5 and found.columns == ["id", "u", "v", "slots"]
    assert {r.id: r.slots for r in found.collect()} == {1: [1, 3], 2: [0], 3: [4], 4: [2, 3], 5: [0]}


def test_levels_reach_no_plan_and_equal_the_encoder(spark, sf_dir):
    rows = _observations(spark, sf_dir).select("event_id", "land_cover", "soil_type")
    found, size = levels.with_slots(rows, levels.level_indexes(rows, ["land_cover", "soil_type"]))
    assert "Cropland" not in found.drop("land_cover")._jdf.queryExecution().toString().split("land_cover#")[-1]
    fitted = learners.encoder(("land_cover", "soil_type")).fit(rows)
    from pyspark.ml.functions import vector_to_array

    own = fitted.transform(rows).select("event_id", vector_to_array("features").alias("x"))
    hot = own.select("event_id", F.filter(F.transform("x", lambda v, i: F.when(v == 1, i.cast("bigint"))), lambda v: v.isNotNull()).alias("x"))
    both = found.join(hot, "event_id")
    assert both.filter(F.col("x") != F.col("slots")).count() == 0 and both.count() == rows.count()


def test_batches_are_written_once(spark, tmp_path):
    out = TwoOutputs(str(tmp_path / "out"), "log")

    def batch(*rows):
        schema = "record string, errors array<string>, risk_probability double, risk_level string, status string"
        return spark.createDataFrame(rows, schema)

    first = batch(("a", [], 0.1, "LOW", "valid"), ("b", ["x"], None, None, "quarantine"))
    out.write_batch(first, 0)
    out.write_batch(first, 0)
    assert [r.record for r in out.read(spark, "valid").collect()] == ["a"]
    second = batch(("c", [], 0.9, "CRITICAL", "valid"))
    # Half of the next batch is there, but not committed.
    out.write_table(second.drop("errors", "status"), "valid", 1)
    assert out.read(spark, "valid").count() == 1
    out.write_batch(second, 1)
    assert sorted(r.record for r in out.read(spark, "valid").collect()) == ["a", "c"]
    bad = out.read(spark, "quarantine")
    assert bad.columns == ["record", "errors", "batch"] and [(r.record, r.errors) for r in bad.collect()] == [("b", ["x"])]
    with pytest.raises(ValueError, match="another checkpoint"):
        TwoOutputs(out.path, "log2").write_batch(second, 0)


def test_shuffled_columns_keep_their_values(spark, sf_dir):
    features = ["ndvi", "land_cover"]
    rows = _observations(spark, sf_dir).select("event_id", *features)
    n = rows.count()
    out = importance.shuffled_columns(rows, "event_id", features).collect()
    assert len(out) == n
    for f in features:
        assert sorted(map(repr, (r[f] for r in out))) == sorted(map(repr, (r.given[f] for r in out)))
    moved = sum(r.ndvi != r.given.ndvi for r in out)
    assert moved > n // 2
    again = importance.shuffled_columns(rows.repartition(5), "event_id", features).collect()
    assert {r.event_id: r.given for r in again} == {r.event_id: r.given for r in out}
    one = importance.shuffled_columns(rows.limit(1), "event_id", features).collect()
    assert len(one) == 1 and one[0].given.ndvi == one[0].ndvi


def test_importance_by_brute_force(spark, sf_dir):
    features = ("slope_deg", "rainfall_24h_mm", "land_cover")
    rows = _observations(spark, sf_dir)
    model = fit(rows, "event_id", [learners.boosted_a(3)], features=features)
    found = {r.feature: r for r in importance.permutation_importance(model, rows, "event_id", "landslide").collect()}
    assert set(found) == set(features)
    given = importance.shuffled_columns(rows.select("event_id", *features, "landslide"), "event_id", features)
    plain = ranking.rank_metrics(model.transform(rows), "score", "landslide").first()
    for f in features:
        other = model.transform(given.withColumn(f, F.col("given")[f]).drop("given"))
        want = ranking.rank_metrics(other, "score", "landslide").first()
        assert found[f].roc_auc == pytest.approx(want.roc_auc)
        assert found[f].auc_drop == pytest.approx(plain.roc_auc - want.roc_auc)
        assert found[f].ap_drop == pytest.approx(plain.average_precision - want.average_precision)
    assert found["slope_deg"].auc_drop > found["land_cover"].auc_drop


def test_an_inbox_grows_in_files_not_in_their_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "INBOX_RECORDS", 100)
    records = spark.range(1000).selectExpr("cast(id as string) AS record")
    in_batch = queries._write_inbox(records, str(tmp_path / "inbox"))
    sizes = [len(p.read_text().splitlines()) for p in (tmp_path / "inbox").glob("part-*")]
    assert in_batch == 4 and len(sizes) == 12 and sum(sizes) == 1000 and max(sizes) <= 110
