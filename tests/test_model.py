import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from geoscore.operators.folds import assign_spatial_folds, split_groups
from geoscore.plans import heat, learners, model, report, scoring, validation
from geoscore.schema import CATEGORICAL, FEATURES, LABEL, METRICS_COLUMNS, THRESHOLD_CURVE_COLUMNS
from geoscore.sources import sinks, storage, tables
from geoscore.streaming import score_stream as streaming
from geoscore.workload import queries
from geoscore.workload.views import view

ROUNDS = 2


@pytest.fixture(scope="module")
def observations(spark, sf_dir):
    return view(spark, sf_dir, "observations").cache()


@pytest.fixture(scope="module")
def fitted(observations):
    voters = [learners.boosted_a(ROUNDS), learners.boosted_b(ROUNDS)]
    return model.fit(observations, "event_id", voters)


@pytest.fixture(scope="module")
def evaluation(observations):
    candidates = [
        learners.boosted_a(ROUNDS),
        learners.boosted_b(ROUNDS),
        learners.forest(trees=3, depth=3),
    ]
    return report.train_and_evaluate(
        observations, "event_id", candidates, parallelism=5, limitations=["derived rows"]
    )


def test_published_sample_scores_in_range(spark, fitted, sample_row):
    row = scoring.score_rows(fitted, spark, [sample_row]).first()
    assert 0.0 <= row.risk_probability <= 1.0
    assert row.risk_level in ("LOW", "MODERATE", "HIGH", "CRITICAL")


def test_vote_is_between_its_members(observations, fitted):
    scored = fitted.transform(observations)
    outside = scored.filter(
        (F.col("score") < F.least("p_a", "p_b") - 1e-12)
        | (F.col("score") > F.greatest("p_a", "p_b") + 1e-12)
        | ~F.col("score").between(0, 1)
    )
    assert outside.count() == 0
    assert scored.count() == observations.count()
    assert scored.columns == [*observations.columns, "p_a", "p_b", "score"]


def test_filters_on_scores_do_not_score_twice(observations, fitted):
    def trees(frame):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("UDF(UDF(features")

    scored = scoring.score_table(fitted, observations, keep=["event_id"])
    once = trees(scored)
    critical = scored.filter("risk_level = 'CRITICAL' and event_id <> '1'")
    assert trees(critical) == once == 2
    assert critical.count() == sum(r.risk_level == "CRITICAL" for r in scored.collect() if r.event_id != "1")


def test_encoder_layout(observations, fitted):
    names = learners.encoded_names(fitted.encoder)
    assert len(names) == 22
    assert names[:6] == sorted(names[:6]) and names[0] == "cat__land_cover_Barren/Degraded"
    assert names[12] == "remainder__elevation_m" and names[-1] == "remainder__distance_to_road_m"
    vector = fitted.encoder.transform(observations).select(learners.FEATURES_COL).first()[0]
    assert vector.size == 22


def test_unknown_and_null_levels_have_no_indicator(spark, fitted, sample_row):
    rows = [
        sample_row,
        sample_row | {"land_cover": "Glacier"},
        sample_row | {"land_cover": None, "soil_type": None},
    ]
    encoded = fitted.encoder.transform(tables.from_rows(spark, rows)).select(learners.FEATURES_COL)
    sums = [sum(r[0].toArray()[:12]) for r in encoded.collect()]
    assert sums == [2.0, 1.0, 0.0]


def test_missing_numbers_are_filled_and_flagged(spark, observations, sample_row):
    with_flags = model.fit(
        observations, "event_id", [learners.boosted_a(1)], missing_indicators=True
    )
    assert len(learners.encoded_names(with_flags.encoder)) == 32
    rows = tables.from_rows(spark, [sample_row | {"ndvi": None}, sample_row | {"ndvi": float("nan")}])
    scores = [r.score for r in with_flags.transform(rows).collect()]
    assert scores[0] == scores[1] and 0 <= scores[0] <= 1


def test_importance_sums_to_one_and_ranks(spark, fitted):
    table = model.importance_ranking(fitted.feature_importance(spark, "a")).collect()
    assert len(table) == 22
    assert sum(r.importance for r in table) == pytest.approx(1.0)
    assert [r.importance for r in table] == sorted((r.importance for r in table), reverse=True)
    top = model.importance_ranking(fitted.feature_importance(spark, "a"), top=3).collect()
    assert top == table[:3]
    assert table[0].feature in ("remainder__slope_deg", "remainder__rainfall_24h_mm") or table[
        0
    ].feature.startswith("remainder__rainfall")


def test_saved_model_scores_the_same(spark, observations, fitted, tmp_path):
    path = str(tmp_path / "model")
    fitted.save(path)
    fitted.save(path)
    again = model.RiskModel.load(spark, path)
    assert again.votes == fitted.votes and again.features == FEATURES
    before = fitted.transform(observations).select("event_id", "score")
    after = again.transform(observations).select("event_id", "score")
    assert before.exceptAll(after).count() == 0


def test_equal_seeds_give_equal_trees(observations):
    fits = [
        model.fit(frame, "event_id", [learners.boosted_a(ROUNDS)])
        for frame in (observations, observations.repartition(7))
    ]
    trees = [f.learners[0].model.toDebugString.split("\n", 1)[1] for f in fits]
    assert trees[0] == trees[1]


def test_trees_do_not_depend_on_shuffle_settings(spark, observations):
    trees = []
    for tasks in ("4", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
        fitted = model.fit(observations, "event_id", [learners.boosted_a(ROUNDS)])
        trees.append(fitted.learners[0].model.toDebugString.split("\n", 1)[1])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert trees[0] == trees[1]


def test_layout_stays_even_when_ids_repeat(observations):
    frame = observations.withColumn("event_id", F.lit("same"))
    keyed = frame.select("*", learners.spread_key(["event_id", *FEATURES]))
    laid = learners.stable_layout(keyed, "event_id", 40_000).groupBy(F.spark_partition_id()).count()
    sizes = [r["count"] for r in laid.collect()]
    assert len(sizes) == 4 and max(sizes) < 1.3 * observations.count() / 4


def test_layout_grows_with_the_rows():
    assert [learners.layout_tasks(n) for n in (0, 1, 10_001, 150_000, 10**8, 10**11)] == [
        1,
        1,
        2,
        15,
        2_000,
        50_000,
    ]


def test_tasks_of_a_fit_do_not_multiply_with_the_rows(observations):
    keyed = observations.select("*", learners.spread_key(["event_id", *FEATURES]))
    assert learners.stable_layout(keyed, "event_id", 9_000_000).rdd.getNumPartitions() == 48
    assert [learners.fit_tasks(n) for n in (0, 10_001, 150_000, 10**6, 54 * 10**6, 10**11)] == [1, 2, 15, 48, 54, 50_000]


def test_learner_parameters():
    a, b = learners.boosted_a(), learners.boosted_b()
    assert (a.vote, b.vote) == (0.30, 0.70)
    assert [m.estimator.getMaxIter() for m in (a, b)] == [500, 500]
    assert [m.estimator.getStepSize() for m in (a, b)] == [0.04, 0.03]
    assert [m.estimator.getMaxDepth() for m in (a, b)] == [5, 5]
    assert a.estimator.getSubsamplingRate() == 0.85
    assert a.estimator.getSeed() == b.estimator.getSeed() == 42


def test_leaking_features_are_refused(observations):
    with pytest.raises(ValueError, match="latitude"):
        model.fit(observations, "event_id", [learners.boosted_a(1)], features=[*FEATURES, "latitude"])


def test_no_positives_is_an_error(observations):
    with pytest.raises(ValueError, match="no positive rows"):
        model.positive_weight(observations.filter(f"{LABEL} = 0"))


def test_out_of_fold_covers_every_row_once(observations, evaluation):
    oof = evaluation.out_of_fold
    assert oof.count() == observations.count() == oof.select("event_id").distinct().count()
    assert set(oof.columns) == {"event_id", LABEL, "fold", "cell", "p_a", "p_b", "p_forest", "score"} - {"cell"}
    folded = assign_spatial_folds(observations, "latitude", "longitude", LABEL, seed=42)
    assert split_groups(folded).count() == 0
    moved = oof.join(folded.select("event_id", F.col("fold").alias("f")), "event_id")
    assert moved.filter("fold <> f").count() == 0
    assert oof.filter("score is null or score < 0 or score > 1").count() == 0


def test_fold_scores_come_from_the_other_folds(observations, evaluation):
    folded = assign_spatial_folds(observations, "latitude", "longitude", LABEL, seed=42)
    weight = model.positive_weight(observations)
    other = model.fit(
        folded.filter("fold <> 2"), "event_id", [learners.boosted_b(ROUNDS)], pos_weight=weight
    )
    again = other.transform(folded.filter("fold = 2")).select("event_id", "p_b")
    stored = evaluation.out_of_fold.filter("fold = 2").select("event_id", "p_b")
    assert again.exceptAll(stored).count() == 0 and stored.count() > 0


def test_per_fold_weight_option(observations):
    folded = assign_spatial_folds(observations, "latitude", "longitude", LABEL, folds=2)
    oof = validation.out_of_fold(
        folded, "event_id", [learners.boosted_b(1)], folds=2, weight_per_fold=True
    )
    assert oof.count() == observations.count()


def test_reports(spark, observations, evaluation, tmp_path):
    path = str(tmp_path / "reports")
    evaluation.write(path)
    metrics = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/metrics").collect()))
    assert tuple(metrics) == METRICS_COLUMNS
    nested = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/report").collect()))
    assert nested["model"]["a_weight"] == 0.3 and nested["model"]["threshold"] == metrics["threshold"]
    assert nested["project"] is None and nested["limitations"] == ["derived rows"]
    assert nested["validation"]["method"] == "5-fold stratified grouped"
    assert nested["validation"]["grouping"].startswith("0.5 degree")
    assert nested["dataset"]["rows"] == observations.count()
    assert nested["dataset"]["states_present"] == [f"state_{i}" for i in range(5)]
    (tn, fp), (fn, tp) = nested["validation"]["confusion_matrix"]
    assert tn + fp + fn + tp == nested["dataset"]["rows"]
    assert tp / (tp + fp) == metrics["precision"] and tp / (tp + fn) == metrics["recall"]
    assert nested["risk_bands"]["HIGH"] == [0.5, 0.75] and nested["features"] == list(FEATURES)

    def csv(name):
        return spark.read.option("header", True).csv(f"{path}/{name}")

    curve = csv("threshold_analysis").collect()
    assert csv("threshold_analysis").columns == list(THRESHOLD_CURVE_COLUMNS) and len(curve) == 181
    assert float(curve[0].threshold) == 0.05 and float(curve[180].threshold) == 0.95
    comparison = {r.model: r for r in csv("model_comparison").collect()}
    assert set(comparison) == {"a", "b", "forest", "vote"}
    assert comparison["vote"].b_weight == "0.7" and comparison["a"].b_weight is None
    assert float(comparison["vote"].roc_auc) == metrics["roc_auc"] > 0.5
    importance = csv("feature_importance").collect()
    assert len(importance) == 22
    assert float(importance[0].importance) >= float(importance[-1].importance)


def test_heat_layer_conserves_rows(observations, fitted):
    layer = heat.heat_layer(fitted, observations)
    totals = {r.z: r.n for r in layer.groupBy("z").agg(F.sum("points").alias("n")).collect()}
    assert totals == {z: observations.count() for z in (6, 7, 8, 9)}


def test_stream_equals_batch(spark, sf_dir, fitted, tmp_path):
    records = view(spark, sf_dir, "records").select("record")
    inbox, out = str(tmp_path / "inbox"), str(tmp_path / "out")
    records.repartition(5).write.text(inbox)
    batch = scoring.score_records(fitted, tables.read_json_records(spark, inbox))
    stream = streaming.score_stream(fitted, streaming.read_record_stream(spark, inbox, 2))
    for _ in range(2):  # the second run finds nothing new
        streaming.write_score_stream(stream, out, str(tmp_path / "log"), once=True).awaitTermination()
    got = spark.read.parquet(out)
    assert {r.status for r in got.select("status").distinct().collect()} == {"valid", "quarantine"}
    assert got.count() == batch.count() == records.count()
    columns = ["record", "errors", "risk_probability", "risk_level"]
    assert got.select(columns).exceptAll(batch.select(columns)).count() == 0
    bad = got.filter("status = 'quarantine'")
    assert bad.filter("risk_probability is not null or risk_level is not null").count() == 0


def test_csv_matches_by_name(spark, observations, tmp_path):
    path = str(tmp_path / "csv")
    shuffled = observations.select(*reversed(observations.columns))
    sinks.write_scores(shuffled, path, "csv")
    back = tables.read_csv(spark, path)
    assert dict(back.dtypes) == dict(observations.dtypes)
    assert back.select(*observations.columns).exceptAll(observations).count() == 0
    assert set(dict(tables.read_csv(spark, path, typed=False).dtypes).values()) == {"string"}


def test_score_sinks(spark, observations, fitted, tmp_path):
    scored = scoring.score_table(fitted, observations, keep=["event_id"])
    for fmt in ("parquet", "csv", "json"):
        path = str(tmp_path / fmt)
        sinks.write_scores(scored, path, fmt, partition_by=["risk_level"])
        reader = spark.read.option("header", True) if fmt == "csv" else spark.read
        assert reader.format(fmt).load(path).count() == observations.count()


def test_json_table_source(spark, observations, tmp_path):
    path = str(tmp_path / "json")
    sinks.write_scores(observations.select(*FEATURES), path, "json")
    back = tables.read_json_table(spark, path)
    assert back.exceptAll(observations.select(*FEATURES)).count() == 0


def test_stored_tables_go_to_the_named_folder(spark, observations):
    stored = storage.store(observations.select("event_id", "state"), "check", ["state"])
    folder = spark.conf.get("spark.checkpoint.dir")
    assert all(folder in f for f in stored.inputFiles())
    assert stored.columns == ["event_id", "state"] and set(CATEGORICAL)
    assert stored.count() == observations.count()


def test_closing_drops_what_training_stored(spark, observations):
    with storage.recorded() as outside:
        result = report.train_and_evaluate(observations, "event_id", [learners.boosted_b(1)])
    assert outside == [] and result.stored
    result.metrics.collect()
    result.close()
    left = [p for p in result.stored if Path(p.removeprefix("file:")).exists()]
    assert left == []


def test_a_query_fits_the_candidates_it_needs(spark, sf_dir, monkeypatch):
    asked = []

    def counted(rows, row_id, wanted, *args, **kwargs):
        asked.append([m.name for m in wanted])
        return model.fit(rows, row_id, wanted, *args, **kwargs)

    monkeypatch.setattr(queries, "_STATE", {})
    monkeypatch.setattr(validation, "fit", counted)
    alone = queries.boosted_b_oof(spark, sf_dir)
    assert asked == [["b"]] * 5
    pair = queries.ensemble_oof(spark, sf_dir)
    assert asked == [["b"]] * 5 + [["a"]] * 5
    # Fitted apart or together, on shared folds and encoders: the same trees.
    together = validation.out_of_fold(queries._folded(spark, sf_dir), "event_id", queries._voters())
    columns = ["event_id", "fold", "p_a", "p_b", "score"]
    assert pair.select(columns).exceptAll(together.select(columns)).count() == 0 < pair.count()
    assert alone.exceptAll(pair.select(alone.columns)).count() == 0
