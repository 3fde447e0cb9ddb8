"""Registered queries: name -> (spark, sf_dir) -> DataFrame, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.errors import StreamingQueryException
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoscore.functions.scores import (
    VOTE_WEIGHTS,
    at_or_above,
    risk_band,
    round_score,
    soft_vote,
)
from geoscore.functions.spatial import grid_cell, grid_cell_bound
from geoscore.operators import folds as fold_ops
from geoscore.operators import ledger, metrics, profile, ranking, tiles, validate
from geoscore.plans import heat, importance, learners, levels, scoring, trees, validation
from geoscore.plans.model import RiskModel, fit, importance_ranking
from geoscore.schema import (
    FEATURES,
    LABEL,
    METRICS_COLUMNS,
    THRESHOLD_CURVE_COLUMNS,
    schema_for,
)
from geoscore.sources import tables
from geoscore.sources.sinks import write_lines, write_record, write_report, write_scores
from geoscore.sources.storage import scratch_path, store
from geoscore.streaming.score_stream import read_record_stream, score_stream, write_score_stream
from geoscore.streaming.two_outputs import TwoOutputs
from geoscore.workload.views import LAND_COVER, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

VOTES = {f"p_{name}": share for name, share in VOTE_WEIGHTS.items()}
# Sizes of the models of queries that hold a fit against something else, on a planted label, node by
# node or round by round. All other queries fit the library's defaults, 500 rounds and 100 trees.
QUERY_ROUNDS = 5
QUERY_TREES, QUERY_DEPTH = 20, 5
# The published operating point the prediction queries use.
OPERATING_THRESHOLD = 0.18


def query(function: Query) -> Query:
    """Register under the function's name, without the underscore that avoids a clash."""
    QUERIES[function.__name__.removesuffix("_")] = function
    return function


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "scored").withColumn("score", soft_vote(VOTES))


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "observations")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    """Order-dependent sums, rounded far above the last bits they can differ in."""
    return df.select(*[F.round(n, 9).alias(n) if n in names else F.col(n) for n in df.columns])


# --- sources and sinks ---------------------------------------------------------


@query
def csv_scan(spark, sf_dir):
    path = scratch_path(spark, "csv")
    write_scores(_observations(spark, sf_dir), path, "csv")
    return tables.read_csv(spark, path)


@query
def json_scan(spark, sf_dir):
    path = scratch_path(spark, "json")
    write_scores(_observations(spark, sf_dir).select("event_id", *FEATURES), path, "json")
    return tables.read_json_table(spark, path, schema_for(["event_id", *FEATURES]))


@query
def csv_missing_markers(spark, sf_dir):
    """Cells that stand for a missing number, in every spelling."""
    path = scratch_path(spark, "csv-markers")
    spellings = F.array(*map(F.lit, tables.MISSING_MARKERS))
    spelling = F.get(spellings, F.pmod(F.col("event_id").cast("bigint"), F.size(spellings)).cast("int"))
    cells = _observations(spark, sf_dir).select(
        "event_id", F.coalesce(F.col("ndvi").cast("string"), spelling).alias("ndvi"), "land_cover"
    )
    write_scores(cells, path, "csv")
    return tables.read_csv(spark, path)


@query
def score_sink(spark, sf_dir):
    path = scratch_path(spark, "scores")
    scored = _scored(spark, sf_dir).select("obs_id", *scoring.score_columns())
    write_scores(scored, path, partition_by=["risk_level"])
    return tables.read_parquet(spark, path).select("obs_id", "risk_probability", "risk_level")


# --- projection and validation -------------------------------------------------


@query
def feature_projection(spark, sf_dir):
    return validate.project_features(_observations(spark, sf_dir), keep=["event_id"])


@query
def label_cast(spark, sf_dir):
    text = _observations(spark, sf_dir).select("event_id", F.col(LABEL).cast("string").alias(LABEL))
    return validate.with_label(text)


@query
def leakage_guard(spark, sf_dir):
    kept = validate.drop_excluded(_observations(spark, sf_dir))
    validate.guard_features([name for name in kept.columns if name != LABEL])
    return kept


@query
def json_required_fields(spark, sf_dir):
    missing = validate.missing_in_record("record")
    return view(spark, sf_dir, "records").select(
        "event_id", F.array_join(missing, ",").alias("missing")
    )


@query
def json_typed_quarantine(spark, sf_dir):
    checked = validate.check_records(view(spark, sf_dir, "records"))
    return checked.select("event_id", *FEATURES, F.array_join("errors", ",").alias("errors"))


@query
def json_valid_rows(spark, sf_dir):
    valid, _ = validate.split_checked(validate.check_records(view(spark, sf_dir, "records")))
    return valid.select("event_id", *FEATURES)


@query
def column_quarantine(spark, sf_dir):
    text = _observations(spark, sf_dir).select(
        "event_id",
        *[F.col(n).cast("string").alias(n) for n in FEATURES if n != "curvature"],
        F.when(F.col("is_fatal") == 1, F.lit("n/a"))
        .otherwise(F.col("curvature").cast("string"))
        .alias("curvature"),
    )
    _, bad = validate.split_checked(validate.check_columns(text))
    return bad.select("event_id", "slope_deg", F.array_join("errors", ",").alias("errors"))


# --- scores and bands ----------------------------------------------------------


@query
def grid_cell_key(spark, sf_dir):
    return view(spark, sf_dir, "scored").select(
        "obs_id", grid_cell("latitude", "longitude").alias("cell")
    )


@query
def class_balance(spark, sf_dir):
    return metrics.class_balance(view(spark, sf_dir, "scored"), "label")


@query
def class_weights(spark, sf_dir):
    rows = view(spark, sf_dir, "scored").select("obs_id", "label")
    balance = metrics.class_balance(rows, "label").select("pos_weight").scalar()
    weight = F.when(F.col("label") == 1, balance).otherwise(F.lit(1.0))
    return rows.select("obs_id", "label", weight.alias("weight"))


@query
def soft_vote_(spark, sf_dir):
    return _scored(spark, sf_dir).select("obs_id", "p_a", "p_b", "score")


@query
def score_round(spark, sf_dir):
    return _scored(spark, sf_dir).select("obs_id", round_score("score").alias("risk_probability"))


@query
def risk_band_(spark, sf_dir):
    return _scored(spark, sf_dir).select("obs_id", risk_band("score").alias("risk_level"))


@query
def band_summary(spark, sf_dir):
    served = _scored(spark, sf_dir).select("score", *scoring.score_columns())
    out = served.groupBy("risk_level").agg(
        F.count(F.lit(1)).alias("points"), F.avg("score").alias("score_avg")
    )
    return _rounded(out, "score_avg")


@query
def threshold_predict(spark, sf_dir):
    flag = at_or_above("score", OPERATING_THRESHOLD)
    return _scored(spark, sf_dir).select("obs_id", flag.alias("predicted"))


# --- metrics -------------------------------------------------------------------


@query
def threshold_grid(spark, sf_dir):
    ends = _scored(spark, sf_dir).agg(F.min("score").alias("low"), F.max("score").alias("high"))
    low, high = ends.first()
    return metrics.threshold_grid(spark, low, high)


@query
def threshold_grid_published(spark, sf_dir):
    """The published grid with the rows that reach each of its thresholds."""
    rows = _scored(spark, sf_dir).select(
        F.explode(
            F.sequence(F.lit(0), metrics.reached_thresholds(F.col("score"), *metrics.GRID))
        ).alias("reached")
    )
    reached = rows.filter("reached > 0").groupBy((F.col("reached") - 1).alias("step")).count()
    grid = metrics.threshold_grid(spark)
    return grid.join(reached, "step", "left").select(
        "step", "threshold", F.coalesce("count", F.lit(0).cast("bigint")).alias("rows")
    )


@query
def threshold_curve(spark, sf_dir):
    return metrics.threshold_curve(_scored(spark, sf_dir), "score", "label")


@query
def threshold_curve_by_state(spark, sf_dir):
    return metrics.threshold_curve(_scored(spark, sf_dir), "score", "label", by=["state"])


@query
def best_threshold_f1(spark, sf_dir):
    return metrics.best_threshold(metrics.threshold_curve(_scored(spark, sf_dir), "score", "label"))


@query
def best_threshold_f2(spark, sf_dir):
    curve = metrics.threshold_curve(_scored(spark, sf_dir), "score", "label")
    return metrics.best_threshold(curve, "f2").select("threshold", "f2", "precision", "recall")


@query
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(
        _scored(spark, sf_dir), "label", at_or_above("score", OPERATING_THRESHOLD)
    )


@query
def precision_recall_fbeta(spark, sf_dir):
    counts = metrics.confusion(
        _scored(spark, sf_dir), "label", at_or_above("score", OPERATING_THRESHOLD), by=["state"]
    )
    return metrics.with_rates(counts).select("state", "f1", "f2", "precision", "recall")


@query
def roc_auc(spark, sf_dir):
    out = ranking.rank_metrics(_scored(spark, sf_dir), "score", "label")
    return _rounded(out.select("pos_total", "neg_total", "roc_auc"), "roc_auc")


@query
def average_precision(spark, sf_dir):
    out = ranking.rank_metrics(_scored(spark, sf_dir), "score", "label")
    return _rounded(out.select("pos_total", "average_precision"), "average_precision")


@query
def rank_metrics_quantised(spark, sf_dir):
    out = ranking.rank_metrics(_scored(spark, sf_dir), "score", "label", decimals=3)
    return _rounded(out, "roc_auc", "average_precision")


@query
def rank_metrics_by_state(spark, sf_dir):
    out = ranking.rank_metrics(_scored(spark, sf_dir), "score", "label", by=["state"])
    return _rounded(out, "roc_auc", "average_precision")


@query
def metrics_record(spark, sf_dir):
    out = profile.metrics_record(_scored(spark, sf_dir), "score", "label")
    return _rounded(out.select(*METRICS_COLUMNS), "roc_auc", "pr_auc")


@query
def metrics_sink(spark, sf_dir):
    """The metrics record, written as JSON and read back."""
    path = scratch_path(spark, "metrics")
    record = profile.metrics_record(_scored(spark, sf_dir), "score", "label").select(*METRICS_COLUMNS)
    write_record(record, path)
    out = spark.read.schema(record.schema).option("multiLine", True).json(path)
    return _rounded(out, "roc_auc", "pr_auc")


DAYS = ("2024-06-01", "2024-06-02", "2024-06-03", "2024-06-04")


@query
def metrics_of_days(spark, sf_dir):
    """Metrics from stored counts per day, one day corrected later: of all days and of two."""
    path = scratch_path(spark, "ledger")
    rows = _scored(spark, sf_dir).withColumn("day", F.pmod(F.floor(F.col("obs_id") / 100), F.lit(len(DAYS))))
    for i, day in enumerate(DAYS):
        ledger.record_day(rows.filter(F.col("day") == (0 if i == 2 else i)), path, day, "score", "label")
    ledger.record_day(rows.filter("day = 2"), path, DAYS[2], "score", "label")
    frames = [
        ledger.record_of_days(spark, path, days).select(F.lit(name).alias("days"), *METRICS_COLUMNS)
        for name, days in (("all", None), ("two", DAYS[1:3]))
    ]
    return _rounded(frames[0].unionByName(frames[1]), "roc_auc", "pr_auc")


@query
def report_sink(spark, sf_dir):
    """The threshold report, written as one CSV file and read back."""
    path = scratch_path(spark, "report")
    curve = metrics.threshold_curve(_scored(spark, sf_dir), "score", "label")
    curve = curve.select(*THRESHOLD_CURVE_COLUMNS)
    write_report(curve, path, ["threshold"])
    return spark.read.schema(curve.schema).option("header", True).csv(path)


@query
def dataset_profile(spark, sf_dir):
    out = profile.dataset_profile(_observations(spark, sf_dir), LABEL, "state", "source")
    return out.select(
        "rows", "positive_rows", "negative_rows", F.array_join("states_present", ",").alias("states")
    )


@query
def provenance_counts(spark, sf_dir):
    return profile.source_counts(_observations(spark, sf_dir), "source", LABEL)


@query
def model_comparison(spark, sf_dir):
    long = profile.to_long(
        _scored(spark, sf_dir), {"p_a": "a", "p_b": "b", "score": "vote"}, "label"
    )
    out = profile.model_comparison(long, "label", {"vote": VOTE_WEIGHTS})
    return _rounded(out, "roc_auc", "pr_auc")


# --- folds ---------------------------------------------------------------------


@query
def cell_class_counts(spark, sf_dir):
    cells = view(spark, sf_dir, "scored").withColumn("cell", grid_cell("latitude", "longitude"))
    return fold_ops.group_counts(cells, "cell", "label")


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_ops.assign_spatial_folds(
        _observations(spark, sf_dir), "latitude", "longitude", LABEL
    )


@query
def grouped_folds(spark, sf_dir):
    return _folded(spark, sf_dir).select("event_id", "cell", "fold")


@query
def grouped_folds_points(spark, sf_dir):
    folded = fold_ops.assign_spatial_folds(
        view(spark, sf_dir, "scored"), "latitude", "longitude", "label"
    )
    return folded.select("obs_id", "cell", "fold")


@query
def grouped_folds_unbounded(spark, sf_dir):
    cells = view(spark, sf_dir, "scored").withColumn("cell", grid_cell("latitude", "longitude"))
    return fold_ops.assign_folds(cells, "cell", "label").select("obs_id", "cell", "fold")


@query
def fold_deal(spark, sf_dir):
    cells = view(spark, sf_dir, "scored").withColumn("cell", grid_cell("latitude", "longitude"))
    counts = fold_ops.group_counts(cells, "cell", "label")
    return fold_ops.deal_folds(counts, "cell", most_groups=grid_cell_bound())


@query
def fold_balance(spark, sf_dir):
    return fold_ops.fold_balance(_folded(spark, sf_dir), LABEL)


@query
def fold_leak_check(spark, sf_dir):
    folded = _folded(spark, sf_dir)
    per_cell = folded.groupBy("cell").agg(
        F.count(F.lit(1)).alias("rows"), F.min("fold").alias("lo"), F.max("fold").alias("hi")
    )
    return per_cell.agg(
        F.count(F.lit(1)).alias("cells"),
        F.sum("rows").alias("rows"),
        F.count_if(F.col("lo") != F.col("hi")).alias("split_cells"),
    )


@query
def heavy_cells(spark, sf_dir):
    """A third of all rows in one cell and much in two more: no cell is split, and the classes
    are spread more evenly than by dealing back and forth."""
    n = F.col("obs_id")
    cell = (
        F.when(n % 3 == 0, "heavy")
        .when(n % 7 == 1, "large")
        .when(n % 11 == 2, "broad")
        .otherwise(grid_cell("latitude", "longitude"))
    )
    rows = view(spark, sf_dir, "scored").withColumn("cell", cell).select("cell", "label")
    totals = metrics.class_balance(rows, "label").first()
    folded = fold_ops.assign_folds(rows, "cell", "label", most_groups=grid_cell_bound(), heavy=True)
    plain = fold_ops.assign_folds(rows, "cell", "label", most_groups=grid_cell_bound())

    def unevenness(df, name):
        pos, neg = F.col("pos") / totals["pos_rows"], F.col("neg") / totals["neg_rows"]
        return fold_ops.fold_balance(df, "label").agg(F.sum(pos * pos + neg * neg).alias(name))

    checked = metrics.gather(
        [
            fold_ops.fold_balance(folded, "label").agg(
                F.count(F.lit(1)).alias("folds"), F.sum("groups").alias("cells"), F.sum(F.col("pos") + F.col("neg")).alias("rows")
            ),
            fold_ops.split_groups(folded).agg(F.count(F.lit(1)).alias("split_cells")),
            unevenness(folded, "ours"),
            unevenness(plain, "dealt"),
        ]
    )
    return checked.select("folds", "cells", "rows", "split_cells", (F.col("ours") < F.col("dealt")).alias("more_even"))


# --- encoding and tiles --------------------------------------------------------


@query
def one_hot_encode(spark, sf_dir):
    rows = _observations(spark, sf_dir)
    encoded = learners.encoder().fit(rows).transform(rows)
    marks = F.transform(
        F.slice(vector_to_array(learners.FEATURES_COL), 1, 12), lambda v: v.cast("int").cast("string")
    )
    return encoded.select("event_id", "land_cover", "soil_type", F.array_join(marks, "").alias("indicators"))


@query
def level_slots(spark, sf_dir):
    """The same indicators from tables of levels."""
    rows = _observations(spark, sf_dir).select("event_id", "land_cover", "soil_type")
    indexes = levels.level_indexes(rows, ["land_cover", "soil_type"])
    found, size = levels.with_slots(rows, indexes)
    marks = F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.array_contains("slots", i.cast("bigint")).cast("int").cast("string")
    )
    return found.select("event_id", "land_cover", "soil_type", F.array_join(marks, "").alias("indicators"))


@query
def point_layer(spark, sf_dir):
    return tiles.point_layer(_scored(spark, sf_dir), "latitude", "longitude", "score")


@query
def heat_tiles_z9(spark, sf_dir):
    points = tiles.point_layer(_scored(spark, sf_dir), "latitude", "longitude", "score")
    return _rounded(tiles.heat_tiles(points), "score_sum", "score_avg")


@query
def heat_tiles_rollup(spark, sf_dir):
    points = tiles.point_layer(_scored(spark, sf_dir), "latitude", "longitude", "score")
    return _rounded(tiles.roll_up(tiles.heat_tiles(points)), "score_sum", "score_avg")


# --- models --------------------------------------------------------------------

_STATE: dict[tuple, object] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make):
    """Fits and stored out-of-fold tables are made once per session and scale."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STATE:
        _STATE[key] = make()
    return _STATE[key]


def _voters() -> list[learners.Learner]:
    return [learners.boosted_a(), learners.boosted_b()]


def _candidates() -> list[learners.Learner]:
    return [*_voters(), learners.forest()]


def _few_rounds() -> list[learners.Learner]:
    return [learners.boosted_a(QUERY_ROUNDS), learners.boosted_b(QUERY_ROUNDS)]


def _model(spark: SparkSession, sf_dir: str) -> RiskModel:
    return _once(
        spark, sf_dir, "model", lambda: fit(_observations(spark, sf_dir), "event_id", _voters())
    )


def _small_model(spark: SparkSession, sf_dir: str) -> RiskModel:
    return _once(
        spark, sf_dir, "small-model", lambda: fit(_observations(spark, sf_dir), "event_id", _few_rounds())
    )


def _fold_models(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> tuple[DataFrame, list[RiskModel]]:
    """The folded rows and, per fold, a model of these candidates: each is fitted when first asked for.

    All share folds, encoders and layout, so a candidate's trees don't depend on which others are fitted.
    """
    rows = _once(
        spark, sf_dir, "folded", lambda: validation.store_folded(_folded(spark, sf_dir), "event_id")
    )
    fitted = _once(spark, sf_dir, "fold-models", dict)
    wanted = [m for m in _candidates() if m.name in names]
    missing = [m for m in wanted if m.name not in fitted]
    if missing:
        encoders = next(([m.encoder for m in models] for models in fitted.values()), None)
        models = validation.fit_folds(rows, "event_id", missing, parallelism=fold_ops.FOLDS, encoders=encoders)
        for i, learner in enumerate(missing):
            fitted[learner.name] = [replace(m, learners=(m.learners[i],)) for m in models]
    per_fold = zip(*[fitted[m.name] for m in wanted])
    return rows, [replace(ms[0], learners=tuple(m.learners[0] for m in ms)) for ms in per_fold]


def _oof(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """These candidates' out-of-fold scores, stored."""
    return _once(
        spark,
        sf_dir,
        f"oof-{'-'.join(names)}",
        lambda: store(validation.score_folds(*_fold_models(spark, sf_dir, names)), "oof"),
    )


@query
def boosted_a_oof(spark, sf_dir):
    return _oof(spark, sf_dir, "a").select("event_id", LABEL, "fold", "p_a")


@query
def boosted_b_oof(spark, sf_dir):
    return _oof(spark, sf_dir, "b").select("event_id", LABEL, "fold", "p_b")


@query
def forest_oof(spark, sf_dir):
    return _oof(spark, sf_dir, "forest").select("event_id", LABEL, "fold", "p_forest")


@query
def ensemble_oof(spark, sf_dir):
    return _oof(spark, sf_dir, "a", "b").select("event_id", LABEL, "fold", "p_a", "p_b", "score")


@query
def oof_coverage(spark, sf_dir):
    """Per fold: rows and positives scored, distinct rows, scores in range, votes in between."""
    p_a, p_b, score = F.col("p_a"), F.col("p_b"), F.col("score")
    between = (score >= F.least(p_a, p_b) - 1e-12) & (score <= F.greatest(p_a, p_b) + 1e-12)
    return (
        _oof(spark, sf_dir, "a", "b")
        .groupBy("fold", "event_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max(LABEL).alias("y"),
            F.count_if(score.between(0.0, 1.0) & between).alias("ok"),
        )
        .groupBy("fold")
        .agg(
            F.sum("n").alias("rows"),
            F.count(F.lit(1)).alias("events"),
            F.sum(F.col("y").cast("bigint")).alias("positives"),
            F.sum("ok").alias("sound_votes"),
        )
    )


@query
def oof_model_comparison(spark, sf_dir):
    names = {"p_a": "a", "p_b": "b", "p_forest": "forest", "score": "vote"}
    long = profile.to_long(_oof(spark, sf_dir, "a", "b", "forest"), names, LABEL)
    return profile.model_comparison(long, LABEL, {"vote": VOTE_WEIGHTS})


@query
def feature_importance(spark, sf_dir):
    return importance_ranking(_model(spark, sf_dir).feature_importance(spark, "a"))


@query
def feature_importance_summary(spark, sf_dir):
    """Encoded features per learner, and what their importances add up to."""
    model = _model(spark, sf_dir)
    both = [
        model.feature_importance(spark, name).select(F.lit(name).alias("learner"), "importance")
        for name in ("a", "b")
    ]
    totals = both[0].unionByName(both[1]).groupBy("learner")
    return totals.agg(
        F.count(F.lit(1)).alias("features"),
        F.round(F.sum("importance"), 9).alias("total"),
        F.count_if(F.col("importance") < 0).alias("negative"),
    )


@query
def batch_score(spark, sf_dir):
    return scoring.score_table(
        _model(spark, sf_dir), _observations(spark, sf_dir), keep=["event_id"]
    )


@query
def batch_score_coverage(spark, sf_dir):
    """Rows scored, scores in range, and bands that do not fit the served score."""
    served = scoring.score_table(_model(spark, sf_dir), _observations(spark, sf_dir))
    p, edge = F.col("risk_probability"), F.col("risk_probability").isin(0.25, 0.5, 0.75)
    return served.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(p.between(0.0, 1.0)).alias("in_range"),
        F.count_if((risk_band(p) != F.col("risk_level")) & ~edge).alias("misfits"),
    )


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make():
        inbox, out = scratch_path(spark, "inbox"), scratch_path(spark, "stream")
        view(spark, sf_dir, "records").select("record").write.text(inbox)
        scored = score_stream(_model(spark, sf_dir), read_record_stream(spark, inbox))
        write_score_stream(scored, out, scratch_path(spark, "stream-log"), once=True).awaitTermination()
        return spark.read.parquet(out)

    return _once(spark, sf_dir, "stream", make)


@query
def stream_score(spark, sf_dir):
    return _streamed(spark, sf_dir).select(
        "record", "status", F.array_join("errors", ",").alias("errors"), "risk_probability", "risk_level"
    )


@query
def stream_batch_agreement(spark, sf_dir):
    """Per status: records on the stream, and those the batch scores otherwise."""
    columns = ["record", "risk_probability", "risk_level"]
    batch = scoring.score_records(_model(spark, sf_dir), view(spark, sf_dir, "records"))
    both = _streamed(spark, sf_dir).select(*columns, "status", F.lit(1).alias("side")).unionByName(
        batch.select(
            *columns,
            F.when(F.size("errors") == 0, "valid").otherwise("quarantine").alias("status"),
            F.lit(-1).alias("side"),
        )
    )
    return (
        both.groupBy(*columns, "status")
        .agg(F.count_if(F.col("side") == 1).alias("n"), F.sum("side").alias("gap"))
        .groupBy("status")
        .agg(F.sum("n").alias("records"), F.sum(F.abs("gap")).cast("bigint").alias("differing"))
    )


@query
def model_roundtrip(spark, sf_dir):
    """Rows scored by the saved and reloaded model, and those it scores otherwise."""
    path = scratch_path(spark, "model")
    model = _model(spark, sf_dir)
    model.save(path)
    rows = _observations(spark, sf_dir)
    first = model.transform(rows).select(*rows.columns, F.col("score").alias("score_before"))
    again = RiskModel.load(spark, path).transform(first)
    return again.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~F.col("score").eqNullSafe(F.col("score_before"))).alias("differing"),
    )


@query
def node_table_scores(spark, sf_dir):
    """Rows scored by the path conditions of every learner's nodes, and those the model scores otherwise."""
    model = _small_model(spark, sf_dir)
    ensembles = {m.name: trees.Ensemble.of(spark, m) for m in model.learners}
    scored = trees.score_by_nodes(model, model.transform(_observations(spark, sf_dir)), ensembles)
    near = [F.abs(F.col(f"p_{n}") - F.col(f"n_{n}")) < 1e-12 for n in ensembles]
    voted = soft_vote({f"n_{m.name}": m.vote for m in model.learners})
    same = near[0] & near[1] & (F.abs(voted - F.col("score")) < 1e-12)
    return scored.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.coalesce(same, F.lit(False))).alias("differing"))


@query
def staged_losses(spark, sf_dir):
    """Each stage's rows, and whether its loss is that of the scores themselves at the end, and falls on the training rows."""
    model, rows = _small_model(spark, sf_dir), _observations(spark, sf_dir)
    fitted = next(m for m in model.learners if m.name == "b")
    staged = store(trees.staged_log_loss(model, rows, trees.Ensemble.of(spark, fitted), LABEL, every=2), "staged")
    p = F.col("p_b")
    own = model.transform(rows).agg(
        F.avg(-F.when(F.col(LABEL).cast("int") == 1, F.log(p)).otherwise(F.log(1 - p))).alias("own")
    )
    paired = staged.select("rounds", "rows", "log_loss").join(
        staged.select((F.col("rounds") + F.when(F.col("rounds") == 4, 1).otherwise(2)).alias("rounds"), F.col("log_loss").alias("before")),
        "rounds",
        "left",
    )
    last = own.select(F.lit(QUERY_ROUNDS).alias("rounds"), "own")
    checked = paired.join(last, "rounds", "left")
    sound = F.coalesce(F.col("log_loss") < F.col("before"), F.lit(True))
    agrees = F.coalesce(F.abs(F.col("log_loss") - F.col("own")) < 1e-9, F.lit(True))
    return checked.select("rounds", "rows", (sound & agrees).alias("sound"))


@query
def same_trees(spark, sf_dir):
    """Nodes of two fits of one table in different layouts, and those that differ."""
    rows = _observations(spark, sf_dir)
    one = next(m for m in _small_model(spark, sf_dir).learners if m.name == "a")
    again = fit(rows.repartition(7, "event_id"), "event_id", [learners.boosted_a(QUERY_ROUNDS)]).learners[0]
    found = trees.differing_nodes(trees.node_table(spark, one), trees.node_table(spark, again))
    return found.select((F.col("nodes") > 2 * QUERY_ROUNDS).alias("has_nodes"), "differing")


@query
def in_memory_rows(spark, sf_dir):
    """The first events as request dicts, and back as typed rows."""
    few = _observations(spark, sf_dir).select(*FEATURES).orderBy(*FEATURES).limit(20)
    return tables.from_rows(spark, [r.asDict() | {"extra": 1} for r in few.collect()])


@query
def interrupted_save(spark, sf_dir):
    """A save broken off after the learners leaves the model of the save before."""
    path = scratch_path(spark, "versioned")
    model, rows = _model(spark, sf_dir), _observations(spark, sf_dir)
    model.save(path)
    halfway = replace(model, learners=tuple(replace(m, vote=1.0 - m.vote) for m in model.learners))
    halfway.write_version(path)  # all but the manifest, which is written last
    kept = RiskModel.load(spark, path).votes
    halfway.save(path)
    new = RiskModel.load(spark, path).votes
    scored = RiskModel.load(spark, path).transform(rows)
    return scored.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(kept == model.votes).alias("old_kept"),
        F.lit(new == halfway.votes).alias("new_read"),
    )


@query
def csv_quarantine(spark, sf_dir):
    """A written CSV with broken lines: sound rows, and each broken line with its reason."""
    path = scratch_path(spark, "broken-csv")
    rows = _observations(spark, sf_dir).select("event_id", "ndvi", "land_cover", "elevation_m")
    kind = F.col("event_id") % 10
    rows = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns])
    line = F.concat_ws(",", "event_id", "ndvi", "land_cover", "elevation_m")
    line = (
        F.when(kind == 1, F.concat(F.lit('"'), line))
        .when(kind == 2, F.concat(line, F.lit(",7")))
        .when(kind == 3, F.concat_ws(",", "event_id", "ndvi"))
        .when(kind == 4, F.concat_ws(",", "event_id", "ndvi", "land_cover", F.lit("NA")))
        .when(kind == 5, F.concat_ws(",", "event_id", F.lit("wet"), "land_cover", F.lit("high")))
        .otherwise(line)
    )
    write_lines(rows.select(line.alias("value")), path, "event_id,ndvi,land_cover,elevation_m")
    valid, broken = tables.read_csv_checked(spark, path, schema_for(["event_id", "ndvi", "land_cover", "elevation_m"]))
    sound = valid.select(
        F.col("event_id").cast("string").alias("line"), F.lit("valid").alias("reason"), F.col("elevation_m").isNull().alias("missing")
    )
    return sound.unionByName(broken.select(F.substring_index("line", ",", 1).alias("line"), "reason", F.lit(False).alias("missing")))


@query
def rescored_table(spark, sf_dir):
    """Scoring a table that has score, label and feature-vector columns of its own."""
    rows = _observations(spark, sf_dir).withColumns(
        {
            "p_a": F.lit(2.0),
            "score": F.lit(-1.0),
            "features": F.lit("mine"),
            "label": F.col("event_id"),
        }
    )
    scored = _model(spark, sf_dir).transform(rows)
    sound = F.col("p_a").between(0.0, 1.0) & F.col("score").between(0.0, 1.0)
    return scored.select("event_id", "features", "label", sound.alias("sound"))


# A label that one split can tell: two levels of land cover.
PLANTED_LEVELS = LAND_COVER[:2]
PLANTED_FEATURES = ("land_cover", "slope_deg")


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold scores for the planted label."""

    def make():
        label = F.col("land_cover").isin(*PLANTED_LEVELS).cast("int")
        folded = _folded(spark, sf_dir).withColumn(LABEL, label)
        scores = validation.out_of_fold(
            folded,
            "event_id",
            [*_few_rounds(), learners.forest(QUERY_TREES, QUERY_DEPTH)],
            features=PLANTED_FEATURES,
            parallelism=fold_ops.FOLDS,
        )
        return store(scores, "planted")

    return _once(spark, sf_dir, "planted", make)


@query
def planted_out_of_fold(spark, sf_dir):
    """Every learner's class for every event; each must find the planted label."""
    names = {"p_a": "a", "p_b": "b", "p_forest": "forest", "score": "vote"}
    classes = [(F.col(c) >= 0.5).cast("int").alias(n) for c, n in names.items()]
    return _planted(spark, sf_dir).select("event_id", "fold", LABEL, *classes)


@query
def planted_comparison(spark, sf_dir):
    names = {"p_a": "a", "p_b": "b", "p_forest": "forest", "score": "vote"}
    long = profile.to_long(_planted(spark, sf_dir), names, LABEL)
    out = profile.model_comparison(long, LABEL, {"vote": VOTE_WEIGHTS})
    return _rounded(out.select("model", "roc_auc", "pr_auc"), "roc_auc", "pr_auc")


@query
def stream_checked(spark, sf_dir):
    """What the stream says of every record, its score left out."""
    return _streamed(spark, sf_dir).select(
        "record", "status", F.array_join("errors", ",").alias("errors"),
        F.col("risk_probability").isNotNull().alias("scored"),
    )


class _Interrupted(TwoOutputs):
    """Breaks off in its second batch, between the two tables."""

    def write_table(self, rows, table, batch):
        if (table, batch) == ("quarantine", 1):
            raise InterruptedError("stopped between two tables")
        super().write_table(rows, table, batch)


# Files of the inbox grow in number, not in size; three batches take them all.
INBOX_BATCHES, INBOX_RECORDS = 3, 200_000


def _write_inbox(records: DataFrame, path: str) -> int:
    """Records as files of about ``INBOX_RECORDS`` at most; how many files make a batch."""
    in_batch = max(1, -(-records.count() // (INBOX_BATCHES * INBOX_RECORDS)))
    records.repartition(INBOX_BATCHES * in_batch).write.text(path)
    return in_batch


@query
def stream_two_outputs(spark, sf_dir):
    """Every record by table, after a stream that broke off between its tables and went on."""

    def make():
        inbox, out, log = (scratch_path(spark, n) for n in ("inbox", "two-outputs", "two-outputs-log"))
        in_batch = _write_inbox(view(spark, sf_dir, "records").select("record"), inbox)
        scored = score_stream(_model(spark, sf_dir), read_record_stream(spark, inbox, files_per_trigger=in_batch))
        try:
            _Interrupted(out, log).start(scored, once=True).awaitTermination()
        except StreamingQueryException as stopped:
            if "stopped between two tables" not in str(stopped):
                raise
        outputs = TwoOutputs(out, log)
        outputs.start(scored, once=True).awaitTermination()
        return outputs

    outputs = _once(spark, sf_dir, "two-outputs", make)
    valid, bad = (outputs.read(spark, t) for t in ("valid", "quarantine"))
    return valid.select(
        "record", F.lit("valid").alias("status"), F.lit("").alias("errors"), F.col("risk_probability").isNotNull().alias("scored")
    ).unionByName(
        bad.select("record", F.lit("quarantine").alias("status"), F.array_join("errors", ",").alias("errors"), F.lit(False).alias("scored"))
    )


@query
def permutation_ranks(spark, sf_dir):
    """Of a model of a planted label: rows scored per shuffled feature, and whether its loss is that of the planted one."""
    features = ("slope_deg", "land_cover", "ndvi", "curvature")
    rows = _observations(spark, sf_dir).withColumn(LABEL, F.col("land_cover").isin(*PLANTED_LEVELS).cast("int"))
    model = _once(
        spark, sf_dir, "planted-model", lambda: fit(rows, "event_id", [learners.boosted_a(2)], features=features)
    )
    found = importance.permutation_importance(model, rows, "event_id", LABEL)
    first = F.col("auc_drop") == F.max("auc_drop").over(Window.partitionBy(F.lit(0)))
    return found.select("feature", "rows", (first & (F.col("auc_drop") > 0.2)).alias("first"))


@query
def scored_heat_layer(spark, sf_dir):
    return heat.heat_layer(_model(spark, sf_dir), _observations(spark, sf_dir))


@query
def scored_heat_totals(spark, sf_dir):
    layer = heat.heat_layer(_model(spark, sf_dir), _observations(spark, sf_dir))
    return layer.groupBy("z").agg(
        F.count(F.lit(1)).alias("tiles"), F.sum("points").alias("points")
    )
