"""Training report: evaluate, refit, save and write every report table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoscore.functions.scores import BAND_EDGES
from geoscore.functions.spatial import CELLS_PER_DEGREE
from geoscore.operators.folds import FOLDS, SEED, assign_spatial_folds
from geoscore.operators.metrics import best_threshold, confusion_matrix, curve_of_counts, gather
from geoscore.operators.profile import (
    comparison_of_counts,
    dataset_profile,
    record_of_counts,
    to_long,
)
from geoscore.operators.ranking import distinct_scores
from geoscore.operators.validate import require_columns
from geoscore.plans.learners import Learner
from geoscore.plans.model import SCORE, RiskModel, fit, importance_ranking
from geoscore.plans.validation import out_of_fold
from geoscore.schema import (
    EXCLUDED,
    FEATURES,
    LABEL,
    LATITUDE,
    LONGITUDE,
    METRICS_COLUMNS,
    THRESHOLD_CURVE_COLUMNS,
)
from geoscore.sources.sinks import write_record, write_report
from geoscore.sources.storage import drop, recorded, store

VOTE = "vote"


@dataclass(frozen=True)
class Evaluation:
    """A fitted model and the tables that describe it."""

    model: RiskModel
    out_of_fold: DataFrame
    metrics: DataFrame
    curve: DataFrame
    comparison: DataFrame
    importance: DataFrame
    report: DataFrame
    #: Tables in the shared folder that the frames above read.
    stored: list[str] = field(default_factory=list)

    def close(self) -> None:
        """Deletes those tables; the model stays usable."""
        drop(self.metrics.sparkSession, self.stored)

    def write(self, path: str) -> None:
        write_record(self.metrics, f"{path}/metrics")
        write_record(self.report, f"{path}/report")
        write_report(self.curve, f"{path}/threshold_analysis", ["threshold"])
        write_report(self.comparison, f"{path}/model_comparison", ["model"])
        write_report(
            self.importance, f"{path}/feature_importance", [F.desc("importance"), "feature"]
        )


def run_report(
    oof: DataFrame,
    observations: DataFrame,
    votes: dict[str, float],
    label: str = LABEL,
    state: str = "state",
    source: str = "source",
    folds: int = FOLDS,
    project: str | None = None,
    limitations: Sequence[str] = (),
    counts: DataFrame | None = None,
) -> DataFrame:
    """One nested row: model, dataset and validation facts, features and bands.

    ``project`` and ``limitations`` are the author's own words, carried along.
    ``counts`` are the vote's distinct scores, if they are stored already.
    """
    if counts is None:
        counts = store(distinct_scores(oof, SCORE, label), "distinct-scores")
    curve = curve_of_counts(counts)
    best = record_of_counts(counts)
    recall_first = best_threshold(curve, "f2").select(
        F.col("threshold").alias("high_recall_f2_threshold"),
        F.col("f2").alias("high_recall_f2"),
        F.col("precision").alias("high_recall_precision"),
        F.col("recall").alias("high_recall_recall"),
    )
    matrix = confusion_matrix(best_threshold(curve, "f1"))
    facts = gather(
        [best, recall_first, matrix, dataset_profile(observations, label, state, source)]
    )
    bands = []
    edges = [*[low for _, low in BAND_EDGES], 1.0]
    for (name, low), high in zip(BAND_EDGES, edges[1:]):
        bands += [F.lit(name), F.array(F.lit(low), F.lit(high))]
    return facts.select(
        F.lit(project).cast("string").alias("project"),
        F.struct(
            *[F.lit(w).alias(f"{name.removeprefix('p_')}_weight") for name, w in votes.items()],
            "roc_auc",
            "pr_auc",
            "threshold",
            "f1",
            "f2",
            "precision",
            "recall",
        ).alias("model"),
        F.struct(
            "rows", "positive_rows", "negative_rows", "source_rows", "states_present"
        ).alias("dataset"),
        F.struct(
            F.lit(f"{folds}-fold stratified grouped").alias("method"),
            F.lit(f"{1 / CELLS_PER_DEGREE} degree latitude/longitude cells").alias("grouping"),
            "confusion_matrix",
            "high_recall_f2_threshold",
            "high_recall_f2",
            "high_recall_precision",
            "high_recall_recall",
        ).alias("validation"),
        F.array(*[F.lit(n) for n in FEATURES]).alias("features"),
        F.array(*[F.lit(n) for n in EXCLUDED]).alias("excluded_from_training"),
        F.create_map(*bands).alias("risk_bands"),
        F.array(*[F.lit(text) for text in limitations]).cast("array<string>").alias("limitations"),
    )


def train_and_evaluate(
    observations: DataFrame,
    row_id: str,
    learners: Sequence[Learner],
    label: str = LABEL,
    folds: int = FOLDS,
    seed: int | None = SEED,
    importance_of: str | None = None,
    parallelism: int = 2,
    project: str | None = None,
    limitations: Sequence[str] = (),
) -> Evaluation:
    """Folds, out-of-fold scores, metrics and reports, then the final fit on all rows.

    The columns that are needed are stored first, so that a text source is parsed
    once and not by every fit. ``close()`` the result when its tables are written.
    """
    spark = observations.sparkSession
    needed = [row_id, label, LATITUDE, LONGITUDE, "state", "source", *FEATURES]
    with recorded() as stored:
        observations = store(
            require_columns(observations, needed).select(*dict.fromkeys(needed)), "observations"
        )
        folded = assign_spatial_folds(observations, LATITUDE, LONGITUDE, label, folds, seed)
        oof = store(
            out_of_fold(folded, row_id, learners, label, folds, parallelism=parallelism), "oof"
        )
        model = fit(observations, row_id, learners, label)
        names = {f"p_{m.name}": m.name for m in learners} | {SCORE: VOTE}
        shares = {m.name: m.vote for m in learners if m.vote > 0}
        # Every model's distinct scores, from one pass; all metrics below read them.
        counts = store(distinct_scores(to_long(oof, names, label), "score", label, ["model"]), "scores")
        vote = counts.filter(F.col("model") == VOTE).drop("model")
        return Evaluation(
            model=model,
            out_of_fold=oof,
            metrics=record_of_counts(vote).select(*METRICS_COLUMNS),
            curve=curve_of_counts(vote).select(*THRESHOLD_CURVE_COLUMNS),
            comparison=comparison_of_counts(counts, {VOTE: shares}),
            importance=importance_ranking(
                model.feature_importance(spark, importance_of or learners[0].name)
            ),
            report=run_report(
                oof,
                observations,
                model.votes,
                label,
                folds=folds,
                project=project,
                limitations=limitations,
                counts=vote,
            ),
            stored=stored,
        )
