"""The fitted risk model: one encoder, several learners, one vote."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoscore.functions.once import computed_once
from geoscore.functions.scores import (
    binary_label,
    positive_probability,
    required,
    soft_vote,
)
from geoscore.operators.metrics import class_balance
from geoscore.operators.validate import guard_features, require_columns
from geoscore.plans.histograms import Flat
from geoscore.plans.learners import (
    FEATURES_COL,
    LABEL_COL,
    SPREAD_COL,
    Learner,
    encoded_names,
    encoder,
    prepare,
    spread_key,
    stable_layout,
)
from geoscore.plans.training import fit_learners, read_model, scorer
from geoscore.schema import FEATURES, LABEL
from geoscore.sources.storage import drop, enable_checkpoints, exists

SCORE = "score"
ROW = "_scored_row"
MANY = "_probabilities"


def _balance(df: DataFrame, label: str) -> tuple[int, float | None]:
    """Row count and class ratio: one aggregate row, read back by the driver."""
    row = class_balance(df, label).first()
    return row["neg_rows"] + row["pos_rows"], row["pos_weight"]


def positive_weight(df: DataFrame, label: str = LABEL) -> float:
    """Negative-to-positive ratio of a table."""
    _, ratio = _balance(df, label)
    if ratio is None:
        raise ValueError("no positive rows: the class weight is undefined")
    return ratio


@dataclass(frozen=True, eq=False)
class FittedLearner:
    """``flat`` holds the nodes of a large ensemble, which numpy scores a tree at a time."""

    name: str
    kind: str
    vote: float
    model: object
    flat: Flat | None = None


@dataclass(frozen=True)
class RiskModel:
    """Scores any frame that has the features; every other column passes through."""

    encoder: PipelineModel
    learners: tuple[FittedLearner, ...]
    features: tuple[str, ...] = FEATURES
    missing_indicators: bool = False

    @property
    def votes(self) -> dict[str, float]:
        return {f"p_{m.name}": m.vote for m in self.learners if m.vote > 0}

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``p_<learner>`` per learner and, if any of them votes, ``score``.

        A column that has one of these names already is replaced; every other column
        passes through, whatever it is called.
        """
        require_columns(df, self.features)
        # The row travels in one column, apart from all that encoding and scoring add.
        rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW), *self.features)
        scored = self.encoder.transform(prepare(rows, self.features, self.missing_indicators))
        large = [m for m in self.learners if m.flat is not None]
        if large:
            probabilities = scorer(df.sparkSession, [m.flat for m in large])
            scored = scored.withColumn(MANY, probabilities(vector_to_array(FEATURES_COL)))
        for fitted in self.learners:
            if fitted.flat is not None:
                continue
            model = fitted.model.copy()
            model.setRawPredictionCol("").setPredictionCol("")
            model.setProbabilityCol(f"_probability_{fitted.name}")
            scored = model.transform(scored)
        outputs = [f"p_{m.name}" for m in self.learners]
        probabilities = [
            (positive_probability(f"_probability_{m.name}") if m.flat is None else F.col(MANY)[large.index(m)]).alias(f"p_{m.name}")
            for m in self.learners
        ]
        added = {*outputs, SCORE} if self.votes else set(outputs)
        kept = [F.col(ROW)[c].alias(c) for c in df.columns if c not in added]
        out = computed_once(scored.select(*kept, *probabilities), outputs)
        return out.withColumn(SCORE, soft_vote(self.votes)) if self.votes else out

    def feature_importance(self, spark: SparkSession, learner: str) -> DataFrame:
        """``feature, importance`` of one learner; importances sum to 1."""
        fitted = {m.name: m for m in self.learners}[learner]
        weights = fitted.model.featureImportances.toArray()
        rows = [(n, float(w)) for n, w in zip(encoded_names(self.encoder), weights, strict=True)]
        return spark.createDataFrame(rows, "feature string, importance double")

    def write_version(self, path: str) -> str:
        """Encoder and learners in a folder of their own below ``path``, which nobody reads yet."""
        version = uuid.uuid4().hex
        self.encoder.write().save(f"{path}/versions/{version}/encoder")
        for fitted in self.learners:
            fitted.model.write().save(f"{path}/versions/{version}/learners/{fitted.name}")
        return version

    def save(self, path: str) -> None:
        """A new version below ``path``; readers see it once its manifest, written last, is there.

        A save that breaks off leaves the version before readable. That one stays for
        readers still at work; older ones are deleted.
        """
        spark = SparkSession.active()
        version = self.write_version(path)
        before = _saved(spark, path)
        number = 1 + max((r["saved"] for r in before), default=0)
        manifest = [
            (number, version, i, m.name, m.kind, float(m.vote), list(self.features), self.missing_indicators)
            for i, m in enumerate(self.learners)
        ]
        # One file, so that its commit is one rename.
        spark.createDataFrame(manifest, _MANIFEST).coalesce(1).write.mode("append").json(f"{path}/manifest")
        latest = max((r["saved"] for r in before), default=0)
        drop(spark, {f"{path}/versions/{r['version']}" for r in before if r["saved"] < latest})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RiskModel:
        found = _saved(spark, path)
        if not found:
            raise FileNotFoundError(f"no model was saved at {path}")
        last = max((r["saved"], r["version"]) for r in found)
        rows = sorted((r for r in found if (r["saved"], r["version"]) == last), key=lambda r: r["position"])
        at = f"{path}/versions/{last[1]}"
        learners = tuple(
            FittedLearner(r["name"], r["kind"], r["vote"], *read_model(spark, r["kind"], f"{at}/learners/{r['name']}"))
            for r in rows
        )
        return cls(
            PipelineModel.load(f"{at}/encoder"),
            learners,
            tuple(rows[0]["features"]),
            rows[0]["missing_indicators"],
        )


def _saved(spark: SparkSession, path: str) -> list:
    """Manifest rows of all saves, a few for each."""
    if not exists(spark, f"{path}/manifest"):
        return []
    return spark.read.schema(_MANIFEST).json(f"{path}/manifest").collect()


_MANIFEST = T.StructType(
    [
        T.StructField("saved", T.LongType()),
        T.StructField("version", T.StringType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("vote", T.DoubleType()),
        T.StructField("features", T.ArrayType(T.StringType())),
        T.StructField("missing_indicators", T.BooleanType()),
    ]
)


def fit(
    df: DataFrame,
    row_id: str,
    learners: Sequence[Learner],
    label: str = LABEL,
    pos_weight: float | None = None,
    features: Sequence[str] = FEATURES,
    missing_indicators: bool = False,
    fitted_encoder: PipelineModel | None = None,
) -> RiskModel:
    """Fit the encoder, then every learner on the same encoded rows.

    ``pos_weight`` defaults to the class ratio of ``df``. Rows are first laid out
    by content, so equal seeds give equal trees. An encoder fitted on the same rows
    before may be given; the learners of both fits then share it.
    """
    guard_features(features)
    require_columns(df, features)
    enable_checkpoints(df.sparkSession)
    count, ratio = _balance(df, label)
    if pos_weight is None and ratio is None:
        raise ValueError("no positive rows: the class weight is undefined")
    pos_weight = ratio if pos_weight is None else pos_weight
    id_type = df.schema[row_id].dataType.simpleString()
    rows = prepare(
        df.select(
            required(row_id, f"{row_id} is NULL", id_type).alias(row_id),
            *features,
            binary_label(label).cast("double").alias(LABEL_COL),
        ),
        features,
        missing_indicators,
    ).select("*", spread_key([row_id, *features, LABEL_COL]))
    if fitted_encoder is None:
        fitted_encoder = encoder(features, missing_indicators=missing_indicators).fit(rows)
    encoded = fitted_encoder.transform(rows).select(
        row_id, SPREAD_COL, FEATURES_COL, LABEL_COL
    )
    encoded = stable_layout(encoded, row_id, count)
    # Packed once for all learners.
    models = fit_learners(encoded, fitted_encoder, learners, pos_weight, count)
    fitted = tuple(FittedLearner(m.name, m.kind, m.vote, *model) for m, model in zip(learners, models))
    return RiskModel(fitted_encoder, fitted, tuple(features), missing_indicators)


def importance_ranking(importance: DataFrame, top: int | None = None) -> DataFrame:
    """Importances in descending order, all of them or the ``top`` ones."""
    ranked = importance.orderBy(F.desc("importance"), "feature")
    return ranked if top is None else ranked.limit(top)
