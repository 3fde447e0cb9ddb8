"""Learner and encoder declarations on Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import (
    Imputer,
    OneHotEncoder,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoscore.operators.folds import SEED
from geoscore.schema import CATEGORICAL, FEATURES

# Boosting rounds, step sizes, tree depth, row and column shares, leaf size.
ROUNDS = 500
STEP_A, STEP_B = 0.04, 0.03
DEPTH = 5
ROW_SHARE_A, ROW_SHARE_B = 0.85, 1.0
COLUMN_SHARE = "0.85"
LEAF_ROWS_A, LEAF_ROWS_B = 2, 20

# Split candidates per feature, from order statistics of all rows.
MAX_BINS = 256
# Relative error of the median that missing numbers take.
MEDIAN_ERROR = 0.001

# Rows per training task: few while that only adds parallelism, then as many as fit in memory.
LAYOUT_FEW_ROWS, LAYOUT_SPREAD, LAYOUT_MOST_ROWS = 10_000, 2_000, 2_000_000
# Tasks of a fit's layout, until they hold so many rows.
FIT_TASKS, FIT_ROWS = 48, 1_000_000

FEATURES_COL, LABEL_COL, WEIGHT_COL = "features", "label", "weight"
MODEL_CLASSES = {"boosted": GBTClassificationModel, "forest": RandomForestClassificationModel}


@dataclass(frozen=True)
class Learner:
    """A named classifier and its share of the vote (0 = scored, not voting)."""

    name: str
    kind: str
    estimator: object
    vote: float = 0.0


def _boosted(rounds: int, seed: int, max_bins: int, **params) -> GBTClassifier:
    return GBTClassifier(
        featuresCol=FEATURES_COL,
        labelCol=LABEL_COL,
        weightCol=WEIGHT_COL,
        lossType="logistic",
        maxIter=rounds,
        maxDepth=DEPTH,
        maxBins=max_bins,
        featureSubsetStrategy=COLUMN_SHARE,
        seed=seed,
        # Long boosting runs cut their lineage in the shared checkpoint folder.
        checkpointInterval=10,
        **params,
    )


def boosted_a(
    rounds: int = ROUNDS, vote: float = 0.30, seed: int = SEED, max_bins: int = MAX_BINS
) -> Learner:
    """Row-sampled boosted trees. Spark ML has no L1/L2 leaf penalty; none is applied."""
    estimator = _boosted(
        rounds,
        seed,
        max_bins,
        stepSize=STEP_A,
        subsamplingRate=ROW_SHARE_A,
        minInstancesPerNode=LEAF_ROWS_A,
    )
    return Learner("a", "boosted", estimator, vote)


def boosted_b(
    rounds: int = ROUNDS, vote: float = 0.70, seed: int = SEED, max_bins: int = MAX_BINS
) -> Learner:
    """Boosted trees on all rows; depth 5 gives 32 leaves, as many as a 31-leaf tree needs."""
    estimator = _boosted(
        rounds,
        seed,
        max_bins,
        stepSize=STEP_B,
        subsamplingRate=ROW_SHARE_B,
        minInstancesPerNode=LEAF_ROWS_B,
    )
    return Learner("b", "boosted", estimator, vote)


def forest(
    trees: int = 100, depth: int = 10, seed: int = SEED, max_bins: int = MAX_BINS
) -> Learner:
    """Random-forest candidate; compared, without a vote."""
    estimator = RandomForestClassifier(
        featuresCol=FEATURES_COL,
        labelCol=LABEL_COL,
        weightCol=WEIGHT_COL,
        numTrees=trees,
        maxDepth=depth,
        maxBins=max_bins,
        seed=seed,
    )
    return Learner("forest", "forest", estimator)


def encoder(
    features: Sequence[str] = FEATURES,
    categorical: Sequence[str] = CATEGORICAL,
    missing_indicators: bool = False,
) -> Pipeline:
    """Indicators for text features first, then the numbers, as one vector.

    Unknown and NULL levels get no indicator. Missing numbers take the training
    median, since Spark's trees accept neither NULL nor NaN; ``missing_indicators``
    lets the trees see which ones were missing.
    """
    cats = [name for name in features if name in categorical]
    numbers = [name for name in features if name not in categorical]
    stages: list = []
    if cats:
        index = [f"index__{name}" for name in cats]
        onehot = [f"cat__{name}" for name in cats]
        stages.append(
            StringIndexer(
                inputCols=cats,
                outputCols=index,
                handleInvalid="keep",
                stringOrderType="alphabetAsc",
            )
        )
        stages.append(OneHotEncoder(inputCols=index, outputCols=onehot, dropLast=True))
    else:
        onehot = []
    filled = [f"remainder__{name}" for name in numbers]
    if numbers:
        stages.append(
            Imputer(
                inputCols=numbers, outputCols=filled, strategy="median", relativeError=MEDIAN_ERROR
            )
        )
    flags = [f"missing__{name}" for name in numbers] if missing_indicators else []
    stages.append(VectorAssembler(inputCols=[*onehot, *filled, *flags], outputCol=FEATURES_COL))
    return Pipeline(stages=stages)


def prepare(df: DataFrame, features: Sequence[str] = FEATURES, indicators: bool = False) -> DataFrame:
    """Missing-number flags, needed before an encoder that uses them."""
    if not indicators:
        return df
    numbers = [name for name in features if name not in CATEGORICAL]
    flags = [
        (F.col(n).isNull() | F.isnan(n)).cast("double").alias(f"missing__{n}") for n in numbers
    ]
    return df.select("*", *flags)


def encoded_names(fitted: PipelineModel) -> list[str]:
    """Name of each position of the encoded vector."""
    names: list[str] = []
    levels: dict[str, list[str]] = {}
    for stage in fitted.stages:
        if isinstance(stage, StringIndexerModel):
            levels = dict(zip(stage.getInputCols(), stage.labelsArray))
    for column in fitted.stages[-1].getInputCols():
        base = column.removeprefix("cat__")
        if column.startswith("cat__") and base in levels:
            names += [f"{column}_{level}" for level in levels[base]]
        else:
            names.append(column)
    return names


def layout_tasks(rows: int) -> int:
    """Training tasks for a row count: small ones at first, then at most LAYOUT_MOST_ROWS each."""
    spread = min(-(-rows // LAYOUT_FEW_ROWS), LAYOUT_SPREAD)
    return max(1, spread, -(-rows // LAYOUT_MOST_ROWS))


def fit_tasks(rows: int) -> int:
    """Tasks of a fit: those of ``layout_tasks``, but no more than a fixed number or a share of the rows."""
    return min(layout_tasks(rows), max(FIT_TASKS, -(-rows // FIT_ROWS)))


SPREAD_COL = "_spread"


def spread_key(columns: Sequence[str]) -> Column:
    """Hash of a row's id and content: even over tasks even where an id repeats a lot."""
    return F.xxhash64(*columns).alias(SPREAD_COL)


def stable_layout(df: DataFrame, row_id: str, rows: int) -> DataFrame:
    """Rows in a layout that depends on their content and number alone.

    Seeded sampling follows the layout, so equal data then gives equal trees on
    any cluster, whatever its shuffle settings.
    """
    return df.repartition(fit_tasks(rows), SPREAD_COL).sortWithinPartitions(SPREAD_COL, row_id)
