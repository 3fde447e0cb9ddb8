"""Permutation importance: how much a model's ranking loses when one feature is shuffled.

Rows are numbered once in a seeded random order. A feature is shuffled by taking its value
from the row a seeded distance further on, around the end. One join brings every row the
values it is given for all features; all variants of a row are then scored in the same pass
and counted per feature and distinct score before they are shuffled.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoscore.functions.scores import binary_label
from geoscore.operators.ordering import numbered
from geoscore.operators.ranking import rank_metrics
from geoscore.plans.model import SCORE, RiskModel
from geoscore.sources.storage import store

POSITION = "_position"


def shift_of(feature: str, rows: int, seed: int) -> int:
    """The distance a feature's values move: 1 to ``rows`` - 1, and 0 for a single row."""
    return random.Random(f"{seed} {feature}").randrange(1, rows) if rows > 1 else 0


def shuffled_columns(df: DataFrame, row_id: str, features: Sequence[str], seed: int = 42) -> DataFrame:
    """Every row with a struct ``given``: for each feature the value of another row.

    A feature's values as a whole stay the same, NULLs too. Rows that repeat an id keep
    numbers of their own.
    """
    order = [F.xxhash64(F.col(row_id), F.lit(seed)).asc(), F.col(row_id).asc()]
    rows = store(numbered(df, order, POSITION), "positions")
    n = rows.count()
    types = {f: rows.schema[f].dataType for f in features}

    def gift(feature: str):
        position = F.pmod(F.col(POSITION) - F.lit(shift_of(feature, n, seed)), F.lit(max(n, 1)))
        values = [(F.col(f) if f == feature else F.lit(None).cast(types[f])).alias(f) for f in features]
        return F.struct(position.alias(POSITION), *values)

    gifts = rows.select(F.explode(F.array(*map(gift, features))).alias("g")).select("g.*")
    # One value, or NULL, per row and feature.
    given = gifts.groupBy(POSITION).agg(F.struct(*[F.max(f).alias(f) for f in features]).alias("given"))
    return rows.join(given, POSITION).drop(POSITION)


def permutation_importance(
    model: RiskModel, df: DataFrame, row_id: str, label: str, score: str = SCORE, seed: int = 42
) -> DataFrame:
    """``feature, rows, roc_auc, auc_drop, ap_drop``: one row per feature of the model.

    ``roc_auc`` is that of the scores with this feature shuffled; the drops are against
    the scores of the rows as they are (NULL for the AUC when a class is absent).
    """
    features = list(model.features)
    rows = shuffled_columns(
        df.select(row_id, *features, binary_label(label).alias("_y")), row_id, features, seed
    )

    def variant(shuffled: str | None):
        values = [(F.col("given")[f] if f == shuffled else F.col(f)).alias(f) for f in features]
        return F.struct(F.lit(shuffled or "").alias("feature"), *values)

    variants = rows.select("_y", F.explode(F.array(*map(variant, [None, *features]))).alias("v"))
    scored = model.transform(variants.select("_y", "v.*"))
    ranks = rank_metrics(scored, score, "_y", by=["feature"])
    # One row per feature and one for the rows as they are.
    whole = Window.partitionBy(F.lit(0))
    plain = {m: F.max(F.when(F.col("feature") == "", F.col(m))).over(whole) for m in ("roc_auc", "average_precision")}
    return ranks.select(
        "feature",
        (F.col("pos_total") + F.col("neg_total")).alias("rows"),
        "roc_auc",
        (plain["roc_auc"] - F.col("roc_auc")).alias("auc_drop"),
        (plain["average_precision"] - F.col("average_precision")).alias("ap_drop"),
    ).filter(F.col("feature") != "")
