"""Score columns: bands, rounding, votes and threshold flags."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower edge of each band; a score on an edge belongs to the band above it.
BAND_EDGES = (
    ("LOW", 0.0),
    ("MODERATE", 0.25),
    ("HIGH", 0.50),
    ("CRITICAL", 0.75),
)
# Fixed value: decimals of a served score.
SCORE_DECIMALS = 6
# Vote shares of the two boosted learners.
VOTE_WEIGHTS = {"a": 0.30, "b": 0.70}


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def risk_band(score: Column | str) -> Column:
    """Band name of an unrounded score; NULL and NaN have no band."""
    score = _col(score)
    band = F.when(score.isNull() | F.isnan(score), F.lit(None).cast("string"))
    for (name, _), (_, upper) in zip(BAND_EDGES, BAND_EDGES[1:]):
        band = band.when(score < F.lit(upper), F.lit(name))
    return band.otherwise(F.lit(BAND_EDGES[-1][0]))


def round_score(score: Column | str, decimals: int = SCORE_DECIMALS) -> Column:
    """Score as served; halves round up on the decimal text."""
    return F.round(_col(score), decimals)


def at_or_above(score: Column | str, threshold: float | Column) -> Column:
    """1 when the score reaches the threshold (inclusive), else 0."""
    return (_col(score) >= threshold).cast("int")


def soft_vote(weights: Mapping[str, float]) -> Column:
    """Weighted mean of score columns, ``{column: weight}``, normalised by the weight sum."""
    if not weights:
        raise ValueError("soft_vote needs at least one score column")
    total = float(sum(weights.values()))
    if total <= 0 or any(w < 0 for w in weights.values()):
        raise ValueError(f"vote weights must be non-negative with a positive sum: {dict(weights)}")
    parts = [F.lit(float(w)) * F.col(name) for name, w in weights.items()]
    vote = parts[0]
    for part in parts[1:]:
        vote = vote + part
    return vote / F.lit(total)


def positive_probability(probability: Column | str) -> Column:
    """Second entry of a classifier's probability vector."""
    return vector_to_array(_col(probability))[1]


def class_weight(label: Column | str, positive_weight: float | Column) -> Column:
    """Row weight that multiplies positives by the class ratio."""
    weight = positive_weight if isinstance(positive_weight, Column) else F.lit(float(positive_weight))
    return F.when(_col(label) == 1, weight).otherwise(F.lit(1.0))


def _fail(message: str, like: str) -> Column:
    return F.raise_error(F.lit(message)).cast(like)


def required(value: Column | str, message: str, dtype: str = "string") -> Column:
    """The value itself; the query fails with ``message`` where it is NULL."""
    return F.coalesce(_col(value), _fail(message, dtype))


def required_score(score: Column | str) -> Column:
    """A score fit for ranking; NULL or NaN fails the query instead of dropping the row."""
    fail = _fail("score is NULL or NaN", "double")
    return F.coalesce(F.nanvl(_col(score).cast("double"), fail), fail)


def binary_label(label: Column | str) -> Column:
    """Label as 0/1 integer; NULL or any other value fails the query."""
    label = _col(label).cast("int")
    return F.when(label.isin(0, 1), label).otherwise(F.raise_error(F.lit("label is not 0 or 1")))
