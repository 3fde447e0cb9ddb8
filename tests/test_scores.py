import math

import pytest
from pyspark.sql import functions as F

from geoscore.functions import scores
from geoscore.functions.spatial import grid_cell, grid_cell_bound, tile_x, tile_y


def values(spark, column, rows, schema="v double"):
    frame = spark.createDataFrame([(r,) for r in rows], schema)
    return [r[0] for r in frame.select(column).collect()]


def test_band_edges_go_up(spark):
    rows = [0.0, 0.2499999, 0.25, 0.4999999, 0.5, 0.7499999, 0.75, 1.0, None, math.nan, -0.1]
    assert values(spark, scores.risk_band("v"), rows) == [
        "LOW",
        "LOW",
        "MODERATE",
        "MODERATE",
        "HIGH",
        "HIGH",
        "CRITICAL",
        "CRITICAL",
        None,
        None,
        "LOW",
    ]


def test_band_is_taken_before_rounding(spark):
    frame = spark.createDataFrame([(0.24999999,)], "v double")
    row = frame.select(scores.round_score("v").alias("p"), scores.risk_band("v").alias("b")).first()
    assert (row.p, row.b) == (0.25, "LOW")


def test_rounding_halves_up_on_decimal_text(spark):
    assert values(spark, scores.round_score("v"), [0.1234565, 5e-7, 0.1234564, None]) == [
        0.123457,
        1e-6,
        0.123456,
        None,
    ]


def test_vote_normalises_weights(spark):
    frame = spark.createDataFrame([(0.2, 0.6)], "a double, b double")
    assert frame.select(scores.soft_vote({"a": 0.3, "b": 0.7})).first()[0] == pytest.approx(0.48)
    assert frame.select(scores.soft_vote({"a": 3, "b": 7})).first()[0] == pytest.approx(0.48)
    assert frame.select(scores.soft_vote({"a": 1})).first()[0] == 0.2


@pytest.mark.parametrize("weights", [{}, {"a": 0.0}, {"a": -1.0, "b": 2.0}])
def test_vote_refuses_bad_weights(weights):
    with pytest.raises(ValueError):
        scores.soft_vote(weights)


def test_threshold_is_inclusive(spark):
    assert values(spark, scores.at_or_above("v", 0.18), [0.18, 0.1799999, None]) == [1, 0, None]


def test_class_weight(spark):
    assert values(spark, scores.class_weight("v", 3.0), [1, 0], "v int") == [3.0, 1.0]


@pytest.mark.parametrize("bad", [None, 2])
def test_label_must_be_binary(spark, bad):
    frame = spark.createDataFrame([(bad,)], "v int")
    with pytest.raises(Exception, match="label is not 0 or 1"):
        frame.select(scores.binary_label("v")).collect()


@pytest.mark.parametrize("bad", [None, math.nan])
def test_ranked_scores_must_be_numbers(spark, bad):
    frame = spark.createDataFrame([(bad,)], "v double")
    with pytest.raises(Exception, match="score is NULL or NaN"):
        frame.select(scores.required_score("v")).collect()


def test_grid_cells_floor_downwards(spark):
    frame = spark.createDataFrame(
        [(26.3, 92.5), (-0.1, -0.6), (0.0, 0.0), (None, 1.0)], "lat double, lon double"
    )
    cells = [r[0] for r in frame.select(grid_cell("lat", "lon")).collect()]
    assert cells == ["52_185", "-1_-2", "0_0", None]
    assert grid_cell_bound(2) == 361 * 1441


def test_tiles_match_the_closed_form(spark):
    points = [(26.3, 92.5), (-33.9, 151.2), (0.0, 0.0), (89.9, 180.0), (-89.9, -180.0)]
    frame = spark.createDataFrame(points, "lat double, lon double")
    for zoom in (0, 6, 9):
        n = 2**zoom
        got = frame.select(tile_x("lon", zoom), tile_y("lat", zoom)).collect()
        for (lat, lon), tile in zip(points, got):
            lat = max(-85.0511, min(85.0511, lat))
            x = min(n - 1, int((lon + 180) / 360 * n))
            rad = math.radians(lat)
            y = int((1 - math.log(math.tan(rad) + 1 / math.cos(rad)) / math.pi) / 2 * n)
            assert tuple(tile) == (x, min(max(y, 0), n - 1))


def test_tiles_of_missing_coordinates(spark):
    frame = spark.createDataFrame([(None, math.nan)], "lat double, lon double")
    assert tuple(frame.select(tile_x("lon", 9), tile_y("lat", 9)).first()) == (None, None)


def test_positive_probability(spark):
    from pyspark.ml.linalg import Vectors

    frame = spark.createDataFrame([(Vectors.dense(0.25, 0.75),)], ["probability"])
    assert frame.select(scores.positive_probability("probability")).first()[0] == 0.75
    assert frame.select(F.round(scores.positive_probability("probability"), 2)).count() == 1
