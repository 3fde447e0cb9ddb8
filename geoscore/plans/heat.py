"""Heat layer: score located rows and aggregate them on map tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame

from geoscore.operators.tiles import ZOOM_HIGH, ZOOM_LOW, heat_tiles, point_layer, roll_up
from geoscore.plans.model import SCORE, RiskModel
from geoscore.schema import LATITUDE, LONGITUDE


def heat_points(
    model: RiskModel, df: DataFrame, latitude: str = LATITUDE, longitude: str = LONGITUDE
) -> DataFrame:
    """``latitude, longitude, score`` of every row."""
    return point_layer(model.transform(df), latitude, longitude, SCORE)


def heat_layer(
    model: RiskModel,
    df: DataFrame,
    latitude: str = LATITUDE,
    longitude: str = LONGITUDE,
    lowest: int = ZOOM_LOW,
    highest: int = ZOOM_HIGH,
) -> DataFrame:
    """Tile statistics for every zoom, from one scoring pass."""
    return roll_up(heat_tiles(heat_points(model, df, latitude, longitude), highest), lowest)
