"""Score density on Web-Mercator tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoscore.functions.scores import required, required_score
from geoscore.functions.spatial import tile_x, tile_y

# The zoom the map opens at and the deepest zoom it draws.
ZOOM_LOW, ZOOM_HIGH = 6, 9


def point_layer(df: DataFrame, latitude: str, longitude: str, score: str) -> DataFrame:
    """``latitude, longitude, score`` as doubles."""
    return df.select(
        F.col(latitude).cast("double").alias("latitude"),
        F.col(longitude).cast("double").alias("longitude"),
        F.col(score).cast("double").alias("score"),
    )


def _tile_stats(grouped) -> DataFrame:
    return grouped.agg(
        F.sum("points").alias("points"),
        F.sum("score_sum").alias("score_sum"),
        F.max("score_max").alias("score_max"),
    ).withColumn("score_avg", F.try_divide(F.col("score_sum"), F.col("points").cast("double")))


def heat_tiles(points: DataFrame, zoom: int = ZOOM_HIGH) -> DataFrame:
    """Point count and score sum, mean and maximum per tile of one zoom.

    Sums combine on the map side, so a tile holding most points costs one row per task.
    """
    located = points.select(
        F.lit(zoom).alias("z"),
        required(tile_x("longitude", zoom), "longitude is NULL or NaN", "bigint").alias("x"),
        required(tile_y("latitude", zoom), "latitude is NULL or NaN", "bigint").alias("y"),
        F.lit(1).cast("bigint").alias("points"),
        required_score("score").alias("score_sum"),
        required_score("score").alias("score_max"),
    )
    return _tile_stats(located.groupBy("z", "x", "y"))


def roll_up(tiles: DataFrame, lowest: int = ZOOM_LOW) -> DataFrame:
    """The given tiles and every coarser zoom down to ``lowest``, from sums, not from means.

    Works on the tile table, never on points again.
    """
    steps = F.explode(F.sequence(F.lit(0), F.col("z") - F.lit(lowest)))
    coarser = tiles.select("*", steps.alias("_up")).select(
        (F.col("z") - F.col("_up")).alias("z"),
        F.expr("shiftright(x, _up)").alias("x"),
        F.expr("shiftright(y, _up)").alias("y"),
        "points",
        "score_sum",
        "score_max",
    )
    return _tile_stats(coarser.groupBy("z", "x", "y"))
