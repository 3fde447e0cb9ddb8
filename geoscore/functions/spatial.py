"""Location columns: degree-grid cells and Web-Mercator tiles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: cells per degree of the spatial group key (0.5 degree blocks).
CELLS_PER_DEGREE = 2
# Fixed value: latitude limit of the square Web-Mercator map.
MERCATOR_LATITUDE = 85.0511


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def grid_index(degrees: Column | str, cells_per_degree: int = CELLS_PER_DEGREE) -> Column:
    """Row or column number of the degree grid; negative degrees go down."""
    return F.floor(_col(degrees) * F.lit(float(cells_per_degree)))


def grid_cell(
    latitude: Column | str, longitude: Column | str, cells_per_degree: int = CELLS_PER_DEGREE
) -> Column:
    """Cell key ``<row>_<column>``; NULL when either coordinate is NULL."""
    return F.concat(
        grid_index(latitude, cells_per_degree).cast("string"),
        F.lit("_"),
        grid_index(longitude, cells_per_degree).cast("string"),
    )


def grid_cell_bound(cells_per_degree: int = CELLS_PER_DEGREE) -> int:
    """Most cells that coordinates within +-90 and +-360 degrees can fall into."""
    return (180 * cells_per_degree + 1) * (720 * cells_per_degree + 1)


def _tile_index(position: Column, zoom: int, *coordinates: Column) -> Column:
    last = F.lit(2**zoom - 1).cast("bigint")
    index = F.least(F.greatest(F.floor(position).cast("bigint"), F.lit(0).cast("bigint")), last)
    known = F.lit(True)
    for value in coordinates:
        known = known & value.isNotNull() & ~F.isnan(value)
    return F.when(known, index)


def tile_x(longitude: Column | str, zoom: int) -> Column:
    """Tile column at ``zoom``; the antimeridian itself belongs to the last tile."""
    lon = _col(longitude)
    position = (lon + F.lit(180.0)) / F.lit(360.0) * F.lit(float(2**zoom))
    return _tile_index(position, zoom, lon)


def tile_y(latitude: Column | str, zoom: int) -> Column:
    """Tile row at ``zoom``, counted from the north; polar latitudes are clamped."""
    lat = _col(latitude)
    clamped = F.least(F.greatest(lat, F.lit(-MERCATOR_LATITUDE)), F.lit(MERCATOR_LATITUDE))
    rad = F.radians(clamped)
    north = F.log(F.tan(rad) + F.lit(1.0) / F.cos(rad)) / F.lit(math.pi)
    position = (F.lit(1.0) - north) / F.lit(2.0) * F.lit(float(2**zoom))
    return _tile_index(position, zoom, lat)
