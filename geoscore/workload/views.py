"""Input views derived from the driver's tables.

The tables hold no coordinates, scores or risk labels, so these are computed
from key columns. Each view is a list of ``expression AS name`` texts that Spark
and DuckDB both read, with integer arithmetic and one division per value so that
doubles agree to the bit. Keys are reduced before they are multiplied, which
keeps the products inside BIGINT at any table size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_POSITIVE = "l_returnflag = 'R'"
_LIFT = f"CASE WHEN {_POSITIVE} THEN 600000 ELSE 0 END"


def _probability(part: int, order: int, line: int) -> str:
    mix = (
        f"(l_partkey % 1000000) * {part} + (l_orderkey % 1000000) * {order} + l_linenumber * {line}"
    )
    # The odd divisor keeps scores, their sums and means off decimal halves, where
    # engines round differently.
    return f"CAST(({mix}) % 1000000 + {_LIFT} AS DOUBLE) / 1600001.0e0"


# lineitem rows as scored points; obs_id repeats where the source keys do.
SCORED = {
    "obs_id": "CAST(l_orderkey * 100 + l_linenumber AS BIGINT)",
    "latitude": "20.0e0 + CAST((l_partkey * 37) % 1000 AS DOUBLE) / 100.0e0",
    "longitude": "88.0e0 + CAST((l_suppkey * 53) % 900 AS DOUBLE) / 100.0e0",
    "state": "concat('state_', CAST(l_suppkey % 5 AS STRING))",
    "source": "l_linestatus",
    "label": f"CASE WHEN {_POSITIVE} THEN 1 ELSE 0 END",
    "p_a": _probability(7919, 104729, 31),
    "p_b": _probability(6101, 15485863, 17),
}

_SLOPE = "(o_orderkey % 1000000) * 7919 % 6000"
_RAIN = "((o_orderkey % 1000000) * 6101 + o_custkey % 1000000 * 17) % 20000"
_NOISE = "((o_orderkey % 1000000) * 15485863 + o_custkey % 1000000 * 61) % 3000"
_EVENT = f"10 * ({_SLOPE}) + 3 * ({_RAIN}) + 10 * ({_NOISE}) > 92500"


def _hundredths(text: str) -> str:
    return f"CAST({text} AS DOUBLE) / 100.0e0"


def _pick(index: str, names: tuple[str, ...]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(names))
    return f"CASE {index} {arms} END"


# The levels of the two text features.
LAND_COVER = ("Dense Forest", "Barren/Degraded", "Shrubland", "Open Forest", "Built-up", "Cropland")
SOIL_TYPE = ("Rocky/Skeletal", "Silty Clay", "Clay Loam", "Laterite", "Loam", "Sandy Loam")

# orders rows as observations with the full declared schema; event_id is unique.
OBSERVATIONS = {
    "event_id": "CAST(o_orderkey AS STRING)",
    "state": "concat('state_', CAST(o_custkey % 5 AS STRING))",
    "latitude": "22.0e0 + " + _hundredths("(o_custkey * 37) % 700"),
    "longitude": "88.0e0 + " + _hundredths("(o_custkey * 53) % 900"),
    "monsoon_phase": "CASE WHEN o_orderkey % 12 BETWEEN 5 AND 8 THEN 'monsoon' ELSE 'dry' END",
    "severity_class": "o_orderpriority",
    "is_fatal": "CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END",
    "reliability_score": _hundredths("o_orderkey % 101"),
    "source": f"CASE WHEN NOT ({_EVENT}) THEN 'pseudo_absence'"
    " WHEN o_orderstatus = 'F' THEN 'real_event' ELSE 'augmented' END",
    "elevation_m": _hundredths("(o_custkey % 1000000 * 271 + o_orderkey % 1000000 * 7) % 250000"),
    "slope_deg": _hundredths(_SLOPE),
    "aspect_deg": _hundredths("(o_custkey % 1000000 * 104729 + o_orderkey * 31) % 36000"),
    "curvature": _hundredths("o_orderkey % 400 - 200"),
    "rainfall_24h_mm": _hundredths(_RAIN),
    "rainfall_72h_mm": _hundredths(f"2 * (({_RAIN})) + o_orderkey * 13 % 5000"),
    "rainfall_7d_mm": _hundredths(f"3 * (({_RAIN})) + o_orderkey * 19 % 9000"),
    "land_cover": _pick("o_custkey % 6", LAND_COVER),
    # Some readings are missing, as they are in field data.
    "ndvi": "CASE WHEN o_orderkey % 97 <> 0 THEN "
    + _hundredths("(o_custkey * 37 + o_orderkey) % 100")
    + " END",
    "soil_type": _pick("o_orderkey % 6", SOIL_TYPE),
    "distance_to_river_m": _hundredths("(o_orderkey % 1000000 * 337) % 500000"),
    "distance_to_road_m": _hundredths("(o_custkey % 1000000 * 733 + o_orderkey) % 300000"),
    "landslide": f"CASE WHEN {_EVENT} THEN 1 ELSE 0 END",
}


def _field(name: str, value: str, quoted: bool = False) -> str:
    text = f"CAST({value} AS STRING)"
    parts = f"'\"{name}\":\"', {text}, '\"'" if quoted else f"'\"{name}\":', {text}"
    return f"concat({parts})"


# orders rows as request JSON with every kind of fault a client can send.
_RECORD_FIELDS = (
    f"CASE WHEN o_orderkey % 13 <> 3 THEN {_field('elevation_m', 'o_orderkey % 2500')} END",
    f"CASE WHEN o_orderkey % 17 = 5 THEN {_field('slope_deg', 'o_orderkey % 60', quoted=True)}"
    f" ELSE {_field('slope_deg', 'o_orderkey % 60')} END",
    f"CASE WHEN o_orderkey % 19 = 4 THEN '\"aspect_deg\":\"north\"'"
    f" ELSE {_field('aspect_deg', 'o_custkey % 360')} END",
    "CASE WHEN o_orderkey % 23 = 6 THEN '\"curvature\":null' ELSE '\"curvature\":-0.25' END",
    _field("rainfall_24h_mm", "o_orderkey % 200"),
    f"CASE WHEN o_orderkey % 29 = 8 THEN '\"rainfall_72h_mm\":[1,2]'"
    f" ELSE {_field('rainfall_72h_mm', 'o_orderkey % 500')} END",
    f"CASE WHEN o_orderkey % 31 = 9 THEN '\"rainfall_7d_mm\":true'"
    f" ELSE {_field('rainfall_7d_mm', 'o_orderkey % 900')} END",
    f"CASE WHEN o_orderkey % 37 = 1 THEN '\"land_cover\":7'"
    f" ELSE {_field('land_cover', OBSERVATIONS['land_cover'], quoted=True)} END",
    "'\"ndvi\":0.5'",
    "CASE WHEN o_orderkey % 13 <> 3 THEN "
    f"{_field('soil_type', OBSERVATIONS['soil_type'], quoted=True)} END",
    _field("distance_to_river_m", "o_custkey % 5000"),
    f"CASE WHEN o_orderkey % 41 <> 2 THEN {_field('distance_to_road_m', 'o_custkey % 3000')} END",
    "CASE WHEN o_orderkey % 3 = 0 THEN '\"note\":\"extra\"' END",
)
RECORDS = {
    "event_id": "CAST(o_orderkey AS STRING)",
    # One line in 43 goes on after its object, in one of five ways.
    "record": "CASE WHEN o_orderkey % 101 = 7 THEN 'not json'"
    f" ELSE concat('{{', concat_ws(',', {', '.join(_RECORD_FIELDS)}), '}}',"
    " CASE WHEN o_orderkey % 43 <> 11 THEN '' WHEN o_orderkey % 5 = 0 THEN '{\"ndvi\":0.1}'"
    " WHEN o_orderkey % 5 = 1 THEN ' oops }' WHEN o_orderkey % 5 = 2 THEN ',\"x\":{\"y\":1}'"
    " WHEN o_orderkey % 5 = 3 THEN ']' ELSE ',{\"_end\":1}],{}' END) END",
}

_SOURCES = {
    "scored": (SCORED, "lineitem"),
    "observations": (OBSERVATIONS, "orders"),
    "records": (RECORDS, "orders"),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; unused columns never reach the scan."""
    columns, table = _SOURCES[name]
    frame = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return frame.selectExpr(*[f"{text} AS {alias}" for alias, text in columns.items()])


def cte(name: str) -> str:
    """The same view as a WITH item."""
    columns, table = _SOURCES[name]
    body = ", ".join(f"{text} AS {alias}" for alias, text in columns.items())
    return f"{name} AS (SELECT {body} FROM {table})"
