"""Declared schemas shared by every source, plan and stream."""

from __future__ import annotations

from pyspark.sql import types as T

# The feature vector, in model order.
FEATURES = (
    "elevation_m",
    "slope_deg",
    "aspect_deg",
    "curvature",
    "rainfall_24h_mm",
    "rainfall_72h_mm",
    "rainfall_7d_mm",
    "land_cover",
    "ndvi",
    "soil_type",
    "distance_to_river_m",
    "distance_to_road_m",
)
# The text features.
CATEGORICAL = ("land_cover", "soil_type")
# Columns that would leak the outcome or the place into a model.
EXCLUDED = (
    "event_id",
    "state",
    "latitude",
    "longitude",
    "monsoon_phase",
    "severity_class",
    "is_fatal",
    "reliability_score",
    "source",
)
LABEL = "landslide"
LATITUDE = "latitude"
LONGITUDE = "longitude"

NUMERIC = tuple(name for name in FEATURES if name not in CATEGORICAL)


def feature_type(name: str) -> T.DataType:
    return T.StringType() if name in CATEGORICAL else T.DoubleType()


FEATURE_SCHEMA = T.StructType([T.StructField(name, feature_type(name)) for name in FEATURES])

OBSERVATION_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField(LATITUDE, T.DoubleType()),
        T.StructField(LONGITUDE, T.DoubleType()),
        T.StructField("monsoon_phase", T.StringType()),
        T.StructField("severity_class", T.StringType()),
        T.StructField("is_fatal", T.IntegerType()),
        T.StructField("reliability_score", T.DoubleType()),
        T.StructField("source", T.StringType()),
        *FEATURE_SCHEMA.fields,
        T.StructField(LABEL, T.IntegerType()),
    ]
)

THRESHOLD_CURVE_COLUMNS = ("threshold", "f1", "f2", "precision", "recall")
METRICS_COLUMNS = ("roc_auc", "pr_auc", "threshold", "f1", "precision", "recall")


def schema_for(names, schema: T.StructType = OBSERVATION_SCHEMA) -> T.StructType:
    """The declared fields among ``names``; undeclared names are read as text."""
    known = {field.name: field for field in schema.fields}
    return T.StructType([known.get(name, T.StructField(name, T.StringType())) for name in names])
