import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def sample_row():
    """The published smoke-test record (fixed values)."""
    return {
        "elevation_m": 1450.0,
        "slope_deg": 38.0,
        "aspect_deg": 120.0,
        "curvature": 0.15,
        "rainfall_24h_mm": 95.0,
        "rainfall_72h_mm": 210.0,
        "rainfall_7d_mm": 340.0,
        "land_cover": "Dense Forest",
        "ndvi": 0.55,
        "soil_type": "Loam",
        "distance_to_river_m": 800.0,
        "distance_to_road_m": 250.0,
    }
