"""Score located rows with a saved model and write map tiles, partitioned by zoom."""

from __future__ import annotations

import argparse

from geoscore.jobs.common import read_observations, session
from geoscore.operators.tiles import ZOOM_HIGH, ZOOM_LOW
from geoscore.plans.heat import heat_layer
from geoscore.plans.model import RiskModel
from geoscore.sources.sinks import write_scores


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--model", required=True)
    parser.add_argument("--data", required=True)
    parser.add_argument("--format", choices=("csv", "parquet"), default="csv")
    parser.add_argument("--output", required=True)
    parser.add_argument("--lowest", type=int, default=ZOOM_LOW)
    parser.add_argument("--highest", type=int, default=ZOOM_HIGH)
    args = parser.parse_args(argv)
    spark = session("heat")
    rows = read_observations(spark, args.data, args.format)
    layer = heat_layer(
        RiskModel.load(spark, args.model), rows, lowest=args.lowest, highest=args.highest
    )
    write_scores(layer, args.output, partition_by=["z"])


if __name__ == "__main__":
    main()
