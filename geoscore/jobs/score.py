"""Score a table or JSON records with a saved model, in batch or as a stream."""

from __future__ import annotations

import argparse

from geoscore.jobs.common import read_observations, session
from geoscore.plans.model import RiskModel
from geoscore.plans.scoring import score_records, score_table
from geoscore.sources.sinks import write_scores
from geoscore.sources.tables import read_json_records
from geoscore.streaming.score_stream import read_record_stream, score_stream, write_score_stream


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--model", required=True)
    parser.add_argument("--input", required=True)
    parser.add_argument("--format", choices=("csv", "parquet", "json"), default="parquet")
    parser.add_argument("--keep", nargs="*", default=["event_id"], help="columns carried through")
    parser.add_argument("--output", required=True)
    parser.add_argument("--stream", action="store_true", help="JSON records only")
    parser.add_argument("--checkpoint", help="stream log folder on shared storage")
    parser.add_argument("--once", action="store_true", help="stop after the input present now")
    args = parser.parse_args(argv)
    if args.stream and (args.format != "json" or not args.checkpoint):
        parser.error("--stream needs --format json and --checkpoint")
    spark = session("score")
    model = RiskModel.load(spark, args.model)
    if args.stream:
        scored = score_stream(model, read_record_stream(spark, args.input))
        write_score_stream(scored, args.output, args.checkpoint, args.once).awaitTermination()
    elif args.format == "json":
        write_scores(score_records(model, read_json_records(spark, args.input)), args.output)
    else:
        rows = read_observations(spark, args.input, args.format)
        write_scores(score_table(model, rows, keep=args.keep), args.output)


if __name__ == "__main__":
    main()
