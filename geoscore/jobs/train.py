"""Train, evaluate and save: ``spark-submit geoscore/jobs/train.py --data ... --model ... --reports ...``."""

from __future__ import annotations

import argparse

from geoscore.jobs.common import read_observations, session
from geoscore.plans.learners import ROUNDS, boosted_a, boosted_b, forest
from geoscore.plans.report import train_and_evaluate


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--data", required=True)
    parser.add_argument("--format", choices=("csv", "parquet"), default="csv")
    parser.add_argument("--row-id", default="event_id")
    parser.add_argument("--model", required=True)
    parser.add_argument("--reports", required=True)
    parser.add_argument("--rounds", type=int, default=ROUNDS)
    parser.add_argument("--forest-trees", type=int, default=100)
    parser.add_argument("--parallelism", type=int, default=2)
    args = parser.parse_args(argv)
    spark = session("train")
    observations = read_observations(spark, args.data, args.format)
    candidates = [boosted_a(args.rounds), boosted_b(args.rounds)]
    if args.forest_trees:
        candidates.append(forest(args.forest_trees))
    result = train_and_evaluate(
        observations, args.row_id, candidates, parallelism=args.parallelism
    )
    result.model.save(args.model)
    result.write(args.reports)
    result.close()


if __name__ == "__main__":
    main()
