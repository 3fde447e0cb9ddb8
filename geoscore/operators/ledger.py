"""Ranking and threshold metrics kept up to date day by day.

A day's rows are combined to counts per distinct score and stored. Counts of days add up,
so the metrics of any days come from their counts: a new or corrected day is the only one
whose rows are read. A day is written beside what is stored for it and takes its place with
one commit, so a write that breaks off changes nothing. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoscore.operators.profile import record_of_counts
from geoscore.operators.ranking import distinct_scores
from geoscore.sources.storage import drop, exists, store

_COMMITS = "number long, day string, version string"


def _commits(spark: SparkSession, path: str) -> list:
    """A row for each day ever written, again for each correction of one."""
    if not exists(spark, f"{path}/commits"):
        return []
    return spark.read.schema(_COMMITS).json(f"{path}/commits").orderBy("number").collect()


def record_day(
    df: DataFrame, path: str, day: str, score: str, label: str, by: Sequence[str] = ()
) -> None:
    """Stores the counts of ``day``, whose rows ``df`` holds, in place of earlier ones.

    NULL or NaN scores and labels other than 0 and 1 fail the write, and the day stays as
    it was. The counts before stay for readers still at work; older ones are deleted.
    """
    spark = df.sparkSession
    before = _commits(spark, path)
    version = uuid.uuid4().hex
    distinct_scores(df, score, label, by).write.parquet(f"{path}/counts/{version}")
    number = 1 + max((r["number"] for r in before), default=0)
    # One file, so that its commit is one rename.
    commit = spark.createDataFrame([(number, str(day), version)], _COMMITS).coalesce(1)
    commit.write.mode("append").json(f"{path}/commits")
    own = [r["version"] for r in before if r["day"] == str(day)]
    drop(spark, [f"{path}/counts/{v}" for v in own[:-1]])


def recorded_days(spark: SparkSession, path: str) -> dict[str, str]:
    """The days stored and the version of each that holds."""
    return {r["day"]: r["version"] for r in _commits(spark, path)}


def merged_counts(
    spark: SparkSession, path: str, days: Iterable[str] | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Counts per distinct score over ``days``, or over all; other days are not read."""
    held = recorded_days(spark, path)
    wanted = list(held) if days is None else list(dict.fromkeys(map(str, days)))
    absent = [day for day in wanted if day not in held]
    if absent or not wanted:
        raise ValueError(f"no counts are stored for {', '.join(absent) or 'any day'}")
    counts = spark.read.parquet(*[f"{path}/counts/{held[day]}" for day in wanted])
    return counts.groupBy(*by, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def record_of_days(
    spark: SparkSession,
    path: str,
    days: Iterable[str] | None = None,
    by: Sequence[str] = (),
    metric: str = "f1",
) -> DataFrame:
    """Rank metrics and the best-threshold row over ``days``, as of all their rows at once."""
    return record_of_counts(store(merged_counts(spark, path, days, by), "merged-scores"), by, metric)
