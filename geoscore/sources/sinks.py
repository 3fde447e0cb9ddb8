"""Sinks for scores, reports and metric records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_scores(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()
) -> None:
    """Scored rows, one file per task."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_lines(df: DataFrame, path: str, header: str) -> None:
    """The one text column of ``df`` as lines, just as they are, below a header in each file."""
    raw = {"header": True, "sep": "\u0001", "quote": "", "escapeQuotes": False, "emptyValue": ""}
    df.toDF(header).write.mode("overwrite").options(**raw).csv(path)


def write_report(df: DataFrame, path: str, order_by: Sequence = ()) -> None:
    """A report table of at most a few hundred rows as one headed CSV file."""
    single = df.repartition(1)
    if order_by:
        single = single.sortWithinPartitions(*order_by)
    single.write.mode("overwrite").option("header", True).csv(path)


def write_record(df: DataFrame, path: str) -> None:
    """A one-row record as one indented JSON object."""
    pretty = F.to_json(F.struct(*df.columns), {"pretty": "true", "ignoreNullFields": "false"})
    df.select(pretty.alias("value")).coalesce(1).write.mode("overwrite").text(path)
