"""Row numbers over a whole table without a one-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoscore.sources.storage import store


def numbered(df: DataFrame, order: Sequence[Column], name: str = "rn") -> DataFrame:
    """Adds the 0-based position in ``order``, which must be a total order.

    Rows are range-partitioned, and stored, because the range cuts are sampled and
    would move if a lost task drew them again. Each slice is then numbered on its
    own, starting from the rows in the slices before it.
    """
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(slices, *order).withColumn("_slice", F.spark_partition_id())
    rows = store(ranged, "numbered")
    before = Window.partitionBy(F.lit(0)).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    # One row per slice, entering its slice first and carrying the rows before it.
    carried = (
        rows.groupBy("_slice")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(
            "_slice",
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_step"),
            F.lit(0).alias("_kind"),
        )
    )
    steps = rows.select("*", F.lit(1).cast("bigint").alias("_step"), F.lit(1).alias("_kind"))
    running = (
        Window.partitionBy("_slice")
        .orderBy("_kind", *order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        steps.unionByName(carried, allowMissingColumns=True)
        .withColumn(name, F.sum("_step").over(running) - F.lit(1))
        .filter(F.col("_kind") == 1)
        .select(*df.columns, name)
    )
