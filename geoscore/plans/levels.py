"""Indicators of text features with many levels: the levels are a table joined to the rows.

No list of levels reaches the driver or a plan; only their number does. Levels are numbered
by name, the order the fitted encoder gives them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoscore.operators.ordering import numbered
from geoscore.sources.storage import store

# Level tables up to this many rows are sent to the rows; larger ones meet them by key.
SENT_LEVELS = 200_000


def level_index(df: DataFrame, column: str) -> DataFrame:
    """``level, rows, position`` of every level of ``column`` but NULL, stored."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("level"))
    counts = counts.agg(F.count(F.lit(1)).alias("rows"))
    return store(numbered(counts, [F.asc("level")], "position"), f"levels-{column}")


def level_indexes(df: DataFrame, columns: Sequence[str]) -> dict[str, DataFrame]:
    return {column: level_index(df, column) for column in columns}


def with_slots(df: DataFrame, indexes: Mapping[str, DataFrame], name: str = "slots") -> tuple[DataFrame, int]:
    """``df`` with the slots of its indicators that are 1, ascending, and the number of slots.

    Columns take their slots one after the other. A level that its index hasn't, and NULL,
    has no slot. A level table beyond ``SENT_LEVELS`` is joined by key, where adaptive
    execution splits a hot level's rows.
    """
    start, slots = 0, []
    for i, (column, index) in enumerate(indexes.items()):
        size = index.count()
        level, slot = f"_level_{i}", f"_slot_{i}"
        side = index.select(F.col("level").alias(level), (F.col("position") + F.lit(start)).alias(slot))
        side = F.broadcast(side) if size <= SENT_LEVELS else side.hint("merge")
        df = df.join(side, F.col(column) == F.col(level), "left").drop(level)
        slots.append(slot)
        start += size
    out = df.withColumn(name, F.array_compact(F.array(*slots)) if slots else F.array().cast("array<bigint>"))
    return out.drop(*slots), start
