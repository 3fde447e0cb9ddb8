"""Keeping costly columns from being computed again inside filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The same frame, with ``names`` passed through a one-row ``inline``.

    Spark moves a filter below the projection that makes its columns and so
    evaluates a costly expression twice per row, once to filter and once to keep.
    A filter on an ``inline`` output stays above it; filters on all other columns
    still move down to the scan.
    """
    others = [name for name in df.columns if name not in set(names)]
    passed = df.select(*others, F.inline(F.array(F.struct(*names))))
    return passed.select(*df.columns)
