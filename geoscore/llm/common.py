"""Small helpers the operators share."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col`` and ``text`` alone: other columns can't clash; a null text is empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col), text.alias("text"))


def share(df: DataFrame, value: Any) -> Callable[[], Any]:
    """Sends a value of fixed size to every executor once; call the result there to get it.

    Broadcasts pickle classes by name alone, so the value goes as bytes that hold them.
    """
    sent = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case, every other letter as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def crc_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def rows_of(batches: Iterator[pa.RecordBatch], size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``size`` bytes, or one row."""
    for batch in batches:
        rows = max(1, batch.num_rows * size // max(batch.nbytes, 1))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def words(text: bytes) -> list[bytes]:
    """Words of UTF-8 text: runs of anything but ASCII white space, A-Z in lower case.

    ``bytes`` methods know ASCII alone, which is what is wanted here.
    """
    return text.lower().split()


def raw(column: pa.Array) -> list[bytes]:
    """A text column as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def batch(schema: pa.Schema, columns: Sequence) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)],
        schema=schema,
    )
