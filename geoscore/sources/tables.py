"""Observation tables and request records in; typed frames out."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoscore.operators.validate import lacking, missing_fields
from geoscore.schema import FEATURE_SCHEMA, FEATURES, OBSERVATION_SCHEMA, schema_for


# The cell texts that stand for a missing number.
MISSING_MARKERS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def number_cell(name: str, kind: T.DataType) -> Column:
    """A cell as a number: NULL for a missing marker; any other text must parse."""
    text = F.trim(F.col(f"`{name}`"))
    return F.when(~text.isin(*MISSING_MARKERS), text).cast(kind)


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType = OBSERVATION_SCHEMA,
    typed: bool = True,
) -> DataFrame:
    """Headed CSV, matched to the declared schema by name, in any column order.

    With ``typed`` a missing marker in a number column is NULL and any other value
    that does not parse fails the query; otherwise all columns stay text for :func:`geoscore.operators.validate.check_columns`.
    """
    header = spark.read.option("header", True).csv(path).columns
    text = T.StructType([T.StructField(name, T.StringType()) for name in header])
    raw = (
        spark.read.schema(text).option("header", True).option("enforceSchema", False).csv(path)
    )
    if not typed:
        return raw
    return raw.select(
        *[
            (
                number_cell(f.name, f.dataType)
                if isinstance(f.dataType, T.NumericType)
                else F.col(f"`{f.name}`").cast(f.dataType)
            ).alias(f.name)
            for f in schema_for(header, schema)
        ]
    )


def read_csv_checked(
    spark: SparkSession, path: str, schema: T.StructType = OBSERVATION_SCHEMA
) -> tuple[DataFrame, DataFrame]:
    """Headed CSV as (rows, broken): typed rows, and the lines that can't be rows.

    ``broken`` has ``file``, ``line`` and ``reason``: a number of cells other than the
    header's, or each number column with text that is no number. Blank lines are no lines.
    All files have one header; a line that repeats it is a header too. Lines are split once,
    by the same parser as :func:`read_csv`; a cell can't hold a line end.
    """
    header = spark.read.option("header", True).csv(path).columns
    first = spark.read.option("header", False).option("quote", "").option("sep", "\u0001").csv(path).first()
    cells = T.StructType([T.StructField(name, T.StringType()) for name in [*header, "_broken"]])
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    lines = lines.filter((F.trim("value") != "") & (F.col("value") != F.lit(first[0] if first else "")))
    options = {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"}
    parsed = lines.select("value", "file", F.from_csv("value", cells.simpleString()[7:-1].replace(":", " "), options).alias("c"))
    declared = schema_for(header, schema)
    wrong = []
    for f in declared:
        if isinstance(f.dataType, T.NumericType):
            text = F.trim(F.col("c")[f.name])
            bad = text.isNotNull() & ~text.isin(*MISSING_MARKERS) & text.try_cast(f.dataType).isNull()
            wrong.append(F.when(bad, F.concat(F.lit(f"{f.name}: "), text)))
    numbers = F.nullif(F.concat_ws("; ", *wrong), F.lit("")) if wrong else F.lit(None).cast("string")
    reason = F.when(F.col("c")["_broken"].isNotNull(), F.lit(f"not {len(header)} cells")).otherwise(numbers)
    judged = parsed.withColumn("reason", reason)

    def typed(f: T.StructField) -> Column:
        text = F.col("c")[f.name]
        if isinstance(f.dataType, T.NumericType):
            text = F.when(~F.trim(text).isin(*MISSING_MARKERS), F.trim(text))
        return text.cast(f.dataType).alias(f.name)

    rows = judged.filter(F.col("reason").isNull()).select(*map(typed, declared))
    return rows, judged.filter(F.col("reason").isNotNull()).select("file", F.col("value").alias("line"), "reason")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Columnar table; its own schema, pruned and filtered at the scan."""
    return spark.read.parquet(path)


def read_json_records(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line, kept as text in ``record`` for the validator."""
    return spark.read.text(path).withColumnRenamed("value", "record")


def read_json_table(
    spark: SparkSession, path: str, schema: T.StructType = FEATURE_SCHEMA
) -> DataFrame:
    """One JSON object per line, parsed straight into the declared schema."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def from_rows(spark: SparkSession, rows: Iterable[Mapping[str, object]]) -> DataFrame:
    """Request dicts as a typed frame; extra fields are ignored.

    Every missing feature is named at once, in feature order.
    """
    ordered = []
    for row in rows:
        missing = missing_fields(row)
        if missing:
            raise lacking(missing)
        ordered.append(
            tuple(
                float(row[f.name])
                if isinstance(f.dataType, T.DoubleType) and row[f.name] is not None
                else row[f.name]
                for f in FEATURE_SCHEMA
            )
        )
    return spark.createDataFrame(ordered, FEATURE_SCHEMA).select(*FEATURES)
