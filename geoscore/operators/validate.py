"""Feature projection, leakage guard and record checks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoscore.functions.once import computed_once
from geoscore.functions.scores import binary_label
from geoscore.schema import CATEGORICAL, EXCLUDED, FEATURES, LABEL

# Decimal number as text, with the special words a double can also be spelled with.
NUMBER_TEXT = r"(?i)^\s*[+-]?(\d+\.?\d*([e][+-]?\d+)?|\.\d+([e][+-]?\d+)?|nan|inf|infinity)\s*$"

# Quoted spellings that a cast takes for a number and a typed request does not.
ODD_NUMBER = r'"\s*[+-]?([0-9.]+([eE][+-]?[0-9]+)?[dDfF]|0[xX][^"]*)\s*"'


def missing_fields(present: Iterable[str] | Mapping, wanted: Sequence[str] = FEATURES) -> list[str]:
    """All wanted names absent from ``present``, in wanted order."""
    names = set(present)
    return [name for name in wanted if name not in names]


def lacking(missing: Sequence[str]) -> ValueError:
    """The error that names all missing features."""
    return ValueError(f"the input lacks these features: {', '.join(missing)}")


def require_columns(df: DataFrame, wanted: Sequence[str] = FEATURES) -> DataFrame:
    """The frame itself; raises with every missing column named."""
    missing = missing_fields(df.columns, wanted)
    if missing:
        raise lacking(missing)
    return df


def project_features(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the model's features in model order, after any ``keep`` columns."""
    require_columns(df)
    return df.select(*keep, *[F.col(name) for name in FEATURES])


def with_label(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Label as 0/1 integer; a NULL label fails the query."""
    return df.withColumn(label, binary_label(label))


def guard_features(names: Sequence[str], excluded: Sequence[str] = EXCLUDED) -> tuple[str, ...]:
    """Feature names, refused at plan time if any of them leaks the outcome."""
    leaks = [name for name in names if name in set(excluded)]
    if leaks:
        raise ValueError(f"Excluded columns used as features: {leaks}")
    return tuple(names)


def drop_excluded(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The frame without the excluded columns, except those in ``keep``."""
    return df.drop(*[name for name in EXCLUDED if name not in keep])


END = "_end"


def _members(record: Column, wanted: Sequence[str]) -> Column:
    """The wanted members of a record as variants; NULL unless the text is exactly one object.

    Parsers stop after the first value and never see what follows it. The record is
    therefore read as the first of two items of an array, and the second must hold a hash
    of the record: text that closes the array early can't foresee it.
    """
    fields = [T.StructField(name, T.VariantType()) for name in wanted]
    item = T.StructType([*fields, T.StructField(END, T.LongType())])
    mark = F.xxhash64(record)
    wrapped = F.concat(F.lit("["), record, F.lit(f',{{"{END}":'), mark.cast("string"), F.lit("}]"))
    items = F.from_json(wrapped, T.ArrayType(item))

    def first(x: Column) -> Column:
        whole = (F.size(x) == 2) & (F.get(x, F.lit(1))[END] == mark)
        return F.when(whole, F.get(x, F.lit(0)))

    # Through a one-item array, so that the text is parsed once.
    return F.get(F.transform(F.array(items), first), F.lit(0))


def missing_in_record(record: Column | str, wanted: Sequence[str] = FEATURES) -> Column:
    """Names absent from a JSON object; a key holding null is present, bad JSON misses all.

    A member that can't be read, such as an object that repeats a key, counts as absent.
    """
    record = F.col(record) if isinstance(record, str) else record
    members = F.transform(F.array(_members(record, wanted)), lambda m: F.array(
        *[F.when(m[name].isNull(), F.lit(name)) for name in wanted]
    ))
    return F.array_compact(F.get(members, F.lit(0)))


def _text_is_number(text: Column) -> Column:
    return F.coalesce(text.rlike(NUMBER_TEXT), F.lit(False))


def _with_errors(
    df: DataFrame, keep: Sequence[str], typed: Mapping[str, Column], faults: Mapping[str, Column]
) -> DataFrame:
    """``keep`` columns, typed fields, and ``errors`` with each field's fault, if any."""
    values = df.select(
        *keep,
        *[value.alias(name) for name, value in typed.items()],
        *[fault.alias(f"_fault_{name}") for name, fault in faults.items()],
    )
    settled = computed_once(values, [*typed, *[f"_fault_{name}" for name in faults]])
    # NULL, and so left out, where the field has no fault.
    listed = [F.concat(F.lit(f"{name}: "), F.col(f"_fault_{name}")) for name in faults]
    return settled.select(*keep, *typed, F.array_compact(F.array(*listed)).alias("errors"))


def check_records(
    df: DataFrame,
    record: str = "record",
    wanted: Sequence[str] = FEATURES,
    text_fields: Sequence[str] = CATEGORICAL,
) -> DataFrame:
    """Parse and type-check one JSON object per row.

    Adds every wanted field as a typed column and ``errors array<string>``, in
    field order. Number fields take numbers, booleans and number-like text; text
    fields take text only. Nothing is dropped: see :func:`split_checked`.
    """
    text = F.col(record)
    # Members as variants: an absent one is NULL, a null one is a variant null.
    members = df.select(
        *df.columns,
        F.coalesce(text.rlike(ODD_NUMBER), F.lit(False)).alias("_odd"),
        _members(text, wanted).alias("_json"),
    )
    values = {}
    for name in wanted:
        member = F.col(f"_json.{name}")
        kind = F.schema_of_variant(member)
        as_text = F.try_variant_get(member, "$", "string")
        if name in text_fields:
            value = F.when(kind == "STRING", as_text)
        else:
            odd = F.col("_odd") & (kind == "STRING") & ~_text_is_number(as_text)
            value = F.when(~odd, F.try_variant_get(member, "$", "double"))
        values[name] = value
    typed = members.select(
        *df.columns,
        *[value.alias(name) for name, value in values.items()],
        *[F.col(f"_json.{name}").isNull().alias(f"_absent_{name}") for name in wanted],
    )
    faults = {
        name: F.when(F.col(f"_absent_{name}"), F.lit("missing")).when(
            F.col(name).isNull(), F.lit("not_text" if name in text_fields else "not_number")
        )
        for name in wanted
    }
    return _with_errors(typed, df.columns, {name: F.col(name) for name in wanted}, faults)


def check_columns(
    df: DataFrame,
    wanted: Sequence[str] = FEATURES,
    text_fields: Sequence[str] = CATEGORICAL,
) -> DataFrame:
    """Type-check the columns of a text table (such as an untyped CSV scan).

    Wanted columns become typed and ``errors array<string>`` lists the bad ones.
    """
    require_columns(df, wanted)
    values, faults = {}, {}
    for name in wanted:
        text = F.col(name).cast("string")
        if name in text_fields:
            values[name] = text
            faults[name] = F.when(text.isNull(), F.lit("not_text"))
        else:
            values[name] = F.when(_text_is_number(text), F.trim(text).try_cast("double"))
            faults[name] = F.when(~_text_is_number(text), F.lit("not_number"))
    others = [name for name in df.columns if name not in values]
    return _with_errors(df, others, values, faults).select(*df.columns, "errors")


def split_checked(df: DataFrame, errors: str = "errors") -> tuple[DataFrame, DataFrame]:
    """Rows without errors, and the quarantine with the rest."""
    valid = F.size(errors) == 0
    return df.filter(valid).drop(errors), df.filter(~valid)
