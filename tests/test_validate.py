import json

import pytest
from pyspark.sql import functions as F

from geoscore.operators import validate
from geoscore.schema import CATEGORICAL, EXCLUDED, FEATURES, NUMERIC
from geoscore.sources import tables


def check(spark, records):
    frame = spark.createDataFrame([(r,) for r in records], "record string")
    return validate.check_records(frame).collect()


def test_schema_shape():
    assert len(FEATURES) == 12 and len(NUMERIC) == 10 and len(EXCLUDED) == 9
    assert not set(FEATURES) & set(EXCLUDED)
    assert set(CATEGORICAL) < set(FEATURES)


def test_good_record_is_typed(spark, sample_row):
    (row,) = check(spark, [json.dumps(sample_row)])
    assert row.errors == []
    assert {name: row[name] for name in FEATURES} == sample_row


def test_all_missing_fields_are_named_in_order(spark, sample_row):
    record = {k: v for k, v in sample_row.items() if k not in ("soil_type", "elevation_m")}
    (row,) = check(spark, [json.dumps(record)])
    assert row.errors == ["elevation_m: missing", "soil_type: missing"]


def test_extra_fields_are_ignored(spark, sample_row):
    (row,) = check(spark, [json.dumps(sample_row | {"note": {"deep": [1]}})])
    assert row.errors == []


@pytest.mark.parametrize(
    ("field", "value", "fault"),
    [
        ("slope_deg", "38", None),
        ("slope_deg", " 3.8e1 ", None),
        ("slope_deg", True, None),
        ("slope_deg", "steep", "not_number"),
        ("slope_deg", "38d", "not_number"),
        ("slope_deg", "0x1p3", "not_number"),
        ("slope_deg", None, "not_number"),
        ("slope_deg", [38], "not_number"),
        ("slope_deg", {"deg": 38}, "not_number"),
        ("soil_type", 7, "not_text"),
        ("soil_type", True, "not_text"),
        ("soil_type", None, "not_text"),
        ("soil_type", "", None),
    ],
)
def test_field_types(spark, sample_row, field, value, fault):
    (row,) = check(spark, [json.dumps(sample_row | {field: value})])
    assert row.errors == ([] if fault is None else [f"{field}: {fault}"])
    if fault:
        assert row[field] is None


@pytest.mark.parametrize("text", ["not json", "", "[1]", None, '{"a":1} tail'])
def test_broken_records_miss_everything(spark, text):
    (row,) = check(spark, [text])
    assert row.errors == [f"{name}: missing" for name in FEATURES]
    frame = spark.createDataFrame([(text,)], "record string")
    assert frame.select(validate.missing_in_record("record")).first()[0] == list(FEATURES)


def test_null_member_is_not_missing(spark, sample_row):
    frame = spark.createDataFrame([(json.dumps(sample_row | {"ndvi": None}),)], "record string")
    assert frame.select(validate.missing_in_record("record")).first()[0] == []


def test_split_keeps_every_row_once(spark, sample_row):
    records = [json.dumps(sample_row), "{}", json.dumps(sample_row | {"ndvi": "x"})]
    frame = spark.createDataFrame([(r,) for r in records], "record string")
    valid, bad = validate.split_checked(validate.check_records(frame))
    assert (valid.count(), bad.count()) == (1, 2)
    assert "errors" not in valid.columns


def test_filter_does_not_repeat_parsing(spark, sample_row):
    frame = spark.createDataFrame([(json.dumps(sample_row),)], "record string")
    valid, _ = validate.split_checked(validate.check_records(frame))
    plan = valid._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_column_check(spark, sample_row):
    rows = [sample_row, sample_row | {"ndvi": "n/a"}, sample_row | {"soil_type": None, "ndvi": None}]
    frame = spark.createDataFrame(
        [tuple(None if r[n] is None else str(r[n]) for n in FEATURES) for r in rows], list(FEATURES)
    )
    checked = validate.check_columns(frame).collect()
    assert [r.errors for r in checked] == [
        [],
        ["ndvi: not_number"],
        ["ndvi: not_number", "soil_type: not_text"],
    ]
    assert checked[0].slope_deg == 38.0


def test_missing_columns_are_all_named(spark):
    frame = spark.createDataFrame([(1.0,)], "slope_deg double").select("slope_deg")
    with pytest.raises(ValueError, match="elevation_m.*aspect_deg.*distance_to_road_m"):
        validate.project_features(frame)


def test_projection_order_and_guard(spark, sample_row):
    frame = tables.from_rows(spark, [sample_row]).select(*reversed(FEATURES), F.lit(1).alias("x"))
    assert validate.project_features(frame).columns == list(FEATURES)
    with pytest.raises(ValueError, match="severity_class"):
        validate.guard_features([*FEATURES, "severity_class"])
    frame = frame.withColumn("state", F.lit("s"))
    assert "state" not in validate.drop_excluded(frame).columns


def test_null_label_is_an_error(spark):
    frame = spark.createDataFrame([(None,)], "landslide double")
    with pytest.raises(Exception, match="label"):
        validate.with_label(frame).collect()


def test_rows_source(spark, sample_row):
    frame = tables.from_rows(spark, [sample_row, sample_row | {"slope_deg": 12, "extra": 1}])
    assert frame.columns == list(FEATURES)
    assert [r.slope_deg for r in frame.collect()] == [38.0, 12.0]
    with pytest.raises(ValueError, match="lacks these features: ndvi, soil_type"):
        tables.from_rows(
            spark, [{k: v for k, v in sample_row.items() if k not in ("soil_type", "ndvi")}]
        )


GOOD = '{"elevation_m":1,"slope_deg":2}'


@pytest.mark.parametrize(
    "tail", ['{"slope_deg":3}', " oops }", ',"x":{"y":1}', "]", ',{"_end":1}],{}', "}", " // }"]
)
def test_text_after_the_object_is_refused(spark, tail):
    wanted = ("elevation_m", "slope_deg")
    df = spark.createDataFrame([(GOOD + tail,), (GOOD + " \n",)], "record string")
    errors = [r.errors for r in validate.check_records(df, wanted=wanted).collect()]
    assert errors == [["elevation_m: missing", "slope_deg: missing"], []]
    missing = [r[0] for r in df.select(validate.missing_in_record("record", wanted)).collect()]
    assert missing == [list(wanted), []]


def test_unreadable_member_is_missing_everywhere(spark):
    df = spark.createDataFrame([('{"elevation_m":{"a":1,"a":2}}',)], "record string")
    checked = validate.check_records(df, wanted=("elevation_m",)).first()
    assert checked.errors == ["elevation_m: missing"]
    assert df.select(validate.missing_in_record("record", ("elevation_m",))).first()[0] == ["elevation_m"]


def test_csv_missing_markers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ndvi,land_cover\nNA,NA\n#N/A,x\n0.5,y\n null ,z\n")
    rows = tables.read_csv(spark, str(tmp_path)).collect()
    assert [(r.ndvi, r.land_cover) for r in rows] == [(None, "NA"), (None, "x"), (0.5, "y"), (None, "z")]
    (tmp_path / "a.csv").write_text("ndvi\nlots\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        tables.read_csv(spark, str(tmp_path)).collect()
