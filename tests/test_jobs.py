import pytest

from geoscore.jobs import heat, score, train
from geoscore.sources import sinks
from geoscore.workload.views import view


@pytest.fixture(scope="module")
def trained(spark, sf_dir, tmp_path_factory):
    root = tmp_path_factory.mktemp("jobs")
    observations = view(spark, sf_dir, "observations")
    sinks.write_scores(observations, f"{root}/data", "csv")
    view(spark, sf_dir, "records").select("record").write.text(f"{root}/records")
    train.main(
        f"--data {root}/data --model {root}/model --reports {root}/reports"
        " --rounds 1 --forest-trees 0".split()
    )
    return root, observations.count()


def test_train_writes_reports(spark, trained):
    root, rows = trained
    assert spark.read.option("header", True).csv(f"{root}/reports/model_comparison").count() == 3


def test_score_table_and_records(spark, trained):
    root, rows = trained
    score.main(
        f"--model {root}/model --input {root}/data --format csv --output {root}/scores".split()
    )
    table = spark.read.parquet(f"{root}/scores")
    assert table.columns == ["event_id", "risk_probability", "risk_level"] and table.count() == rows
    score.main(
        f"--model {root}/model --input {root}/records --format json --output {root}/batch".split()
    )
    score.main(
        f"--model {root}/model --input {root}/records --format json --output {root}/stream"
        f" --stream --once --checkpoint {root}/log".split()
    )
    batch, stream = spark.read.parquet(f"{root}/batch"), spark.read.parquet(f"{root}/stream")
    assert batch.count() == stream.count() == rows
    assert stream.select(batch.columns).exceptAll(batch).count() == 0


def test_heat_tiles(spark, trained):
    root, rows = trained
    heat.main(f"--model {root}/model --data {root}/data --output {root}/tiles".split())
    tiles = spark.read.parquet(f"{root}/tiles")
    assert tiles.filter("z = 6").agg({"points": "sum"}).first()[0] == rows


def test_stream_needs_a_log(trained):
    with pytest.raises(SystemExit):
        score.main("--model m --input i --output o --format json --stream".split())
