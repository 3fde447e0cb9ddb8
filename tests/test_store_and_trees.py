"""Versioned models, node tables and the checked CSV scan."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoscore.plans import learners, trees
from geoscore.plans.model import RiskModel, fit
from geoscore.sources import tables
from geoscore.sources.sinks import write_lines
from geoscore.sources.storage import exists
from geoscore.workload.queries import _observations


def test_checked_csv(spark, tmp_path):
    header = "id,elevation_m,note"
    lines = ["1,2.5,a", '2,3,"b, c"', "3,NA,", "", "  ", "4,high,d", "5,1", "6,1,e,f", header, '"7,1,g', "8, 4 ,h", "9,nan,i"]
    write_lines(spark.createDataFrame([(x,) for x in lines], "value string").repartition(3), str(tmp_path / "t"), header)
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("elevation_m", T.DoubleType())])
    rows, broken = tables.read_csv_checked(spark, str(tmp_path / "t"), schema)
    got = sorted(map(tuple, rows.select("id", "elevation_m", "note").collect()), key=lambda r: r[0])
    assert got == [(1, 2.5, "a"), (2, 3.0, "b, c"), (3, None, None), (8, 4.0, "h"), (9, None, "i")]
    found = {r.line: (r.reason, r.file.endswith(".csv")) for r in broken.collect()}
    ragged = ("not 3 cells", True)
    assert found == {"4,high,d": ("elevation_m: high", True), "5,1": ragged, "6,1,e,f": ragged, '"7,1,g': ragged}


def test_old_versions_go_and_the_last_two_stay(spark, tmp_path):
    model = fit(_observations(spark, "/root/testdata/sf0.001"), "event_id", [learners.boosted_a(1)])
    path = str(tmp_path / "m")
    for _ in range(3):
        model.save(path)
    assert len(list((tmp_path / "m" / "versions").iterdir())) == 2
    assert RiskModel.load(spark, path).votes == model.votes and exists(spark, path)


def test_forest_by_nodes_and_fewer_rounds(spark):
    rows = _observations(spark, "/root/testdata/sf0.001")
    model = fit(rows, "event_id", [learners.boosted_a(4), learners.forest(5, 6)])
    ensembles = {m.name: trees.Ensemble.of(spark, m) for m in model.learners}
    scored = trees.score_by_nodes(model, model.transform(rows), ensembles)
    gaps = [F.max(F.abs(F.col(f"p_{n}") - F.col(f"n_{n}"))) for n in ensembles]
    assert max(scored.agg(*gaps).first()) < 1e-12
    losses = trees.staged_log_loss(model, rows, ensembles["a"], "landslide", every=3)
    assert sorted(r.rounds for r in losses.collect()) == [3, 4]
    short = trees.score_by_nodes(model, rows, {"a": ensembles["a"].upto(3)})
    p, y = F.col("n_a"), F.col("landslide").cast("int")
    own = short.agg(F.avg(-F.when(y == 1, F.log(p)).otherwise(F.log(1 - p)))).first()[0]
    three = losses.filter("rounds = 3").first()
    assert abs(three.log_loss - own) < 1e-9 and three.rows == rows.count()
    assert trees.best_round(losses) in (3, 4)
