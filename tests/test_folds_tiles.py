import random

import pytest
from pyspark.sql import functions as F

from geoscore.operators import folds, tiles
from geoscore.operators.ordering import numbered


def groups(spark, n=300, seed=1):
    rng = random.Random(seed)
    rows = []
    for g in range(n):
        for _ in range(rng.randint(1, 12)):
            rows.append((f"g{g}", int(rng.random() < 0.25)))
    return spark.createDataFrame(rows, "g string, y int")


def test_numbered_equals_sorted_position(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5003).alias("k"), F.lit("x").alias("s"))
    got = numbered(df, [F.desc("k")]).orderBy("rn").collect()
    assert [r.rn for r in got] == list(range(5000))
    assert [r.k for r in got] == sorted((r.k for r in got), reverse=True)


def test_numbered_on_a_hot_leading_key(spark):
    df = spark.range(3000).select(F.lit(0).alias("k"), "id")
    got = numbered(df, [F.desc("k"), F.col("id").asc()]).orderBy("rn").collect()
    assert [(r.rn, r.id) for r in got] == [(i, i) for i in range(3000)]


@pytest.mark.parametrize("seed", [None, 42])
def test_both_deals_agree(spark, seed):
    counts = folds.group_counts(groups(spark), "g", "y")
    small = folds.deal_folds(counts, "g", seed=seed, most_groups=1000)
    sliced = folds.deal_folds(counts, "g", seed=seed)
    key = lambda r: r.g
    assert sorted(small.collect(), key=key) == sorted(sliced.collect(), key=key)


@pytest.mark.parametrize("k", [2, 5])
def test_fold_invariants(spark, k):
    df = groups(spark)
    folded = folds.assign_folds(df, "g", "y", folds=k, most_groups=1000).cache()
    assert folded.count() == df.count()
    assert {r.fold for r in folded.select("fold").distinct().collect()} == set(range(k))
    assert folds.split_groups(folded, "g").count() == 0
    balance = folds.fold_balance(folded, "y", "g").collect()
    assert sum(r.groups for r in balance) == 300
    pos = [r.pos for r in balance]
    assert max(pos) - min(pos) <= 6
    assert max(r.groups for r in balance) - min(r.groups for r in balance) <= 1


def test_seed_reorders_equal_groups_only(spark):
    df = spark.createDataFrame([(f"g{i}", 0) for i in range(40)], "g string, y int")
    counts = folds.group_counts(df, "g", "y")
    deals = [
        [r.fold for r in folds.deal_folds(counts, "g", seed=s, most_groups=50).orderBy("g").collect()]
        for s in (1, 1, 2)
    ]
    assert deals[0] == deals[1] != deals[2]


def test_a_false_bound_fails(spark):
    counts = folds.group_counts(groups(spark, 20), "g", "y")
    with pytest.raises(Exception, match="more than 10 groups"):
        folds.deal_folds(counts, "g", most_groups=10).collect()


def test_spatial_folds_refuse_bad_coordinates(spark):
    df = spark.createDataFrame([(91.0, 0.0, 1)], "latitude double, longitude double, y int")
    with pytest.raises(Exception, match="latitude is missing or off the globe"):
        folds.assign_spatial_folds(df, "latitude", "longitude", "y").collect()


def test_fold_map_is_broadcast_only_under_a_bound(spark):
    df = groups(spark, 30)

    def plan(**bound):
        joined = folds.assign_folds(df, "g", "y", **bound)
        return joined._jdf.queryExecution().optimizedPlan().toString()

    assert "strategy=broadcast" in plan(most_groups=1000)
    assert "strategy=broadcast" not in plan()


def points(spark):
    rng = random.Random(3)
    rows = [(rng.uniform(-80, 80), rng.uniform(-180, 180), rng.random()) for _ in range(500)]
    rows += [(26.3, 92.5, 0.5)] * 250
    return tiles.point_layer(
        spark.createDataFrame(rows, "lat double, lon double, p double"), "lat", "lon", "p"
    )


def test_tiles_conserve_points_at_every_zoom(spark):
    layer = tiles.roll_up(tiles.heat_tiles(points(spark)))
    totals = layer.groupBy("z").agg(F.sum("points").alias("n"), F.max("score_max")).collect()
    assert {r.z: r.n for r in totals} == {6: 750, 7: 750, 8: 750, 9: 750}


def test_roll_up_equals_direct_tiles(spark):
    pts = points(spark)
    rolled = tiles.roll_up(tiles.heat_tiles(pts)).filter("z = 7")
    rolled = {(r.x, r.y): r for r in rolled.collect()}
    direct = {(r.x, r.y): r for r in tiles.heat_tiles(pts, 7).collect()}
    assert rolled.keys() == direct.keys()
    for tile, row in direct.items():
        other = rolled[tile]
        assert (other.points, other.score_max) == (row.points, row.score_max)
        assert other.score_avg == pytest.approx(row.score_avg)


def test_tiles_refuse_missing_coordinates(spark):
    df = spark.createDataFrame([(None, 1.0, 0.5)], "latitude double, longitude double, score double")
    with pytest.raises(Exception, match="latitude is NULL or NaN"):
        tiles.heat_tiles(df).collect()
