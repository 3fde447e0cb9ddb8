import bisect
import math
import random

import pytest
from pyspark.sql import functions as F

from geoscore.functions.scores import at_or_above
from geoscore.operators import metrics, profile, ranking

POSITIVES, NEGATIVES = 1200, 3600
# Published true and false positives at four thresholds of the vote.
PUBLISHED_COUNTS = ((0.05, 1151, 409), (0.085, 1139, 325), (0.18, 1098, 220), (0.95, 590, 25))
# Published rates of each candidate at its own threshold, with their counts:
# true positives, flagged rows, F1, F2, precision, recall.
PUBLISHED_RATES = {
    "learner a": (1088, 1306, 0.8683160415003991, 0.8909269571, 0.8330781010719756, 0.9066666666666666),
    "learner b": (1080, 1287, 0.8685162846803377, 0.8871365205, 0.8391608391608392, 0.9),
    "forest": (1040, 1283, 0.837696335078534, 0.8548413612, 0.8106001558846454, 0.8666666666666667),
    "vote": (1098, 1318, 0.8721207307386815, 0.8973520758417783, 0.8330804248861912, 0.915),
    "vote, second run": (1096, 1310, 0.8733067729083666, None, 0.8366412213740458, 0.9133333333333333),
}


def published_rows():
    """Scores whose counts are the published ones at each published threshold."""
    rows, tp_above, fp_above = [], 0, 0
    for threshold, tp, fp in reversed(PUBLISHED_COUNTS):
        rows += [(1, threshold)] * (tp - tp_above) + [(0, threshold)] * (fp - fp_above)
        tp_above, fp_above = tp, fp
    rows += [(1, 0.01)] * (POSITIVES - tp_above) + [(0, 0.01)] * (NEGATIVES - fp_above)
    # Scores just under the next threshold up leave it as the first of its step.
    ups = {0.01: 0.04999, 0.05: 0.08499, 0.085: 0.17999, 0.18: 0.94999, 0.95: 0.99}
    return [(y, ups[p]) for y, p in rows]


def brute_curve(rows):
    out = []
    for t in metrics.grid_values():
        tp = sum(1 for y, p in rows if y == 1 and p >= t)
        fp = sum(1 for y, p in rows if y == 0 and p >= t)
        out.append((t, tp, fp))
    return out


def brute_ranks(rows):
    pos = [p for y, p in rows if y == 1]
    neg = [p for y, p in rows if y == 0]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    ap, tp, fp = 0.0, 0, 0
    for s in sorted({p for _, p in rows}, reverse=True):
        hits = sum(1 for p in pos if p == s)
        tp, fp = tp + hits, fp + sum(1 for p in neg if p == s)
        ap += hits * tp / (tp + fp)
    return auc, ap / len(pos)


def tied_rows(n, seed, decimals=2):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        y = int(rng.random() < 0.3)
        rows.append((y, round(min(1.0, max(0.0, rng.gauss(0.35 + 0.25 * y, 0.2))), decimals)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "y int, p double")


def test_grid_values_have_published_bits():
    grid = metrics.grid_values()
    assert len(grid) == 181
    assert grid[0] == 0.05 and grid[180] == 0.95
    # Grid points that 0.05 + i * 0.005 would miss.
    assert grid[7] == 0.08499999999999999 and grid[26] == 0.18 and grid[43] == 0.26499999999999996
    assert grid[59] == 0.3449999999999999 and grid[25] == 0.175


def test_grid_table_equals_grid_values(spark):
    rows = metrics.threshold_grid(spark).orderBy("step").collect()
    assert [r.threshold for r in rows] == metrics.grid_values()


def test_published_operating_points(spark):
    df = frame(spark, published_rows())
    curve = metrics.threshold_curve(df, "p", "y")
    best = metrics.best_threshold(curve).first()
    assert best.threshold == 0.18
    assert (best.tn, best.fp, best.fn, best.tp) == (3380, 220, 102, 1098)
    assert best.f1 == 0.8721207307386815
    assert best.f2 == pytest.approx(0.8973520758417783, abs=2e-16)
    assert best.precision == 0.8330804248861912 and best.recall == 0.915
    recall_first = metrics.best_threshold(curve, "f2").first()
    assert recall_first.threshold == 0.08499999999999999
    assert recall_first.f2 == pytest.approx(0.9091634738186463, abs=2e-16)
    assert (recall_first.tp, recall_first.fp) == (1139, 325)
    assert recall_first.precision == 0.7780054644808743
    assert recall_first.recall == 0.9491666666666667


@pytest.mark.parametrize("name", PUBLISHED_RATES)
def test_published_rates_from_counts(spark, name):
    tp, flagged, f1, f2, precision, recall = PUBLISHED_RATES[name]
    counts = spark.createDataFrame(
        [(NEGATIVES - flagged + tp, flagged - tp, POSITIVES - tp, tp)],
        "tn bigint, fp bigint, fn bigint, tp bigint",
    )
    row = metrics.with_rates(counts).first()
    assert (row.f1, row.precision, row.recall) == (f1, precision, recall)
    if f2 is not None:
        assert row.f2 == pytest.approx(f2, abs=1e-10)


def test_curve_equals_one_pass_per_threshold(spark):
    rows = tied_rows(800, 1, decimals=3) + [(1, t) for t in metrics.grid_values()]
    rows += [(0, 0.0), (1, 1.0), (1, -3.0), (0, 1e300), (1, float("inf")), (0, float("-inf"))]
    got = metrics.threshold_curve(frame(spark, rows), "p", "y").orderBy("threshold").collect()
    assert [(r.threshold, r.tp, r.fp) for r in got] == brute_curve(rows)
    for r in got:
        assert r.tp + r.fn == sum(y for y, _ in rows)
        assert r.fp + r.tn == sum(1 - y for y, _ in rows)


def test_bins_next_to_every_grid_value(spark):
    grid = metrics.grid_values()
    near = [f(t) for t in grid for f in (lambda t: math.nextafter(t, 0), float, lambda t: math.nextafter(t, 2))]
    bins = frame(spark, [(0, p) for p in near]).select(
        "p", metrics.reached_thresholds(F.col("p"), 0.05, 0.95, 181).alias("bin")
    )
    assert [r.bin for r in bins.collect()] == [bisect.bisect_right(grid, p) for p in near]


@pytest.mark.parametrize(("low", "high", "points"), [(0.0, 1.0, 2), (0.0, 1.0, 1001), (-2.5, 7.1, 37)])
def test_bins_of_other_grids(spark, low, high, points):
    rng = random.Random(points)
    grid = metrics.grid_values(low, high, points)
    scores = [rng.uniform(low - 0.2, high + 0.2) for _ in range(500)] + grid
    bins = frame(spark, [(0, p) for p in scores]).select(
        metrics.reached_thresholds(F.col("p"), low, high, points).alias("bin")
    )
    assert [r.bin for r in bins.collect()] == [bisect.bisect_right(grid, p) for p in scores]


def test_curve_per_key(spark):
    a, b = tied_rows(200, 2), tied_rows(100, 3)
    df = frame(spark, a).withColumn("m", F.lit("a")).unionByName(
        frame(spark, b).withColumn("m", F.lit("b"))
    )
    got = metrics.threshold_curve(df, "p", "y", by=["m"]).orderBy("m", "threshold").collect()
    assert len(got) == 362
    assert [(r.threshold, r.tp, r.fp) for r in got[:181]] == brute_curve(a)
    assert [(r.threshold, r.tp, r.fp) for r in got[181:]] == brute_curve(b)


def test_curve_of_no_rows(spark):
    got = metrics.threshold_curve(frame(spark, []), "p", "y").collect()
    assert len(got) == 181 and {(r.tp, r.fp, r.f1, r.precision, r.recall) for r in got} == {
        (0, 0, 0.0, 0.0, 0.0)
    }


def test_lowest_threshold_wins_ties(spark):
    curve = metrics.threshold_curve(frame(spark, [(1, 0.5), (0, 0.01)]), "p", "y")
    assert metrics.best_threshold(curve).first().threshold == 0.05


def test_rates_are_zero_without_flags_or_positives(spark):
    df = frame(spark, [(0, 0.1), (0, 0.9)])
    row = metrics.with_rates(metrics.confusion(df, "y", at_or_above("p", 0.95))).first()
    assert (row.precision, row.recall, row.f1, row.f2) == (0.0, 0.0, 0.0, 0.0)


def test_confusion_matrix_layout(spark):
    df = frame(spark, [(0, 0.1), (0, 0.9), (0, 0.9), (1, 0.1), (1, 0.9)])
    counts = metrics.confusion(df, "y", at_or_above("p", 0.5))
    assert metrics.confusion_matrix(counts).first()[0] == [[1, 2], [1, 1]]


def test_class_balance(spark):
    row = metrics.class_balance(frame(spark, [(0, 0.0)] * 3 + [(1, 0.0)]), "y").first()
    assert (row.neg_rows, row.pos_rows, row.pos_weight) == (3, 1, 3.0)
    assert metrics.class_balance(frame(spark, [(0, 0.0)]), "y").first().pos_weight is None


@pytest.mark.parametrize("slices", [1, 2, 7, 64])
@pytest.mark.parametrize("decimals", [1, 2, 6])
def test_ranks_equal_brute_force(spark, slices, decimals):
    rows = tied_rows(300, slices * 10 + decimals, decimals)
    got = ranking.rank_metrics(frame(spark, rows), "p", "y", slices=slices).first()
    auc, ap = brute_ranks(rows)
    assert got.roc_auc == pytest.approx(auc, abs=1e-12)
    assert got.average_precision == pytest.approx(ap, abs=1e-12)


def test_ranks_with_a_hot_score(spark):
    rows = tied_rows(200, 5, 6) + [(0, 0.0)] * 200 + [(1, 0.0)] * 20 + [(1, 1.0)] * 3
    got = ranking.rank_metrics(frame(spark, rows), "p", "y", slices=16).first()
    auc, ap = brute_ranks(rows)
    assert got.roc_auc == pytest.approx(auc, abs=1e-12)
    assert got.average_precision == pytest.approx(ap, abs=1e-12)


def slice_sizes(df, by=()):
    counts = ranking.distinct_scores(df, "p", "y", by)
    return [r["count"] for r in ranking.sliced(counts, by, 16).groupBy("slice").count().collect()]


def test_slices_stay_even_under_clustered_scores(spark):
    # Distinct scores crowd into a millionth of the range, as rare-event scores do.
    rows = [(i % 5 == 0, i * 1e-10) for i in range(4000)] + [(True, 0.5 + i / 1e4) for i in range(400)]
    df = spark.createDataFrame([(int(y), p) for y, p in rows], "y int, p double")
    sizes = slice_sizes(df)
    assert max(sizes) <= 2 * sum(sizes) / 16


def test_slices_stay_even_under_a_hot_score(spark):
    # 99 of 100 rows have one score; it is one distinct score like any other.
    df = spark.range(200_000).selectExpr(
        "cast(id % 2 as int) y", "case when id % 100 = 0 then id / 200000.0e0 else 0.25e0 end p"
    )
    sizes = slice_sizes(df)
    assert len(sizes) == 16 and max(sizes) <= 2 * sum(sizes) / 16


def test_slices_stay_even_under_a_narrow_key(spark):
    df = spark.range(4000).selectExpr(
        "cast(id % 2 as int) y",
        "id % 2 = 0 k",
        "case when id % 2 = 0 then 0.5e0 + id * 1e-12 else id / 4000.0e0 end p",
    )
    sizes = slice_sizes(df, ["k"])
    assert len(sizes) == 16 and max(sizes) <= 2 * sum(sizes) / 16


def test_ranks_when_every_score_ties(spark):
    got = ranking.rank_metrics(frame(spark, [(1, 0.4)] * 3 + [(0, 0.4)] * 9), "p", "y").first()
    assert (got.roc_auc, got.average_precision) == (0.5, 0.25)


def test_ranks_of_one_class(spark):
    got = ranking.rank_metrics(frame(spark, [(0, 0.4), (0, 0.5)]), "p", "y").first()
    assert (got.roc_auc, got.average_precision) == (None, 0.0)
    got = ranking.rank_metrics(frame(spark, [(1, 0.4), (1, 0.5)]), "p", "y").first()
    assert (got.roc_auc, got.average_precision) == (None, 1.0)
    got = ranking.rank_metrics(frame(spark, []), "p", "y").first()
    assert (got.pos_total, got.neg_total, got.roc_auc, got.average_precision) == (0, 0, None, 0.0)


def test_ranks_refuse_missing_scores(spark):
    with pytest.raises(Exception, match="score is NULL or NaN"):
        ranking.rank_metrics(frame(spark, [(1, None), (0, 0.1)]), "p", "y").collect()


def test_counts_beyond_bigint_products(spark):
    # 4e9 positives times 4e9 negatives overflows BIGINT; the ratio must not.
    counts = spark.createDataFrame(
        [(0.9, 4_000_000_000, 0), (0.1, 0, 4_000_000_000)], "score double, pos bigint, neg bigint"
    )
    got = ranking.rank_counts(counts).first()
    assert (got.roc_auc, got.average_precision) == (1.0, 1.0)


def test_metrics_record_and_comparison(spark):
    rows = tied_rows(400, 9)
    auc, ap = brute_ranks(rows)
    record = profile.metrics_record(frame(spark, rows), "p", "y").first()
    assert record.roc_auc == pytest.approx(auc) and record.pr_auc == pytest.approx(ap)
    df = frame(spark, rows).withColumn("q", 1 - F.col("p"))
    long = profile.to_long(df, {"p": "good", "q": "vote"}, "y")
    table = {
        r.model: r
        for r in profile.model_comparison(long, "y", {"vote": {"a": 0.3, "b": 0.7}}).collect()
    }
    assert table["good"].threshold == record.threshold and table["good"].a_weight is None
    assert (table["vote"].a_weight, table["vote"].b_weight) == (0.3, 0.7)
    assert table["vote"].roc_auc == pytest.approx(1 - auc)


def test_dataset_profile(spark):
    df = spark.createDataFrame(
        [("B", "real", 1), ("A", "real", 1), ("A", "fake", 0), (None, "fake", 0), ("B", None, 0)],
        "state string, source string, y int",
    )
    row = profile.dataset_profile(df, "y", "state", "source").first()
    assert (row.rows, row.positive_rows, row.negative_rows) == (5, 2, 3)
    assert row.states_present == ["A", "B"]
    assert {(e.source, e.rows) for e in row.source_rows} == {("real", 2), ("fake", 2), (None, 1)}
    counts = {r.source: r.rows for r in profile.source_counts(df, "source", "y").collect()}
    assert counts == {"real": 2, "fake": 2, None: 1}
