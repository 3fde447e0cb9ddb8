"""Counts, ratios and threshold curves over scored rows.

Every aggregate here is algebraic, so a hot class, model or bin is combined on
the map side and only a handful of rows per task is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoscore.functions.scores import binary_label, required_score

# The threshold grid, 181 even points from 0.05 to 0.95.
GRID_LOW, GRID_HIGH, GRID_POINTS = 0.05, 0.95, 181
GRID = (GRID_LOW, GRID_HIGH, GRID_POINTS)


def class_balance(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Negative and positive counts and their ratio (NULL without positives)."""
    y = binary_label(label)
    counts = df.groupBy(*by).agg(
        F.count_if(y == 0).alias("neg_rows"), F.count_if(y == 1).alias("pos_rows")
    )
    ratio = F.try_divide(F.col("neg_rows").cast("double"), F.col("pos_rows").cast("double"))
    return counts.withColumn("pos_weight", ratio)


def confusion(df: DataFrame, label: str, flag: Column, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts ``tn, fp, fn, tp`` of a 0/1 prediction."""
    frame = df.select(*by, binary_label(label).alias("_y"), flag.alias("_flag"))
    y, f = F.col("_y"), F.col("_flag")
    return frame.groupBy(*by).agg(
        F.count_if((y == 0) & (f == 0)).alias("tn"),
        F.count_if((y == 0) & (f == 1)).alias("fp"),
        F.count_if((y == 1) & (f == 0)).alias("fn"),
        F.count_if((y == 1) & (f == 1)).alias("tp"),
    )


def confusion_matrix(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts as ``[[tn, fp], [fn, tp]]``."""
    return counts.select(
        *by, F.array(F.array("tn", "fp"), F.array("fn", "tp")).alias("confusion_matrix")
    )


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(
        F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0)
    )


def precision(tp: str = "tp", fp: str = "fp") -> Column:
    """Share of flagged rows that are positive; 0 when nothing is flagged."""
    return _share(F.col(tp), F.col(tp) + F.col(fp))


def recall(tp: str = "tp", fn: str = "fn") -> Column:
    """Share of positives that are flagged; 0 without positives."""
    return _share(F.col(tp), F.col(tp) + F.col(fn))


def f_beta(beta: int = 1, tp: str = "tp", fp: str = "fp", fn: str = "fn") -> Column:
    """F score straight from the counts; 0 when there is nothing to find or flag."""
    b2 = beta * beta
    hit = F.lit(1 + b2) * F.col(tp)
    return _share(hit, hit + F.lit(b2) * F.col(fn) + F.col(fp))


def with_rates(counts: DataFrame) -> DataFrame:
    """Adds ``f1, f2, precision, recall`` to confusion counts."""
    return counts.select(
        "*",
        f_beta(1).alias("f1"),
        f_beta(2).alias("f2"),
        precision().alias("precision"),
        recall().alias("recall"),
    )


def grid_values(
    low: float = GRID_LOW, high: float = GRID_HIGH, points: int = GRID_POINTS
) -> list[float]:
    """Even grid, both ends included."""
    step = (high - low) / (points - 1)
    return [low + i * step for i in range(points)]


def threshold_grid(
    spark: SparkSession,
    low: float = GRID_LOW,
    high: float = GRID_HIGH,
    points: int = GRID_POINTS,
) -> DataFrame:
    """The grid as a table ``step, threshold``."""
    step = (high - low) / (points - 1)
    return spark.range(points).select(
        F.col("id").cast("int").alias("step"),
        (F.lit(low) + F.col("id").cast("double") * F.lit(step)).alias("threshold"),
    )


def reached_thresholds(score: Column, low: float, high: float, points: int) -> Column:
    """How many grid thresholds a score reaches.

    Position on an even grid is a division; one comparison with the grid value
    on either side then settles it exactly, whatever the division rounded to.
    """
    grid = F.array(*[F.lit(value) for value in grid_values(low, high, points)])
    step = (high - low) / (points - 1)
    near = F.least(F.greatest(score, F.lit(low - step)), F.lit(high + step))
    guess = F.floor((near - F.lit(low)) / F.lit(step)) + F.lit(1)
    guess = F.least(F.greatest(guess, F.lit(0)), F.lit(points)).cast("int")
    # NULL from an off-grid lookup means there is nothing to correct on that side.
    up = F.coalesce((score >= F.get(grid, guess)).cast("int"), F.lit(0))
    down = F.coalesce((score < F.get(grid, guess - F.lit(1))).cast("int"), F.lit(0))
    return guess + up - down


def threshold_curve(
    df: DataFrame,
    score: str,
    label: str,
    by: Sequence[str] = (),
    low: float = GRID_LOW,
    high: float = GRID_HIGH,
    points: int = GRID_POINTS,
) -> DataFrame:
    """Confusion counts and rates at every grid threshold, from one pass over the rows.

    Rows are counted per grid bin; running sums over the ``points + 1`` bins then
    give every threshold's counts. Only bins are shuffled, never rows.
    """
    rows = df.select(
        *by,
        required_score(score).alias("score"),
        (binary_label(label) == 1).cast("bigint").alias("pos"),
        (binary_label(label) == 0).cast("bigint").alias("neg"),
    )
    return curve_of_counts(rows, by, low, high, points)


def curve_of_counts(
    counts: DataFrame,
    by: Sequence[str] = (),
    low: float = GRID_LOW,
    high: float = GRID_HIGH,
    points: int = GRID_POINTS,
) -> DataFrame:
    """The threshold curve of ``score, pos, neg`` rows, however far they are combined."""
    by = list(by)
    binned = counts.select(
        *by, reached_thresholds(F.col("score"), low, high, points).alias("bin"), "pos", "neg"
    )
    sums = binned.groupBy(*by, "bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # A key's bins, at most points + 1 of them, laid out so that empty ones are there too.
    entry = F.struct(F.col("bin"), F.struct("pos", "neg"))
    found = sums.groupBy(*by).agg(F.map_from_entries(F.collect_list(entry)).alias("_bins"))
    laid = found.select(*by, "_bins", F.explode(F.sequence(F.lit(0), F.lit(points))).alias("bin"))
    at = F.try_element_at("_bins", F.col("bin"))
    zero = F.lit(0).cast("bigint")
    full = laid.select(
        *by, "bin", F.coalesce(at["pos"], zero).alias("pos"), F.coalesce(at["neg"], zero).alias("neg")
    )
    # At most points + 1 rows per window, fixed by the grid.
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    reached = group.orderBy(F.desc("bin")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    counts = full.select(
        *by,
        "bin",
        F.sum("pos").over(reached).alias("tp"),
        F.sum("neg").over(reached).alias("fp"),
        F.sum("pos").over(group).alias("pos_total"),
        F.sum("neg").over(group).alias("neg_total"),
    ).filter(F.col("bin") > 0)
    step = (high - low) / (points - 1)
    return with_rates(
        counts.select(
            *by,
            (F.lit(low) + (F.col("bin") - 1).cast("double") * F.lit(step)).alias("threshold"),
            (F.col("neg_total") - F.col("fp")).alias("tn"),
            "fp",
            (F.col("pos_total") - F.col("tp")).alias("fn"),
            "tp",
        )
    )


def best_threshold(curve: DataFrame, metric: str = "f1", by: Sequence[str] = ()) -> DataFrame:
    """The curve row with the highest ``metric``; the lowest threshold wins ties."""
    row = F.struct(*[name for name in curve.columns if name not in by])
    best = curve.groupBy(*by).agg(
        F.max_by(row, F.struct(F.col(metric), -F.col("threshold"))).alias("_best")
    )
    return best.select(*by, "_best.*")


def gather(frames: Sequence[DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """Join one-row-per-key summaries side by side by stacking and folding them.

    Each value column comes from exactly one frame, so the maximum over the
    stacked rows is that value; no join strategy or size guess is involved.
    """
    by = list(by)
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    names = [name for name in stacked.columns if name not in by]
    return stacked.groupBy(*by).agg(*[F.max(name).alias(name) for name in names])
