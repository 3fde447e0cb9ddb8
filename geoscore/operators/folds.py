"""Stratified grouped folds: a group is never split, classes stay balanced."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from geoscore.functions.scores import binary_label, required
from geoscore.functions.spatial import CELLS_PER_DEGREE, grid_cell_bound, grid_index
from geoscore.operators.ordering import numbered
from geoscore.sources.storage import store

# Number of folds and the shuffle seed.
FOLDS, SEED = 5, 42
# Groups up to this many (about 40 bytes each) are dealt by one task and broadcast.
BROADCAST_GROUPS = 1_000_000
# A group with more than one in so many rows of a class is placed by itself; hands of the rest per fold.
HEAVY_PARTS, HANDS = 1_000, 20


def group_counts(df: DataFrame, group: str | Sequence[str], label: str) -> DataFrame:
    """Positive and negative rows per group, combined before the shuffle."""
    keys = [group] if isinstance(group, str) else list(group)
    y = binary_label(label)
    return df.groupBy(*keys).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")
    )


def _deal_order(group: str, seed: int | None) -> list[Column]:
    order = [F.desc("pos"), F.desc("neg")]
    if seed is not None:
        order.append(F.xxhash64(F.col(group), F.lit(seed)).asc())
    return [*order, F.col(group).asc()]


def deal_folds(
    groups: DataFrame,
    group: str,
    folds: int = FOLDS,
    seed: int | None = None,
    most_groups: int | None = None,
) -> DataFrame:
    """The group counts with a ``fold``: groups, largest first, dealt back and forth over the folds.

    ``most_groups`` states a bound on the number of groups. Within
    ``BROADCAST_GROUPS`` the deal is one small window, and the query fails if the
    bound does not hold; otherwise groups are numbered in parallel slices.
    ``seed`` shuffles groups of equal size.
    """
    order = _deal_order(group, seed)
    if _bounded(most_groups):
        rn = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - F.lit(1)
        dealt = groups.withColumn("rn", rn).withColumn(
            "rn",
            F.when(F.col("rn") < most_groups, F.col("rn")).otherwise(
                F.raise_error(F.lit(f"more than {most_groups} groups"))
            ),
        )
    else:
        dealt = numbered(groups, order)
    turn = F.pmod(F.col("rn"), F.lit(2 * folds))
    fold = F.when(turn < folds, turn).otherwise(F.lit(2 * folds - 1) - turn)
    return dealt.select(*groups.columns, fold.cast("int").alias("fold"))


def balanced_placing(shares: Sequence[tuple[float, float]], folds: int) -> list[int]:
    """A fold for each group of ``(positive, negative)`` shares, one by one in the order given.

    Each goes where it adds least to the folds' squared shares of both classes, which is
    where it least upsets the balance; the fold with the lower number wins ties.
    """
    held = [[0.0, 0.0] for _ in range(folds)]
    placed = []
    for share in shares:
        fold = min(range(folds), key=lambda f: held[f][0] * share[0] + held[f][1] * share[1])
        held[fold] = [h + s for h, s in zip(held[fold], share)]
        placed.append(fold)
    return placed


def deal_heavy(
    groups: DataFrame,
    group: str,
    folds: int = FOLDS,
    seed: int | None = None,
    most_groups: int | None = None,
    parts: int = HEAVY_PARTS,
) -> DataFrame:
    """As :func:`deal_folds`, but balanced when a few groups hold much of a class.

    A group with more than one in ``parts`` of either class is heavy; there are fewer than
    ``2 * parts`` of these at any size of table. The others are dealt back and forth over
    ``HANDS`` hands for each fold. The driver then places heavy groups and hands one by one,
    largest first. The deal is stored.
    """
    spark = groups.sparkSession
    groups = store(groups, "groups")
    pos, neg = groups.agg(F.coalesce(F.sum("pos"), F.lit(0)), F.coalesce(F.sum("neg"), F.lit(0))).first()
    is_heavy = (F.col("pos") * parts > pos) | (F.col("neg") * parts > neg)
    tail = store(
        deal_folds(groups.filter(~is_heavy), group, folds * HANDS, seed, most_groups)
        .withColumnRenamed("fold", "hand"),
        "hands",
    )
    kind = groups.schema[group].dataType
    hands = tail.groupBy("hand").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    units = hands.select("hand", F.lit(None).cast(kind).alias(group), "pos", "neg").unionByName(
        groups.filter(is_heavy).select(F.lit(None).cast("int").alias("hand"), group, "pos", "neg")
    )
    # Bounded by folds, HANDS and parts.
    rows = [
        (r["hand"], r[group], r["pos"] / max(pos, 1), r["neg"] / max(neg, 1)) for r in units.collect()
    ]
    # Heavy groups before hands of the same size, then by name.
    rows.sort(key=lambda r: (-(r[2] ** 2 + r[3] ** 2), r[0] is not None, r[0] if r[0] is not None else r[1]))
    placed = balanced_placing([r[2:] for r in rows], folds)
    of_hand = {r[0]: fold for r, fold in zip(rows, placed) if r[0] is not None}
    of_group = [(r[1], fold) for r, fold in zip(rows, placed) if r[0] is None]
    hand_folds = F.array(*[F.lit(of_hand.get(h, 0)) for h in range(folds * HANDS)])
    light = tail.select(*groups.columns, F.get(hand_folds, F.col("hand")).alias("fold"))
    schema = T.StructType([T.StructField(group, kind), T.StructField("fold", T.IntegerType())])
    heavy = groups.join(F.broadcast(spark.createDataFrame(of_group, schema)), group)
    return store(light.unionByName(heavy.select(*groups.columns, "fold")), "deal")


def _bounded(most_groups: int | None) -> bool:
    return most_groups is not None and most_groups <= BROADCAST_GROUPS


def _join_folds(df: DataFrame, fold_map: DataFrame, keys: list[str], bounded: bool) -> DataFrame:
    """A bounded fold map is broadcast, so rows stay where they are. Without a bound
    the join is left to adaptive execution, which splits a hot group's partition."""
    return df.join(F.broadcast(fold_map) if bounded else fold_map, keys)


def assign_folds(
    df: DataFrame,
    group: str,
    label: str,
    folds: int = FOLDS,
    seed: int | None = None,
    most_groups: int | None = None,
    heavy: bool = False,
) -> DataFrame:
    """Every row with its group's ``fold``; a NULL group fails the query.

    ``heavy`` deals by :func:`deal_heavy`.
    """
    dtype = df.schema[group].dataType.simpleString()
    keyed = df.withColumn(group, required(group, f"{group} is NULL", dtype))
    deal = deal_heavy if heavy else deal_folds
    dealt = deal(group_counts(keyed, group, label), group, folds, seed, most_groups)
    return _join_folds(keyed, dealt.select(group, "fold"), [group], _bounded(most_groups))


def assign_spatial_folds(
    df: DataFrame,
    latitude: str,
    longitude: str,
    label: str,
    folds: int = FOLDS,
    seed: int | None = None,
    cells_per_degree: int = CELLS_PER_DEGREE,
    heavy: bool = False,
) -> DataFrame:
    """Every row with its grid ``cell`` and that cell's ``fold``; ``heavy`` deals by :func:`deal_heavy`.

    Coordinates outside +-90 and +-360 degrees fail the query; inside, the grid
    itself bounds the number of cells. Rows are grouped and joined by the grid's
    row and column numbers; the cell's text key is made once per cell.
    """

    def index(name: str, limit: float) -> Column:
        inside = F.when(F.abs(F.col(name)) <= limit, grid_index(name, cells_per_degree))
        return required(inside, f"{name} is missing or off the globe", "bigint")

    keys = ["_row", "_column"]
    keyed = df.withColumns({"_row": index(latitude, 90.0), "_column": index(longitude, 360.0)})
    cells = group_counts(keyed, keys, label).withColumn("cell", F.concat_ws("_", *keys))
    bound = grid_cell_bound(cells_per_degree)
    dealt = (deal_heavy if heavy else deal_folds)(cells, "cell", folds, seed, bound)
    return _join_folds(keyed, dealt.select(*keys, "cell", "fold"), keys, _bounded(bound)).drop(*keys)


def fold_balance(df: DataFrame, label: str, group: str = "cell") -> DataFrame:
    """Rows per class and groups per fold, from one pass over the rows."""
    y = binary_label(label)
    per_group = df.groupBy("fold", group).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")
    )
    return per_group.groupBy("fold").agg(
        F.count(F.lit(1)).alias("groups"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )


def split_groups(df: DataFrame, group: str = "cell") -> DataFrame:
    """Groups found in more than one fold: no rows when folds do not leak."""
    return (
        df.groupBy(group)
        .agg(F.min("fold").alias("fold_min"), F.max("fold").alias("fold_max"))
        .filter(F.col("fold_min") != F.col("fold_max"))
    )
