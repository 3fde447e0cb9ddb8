"""A fitted ensemble as a table of nodes, rows scored by path conditions, and staged evaluation.

The table has a row per node: ``tree, node, feature, threshold, categories, left, right,
value, weight``. A leaf's path from the root is a list of conditions; a row falls into the
one leaf of each tree whose conditions all hold. Scores need no model object, rounds can be
cut off behind any tree, and two fits compare row by row. All of it is of a model's size.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoscore.functions.scores import binary_label
from geoscore.plans.learners import FEATURES_COL, prepare
from geoscore.plans.model import FittedLearner, RiskModel
from geoscore.sources.storage import scratch_path

_LEAF = (
    "struct<value:double,path:array<struct<feature:int,threshold:double,categories:array<double>,goes_left:boolean>>>"
)
_TREES = f"array<struct<weight:double,leaves:array<{_LEAF}>>>"


def node_table(spark: SparkSession, fitted: FittedLearner) -> DataFrame:
    """Nodes of every tree. A boosted leaf has its part of the margin, a forest leaf its share of class 1."""
    path = scratch_path(spark, f"nodes-{fitted.name}")
    fitted.model.write().save(path)
    weights = spark.read.parquet(f"{path}/treesMetadata").select(F.col("_1").alias("tree"), F.col("_3").alias("weight"))
    node, split = F.col("nodeData"), F.col("nodeData.split")
    stats = node["impurityStats"]
    share = stats[1] / F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)
    inner, numeric = node["leftChild"] >= 0, split["numCategories"] < 0
    values = split["leftCategoriesOrThreshold"]
    return (
        spark.read.parquet(f"{path}/data")
        .withColumnRenamed("treeID", "tree")
        .join(weights, "tree")
        .select(
            "tree",
            node["id"].alias("node"),
            F.when(inner, split["featureIndex"]).alias("feature"),
            F.when(inner & numeric, F.get(values, F.lit(0))).alias("threshold"),
            F.when(inner & ~numeric, F.array_sort(values)).alias("categories"),
            F.when(inner, node["leftChild"]).alias("left"),
            F.when(inner, node["rightChild"]).alias("right"),
            F.when(~inner, node["prediction"] if fitted.kind == "boosted" else share).alias("value"),
            "weight",
        )
    )


def leaf_paths(nodes: DataFrame, depth: int = 30) -> DataFrame:
    """``tree, node, value, weight, path``: each leaf with the conditions that lead to it."""
    path_type = "array<struct<feature:int,threshold:double,categories:array<double>,goes_left:boolean>>"
    at = nodes.filter("node = 0").select("tree", "node", F.array().cast(path_type).alias("path"))
    leaves = None
    for _ in range(depth + 1):
        here = at.join(nodes, ["tree", "node"])
        found = here.filter("left is null").select("tree", "node", "value", "weight", "path")
        leaves = found if leaves is None else leaves.unionByName(found)
        sides = F.array(
            *[
                F.struct(F.col(side).alias("node"), F.lit(side == "left").alias("goes_left"))
                for side in ("left", "right")
            ]
        )
        inner = here.filter("left is not null").select("tree", "path", "feature", "threshold", "categories", F.explode(sides).alias("s"))
        condition = F.struct("feature", "threshold", "categories", F.col("s.goes_left").alias("goes_left"))
        at = inner.select("tree", F.col("s.node").alias("node"), F.concat("path", F.array(condition)).alias("path"))
    return leaves


@dataclass(frozen=True)
class Ensemble:
    """A learner's trees in order, each with its weight and its leaves."""

    kind: str
    trees: tuple[dict, ...]

    @classmethod
    def of(cls, spark: SparkSession, fitted: FittedLearner) -> Ensemble:
        depth = fitted.model.getMaxDepth()
        rows = leaf_paths(node_table(spark, fitted), depth)
        by_tree = rows.groupBy("tree", "weight").agg(
            F.array_sort(F.collect_list(F.struct("node", "value", "path"))).alias("leaves")
        )
        # As large as the model itself: at most 2**depth leaves for each tree.
        found = by_tree.select("tree", F.to_json(F.struct("weight", "leaves")).alias("j")).orderBy("tree").collect()
        return cls(fitted.kind, tuple(json.loads(r["j"]) for r in found))

    def upto(self, rounds: int) -> Ensemble:
        """The first ``rounds`` trees alone."""
        return replace(self, trees=self.trees[:rounds])

    def parts(self, features: Column) -> Column:
        """What each tree adds for a row with these encoded features (an array), in order."""
        trees = F.from_json(F.lit(json.dumps(self.trees)), _TREES)

        def holds(c: Column) -> Column:
            x = F.get(features, c["feature"])
            left = F.coalesce(x <= c["threshold"], F.array_contains(c["categories"], x))
            return left == c["goes_left"]

        def value(leaves: Column) -> Column:
            step = lambda a, leaf: F.when(F.forall(leaf["path"], holds), leaf["value"]).otherwise(a)
            return F.aggregate(leaves, F.lit(None).cast("double"), step)

        return F.transform(trees, lambda t: value(t["leaves"]) * t["weight"])

    def probability(self, total: Column, trees: Column) -> Column:
        """The class 1 probability of a sum of so many trees' parts."""
        return 1 / (1 + F.exp(-2 * total)) if self.kind == "boosted" else total / trees


def encoded(model: RiskModel, df: DataFrame) -> DataFrame:
    """``df`` with the model's feature vector as an array ``encoded``."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *model.features)
    out = model.encoder.transform(prepare(rows, model.features, model.missing_indicators))
    kept = [F.col("_row")[c].alias(c) for c in df.columns if c != "encoded"]
    return out.select(*kept, vector_to_array(FEATURES_COL).alias("encoded"))


def score_by_nodes(model: RiskModel, df: DataFrame, ensembles: dict[str, Ensemble]) -> DataFrame:
    """Adds ``n_<learner>``, each ensemble's probability by its table of nodes."""
    rows = encoded(model, df)
    for name, e in ensembles.items():
        total = F.aggregate(e.parts(F.col("encoded")), F.lit(0.0), lambda a, x: a + x)
        rows = rows.withColumn(f"n_{name}", e.probability(total, F.lit(float(len(e.trees)))))
    return rows.drop("encoded")


def staged_log_loss(model: RiskModel, df: DataFrame, ensemble: Ensemble, label: str, every: int = 10) -> DataFrame:
    """``rounds, rows, log_loss``: the loss after every so many trees, in one pass over ``df``.

    A row gives one value per stage; stages combine before they are shuffled.
    """
    n = len(ensemble.trees)
    stages = [*range(every, n, every), n]
    rows = encoded(model, df).select(binary_label(label).alias("_y"), ensemble.parts(F.col("encoded")).alias("_parts"))
    add = lambda a, x: a + x
    steps = F.array(*[F.lit(s) for s in stages])
    own = F.transform(
        steps, lambda s: F.aggregate(F.slice("_parts", s - (s - 1) % every, (s - 1) % every + 1), F.lit(0.0), add)
    )
    rows = rows.select("_y", own.alias("_own")).select("_y", "_own", F.posexplode(steps).alias("_at", "rounds"))
    total = F.aggregate(F.slice("_own", 1, F.col("_at") + 1), F.lit(0.0), add)
    p = ensemble.probability(total, F.col("rounds").cast("double"))
    p = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = -F.when(F.col("_y") == 1, F.log(p)).otherwise(F.log(1 - p))
    return rows.select("rounds", loss.alias("_loss")).groupBy("rounds").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("_loss").alias("log_loss")
    )


def best_round(losses: DataFrame) -> int:
    """The fewest trees with the smallest loss."""
    return losses.agg(F.min_by("rounds", F.struct("log_loss", "rounds"))).first()[0]


def differing_nodes(left: DataFrame, right: DataFrame) -> DataFrame:
    """``nodes, differing``: nodes of two ensembles, and those that the other hasn't just so."""
    columns = ["tree", "node", "feature", "threshold", "categories", "left", "right", "value", "weight"]
    row = F.struct(*columns)
    a = left.select("tree", "node", row.alias("a"))
    b = right.select("tree", "node", row.alias("b"))
    both = a.join(b, ["tree", "node"], "full")
    return both.agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("differing")
    )
