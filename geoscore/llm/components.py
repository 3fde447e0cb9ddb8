"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoscore.sources.storage import store


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(``node``, ``label``): each linked node and the smallest node it can reach.

    Every round gives each node its smallest neighbour, follows those pointers to their
    roots, and keeps the links between different roots. A round at least halves the roots
    that still have links; stars and cliques take one. Minima combine before the shuffle,
    and a hub's links meet the one row that renames it in a join that can be split.
    """
    edges = store(
        links.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b"))
        .filter(F.col("a") < F.col("b"))
        .distinct(),
        "links",
    )
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(
            edges.select(F.col("b").alias("node"), F.col("a").alias("to"))
        )
        roots = both.groupBy("node").agg(F.min("to").alias("to"))
        roots = store(roots.select("node", F.least("node", "to").alias("label")), "roots")
        while True:
            onward = roots.select(F.col("node").alias("label"), F.col("label").alias("next"))
            jumped = roots.join(onward, "label")
            jumped = store(jumped.select("node", F.col("label").alias("was"), F.col("next").alias("label")), "roots")
            roots = jumped.select("node", "label")
            if jumped.filter("was <> label").isEmpty():
                break
        if labels is None:
            labels = roots
        else:
            renamed = roots.select(F.col("node").alias("label"), F.col("label").alias("next"))
            labels = labels.join(renamed, "label", "left").select(
                "node", F.coalesce("next", "label").alias("label")
            )
        for end in ("a", "b"):
            edges = edges.join(roots.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("label", end)
        edges = store(
            edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
            "links",
        )
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return store(labels, "labels")
