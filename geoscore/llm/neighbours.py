"""Nearest neighbours by largest inner product, with a vantage-point tree per shard.

Vectors get one more component that brings all to the norm of the longest; among those,
the largest inner product is the smallest Euclidean distance. Each shard of vectors is
built into a tree: a vantage point, the nearer half by rank of distance to it with the largest
distance there, and the farther half with the smallest. A block of queries goes down a tree together; a query skips a half that,
by the triangle inequality, can hold nothing nearer than its k-th best so far. ``factor``
multiplies the inequality's bound: 1 is exact, more skips more.

Every block of queries meets every shard, each in a task of its own; both are of bounded
size, and the best of the shards are ranked once more.

Defined results: vectors that are null, zero or hold null or non-finite components, and
rows without an id, take no part; vectors of different lengths never meet; rows repeating
an id count once, with the smallest vector; ties go to the smaller id; fewer candidates
than ``k`` give all of them; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoscore.sources.storage import store

K = 20
#: Vectors of a shard and queries of a block, on average.
SHARD = 16_384
BLOCK = 1_024
LEAF = 256
#: In place of an id that isn't there; the largest, so it loses every tie.
NOBODY = np.iinfo(np.int64).max


class Tree:
    """A vantage-point tree over vectors of one norm."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors = vectors
        self.root = self._build(np.arange(len(vectors)))

    def _build(self, rows: np.ndarray) -> tuple:
        """Halves by rank, so ties at one distance can't make a half too small."""
        if len(rows) <= LEAF:
            return (rows,)
        point = rows[len(rows) // 2]
        distance = np.sqrt(((self.vectors[rows] - self.vectors[point]) ** 2).sum(1))
        order = np.argsort(distance, kind="stable")
        rows, distance, half = rows[order], distance[order], len(rows) // 2
        inner, outer = self._build(rows[:half]), self._build(rows[half:])
        return point, distance[half - 1], distance[half], inner, outer


def measure(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component on."""
    total = np.zeros(len(left))
    for d in range(left.shape[1]):
        total += left[:, d] * right[:, d]
    return total


class Search:
    """The k best of a tree's vectors for a block of queries."""

    def __init__(self, tree: Tree, ids: np.ndarray, k: int, factor: float) -> None:
        self.tree, self.ids, self.k, self.factor = tree, ids, k, factor
        self.norm = float((tree.vectors[0] ** 2).sum())

    def run(self, queries: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.queries, self.own = queries, own
        self.square = (queries**2).sum(1)
        self.score = np.full((len(queries), self.k), -np.inf)
        self.found = np.full((len(queries), self.k), NOBODY)
        self._visit(self.tree.root, np.arange(len(queries)))
        return self.score, self.found

    def _reach(self, q: np.ndarray) -> np.ndarray:
        """Distance of each query's k-th best, with room for rounding."""
        worst = self.score[q, -1]
        gap = np.where(np.isinf(worst), np.inf, self.square[q] + self.norm - 2 * worst)
        return np.sqrt(np.maximum(gap, 0)) + 1e-7 * (1 + np.sqrt(self.norm))

    def _visit(self, node: tuple, q: np.ndarray) -> None:
        if not len(q):
            return
        if len(node) == 1:
            self._leaf(node[0], q)
            return
        point, low, high, inner, outer = node
        place = self.tree.vectors[point]
        gap = self.square[q] + self.norm - 2 * self.queries[q] @ place
        distance = np.sqrt(np.maximum(gap, 0))
        near = 2 * distance < low + high
        self._visit(inner, q[near])
        self._visit(outer, q[~near])
        # Then the other half, where the bound leaves a chance.
        for side, other, bound in ((near, outer, high - distance), (~near, inner, distance - low)):
            rest = q[side]
            self._visit(other, rest[self.factor * bound[side] <= self._reach(rest)])

    def _leaf(self, rows: np.ndarray, q: np.ndarray) -> None:
        for start in range(0, len(rows), 1024):  # equal vectors can make a leaf large
            part = rows[start : start + 1024]
            ids, base = self.ids[part], self.tree.vectors[part]
            # A matrix product finds what may be near enough; those are then summed one by
            # one, since equal vectors must get equal sums wherever they stand.
            rough = self.queries[q] @ base.T
            worst = self.score[q, -1]
            slack = 1e-9 * (1 + np.sqrt(self.square[q] * self.norm))
            at, place = np.nonzero(rough >= (worst - slack)[:, None])
            exact = measure(self.queries[q[at]], base[place])
            good = (exact >= worst[at]) & (self.own[q[at]] != ids[place])
            at, place, exact = at[good], place[good], exact[good]
            if not len(at):
                continue
            hit, row = np.unique(at, return_inverse=True)
            counts = np.bincount(row)
            column = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            new_scores = np.full((len(hit), counts.max()), -np.inf)
            new_ids = np.full(new_scores.shape, NOBODY)
            new_scores[row, column], new_ids[row, column] = exact, ids[place]
            mine = q[hit]
            all_scores = np.concatenate([self.score[mine], new_scores], axis=1)
            all_ids = np.concatenate([self.found[mine], new_ids], axis=1)
            order = np.lexsort((all_ids, -all_scores), axis=-1)[:, : self.k]
            self.score[mine] = np.take_along_axis(all_scores, order, 1)
            self.found[mine] = np.take_along_axis(all_ids, order, 1)


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = K,
    factor: float = 1.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard: int = SHARD,
    block: int = BLOCK,
) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id`` and ``score`` of each query's ``k`` nearest."""
    vector = F.col(vector_col).cast("array<double>").alias("_v")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("_id"), vector, is_query.alias("_q"))
    rows = rows.filter(usable(F.col("_v")) & F.col("_id").isNotNull()).groupBy("_id")
    rows = store(rows.agg(F.min("_v").alias("_v"), F.max("_q").alias("_q")), "vectors")
    square = F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x)
    n, asked, longest = rows.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.col("_q").cast("int")), F.lit(0)), F.coalesce(F.max(square), F.lit(0.0))
    ).first()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-asked // block))

    def dealt(df: DataFrame, own: int, other: int, name: str, across: str) -> DataFrame:
        """Each row in its shard or block, once for every block or shard it has to meet."""
        place = F.pmod(F.xxhash64("_id"), F.lit(own)).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
        return df.select("_id", "_v", F.size("_v").alias("dim"), place.alias(name), copies.alias(across))

    left = dealt(rows, shards, blocks, "shard", "block").groupBy("dim", "shard", "block")
    right = dealt(rows.filter("_q"), blocks, shards, "block", "shard").groupBy("dim", "shard", "block")

    def meet(base: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if base.empty or queries.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x, q = np.stack(base["_v"].to_numpy()), np.stack(queries["_v"].to_numpy())
        extra = np.sqrt(np.maximum(longest - (x**2).sum(1), 0))
        x = np.concatenate([x, extra[:, None]], axis=1)
        q = np.concatenate([q, np.zeros((len(q), 1))], axis=1)
        search = Search(Tree(x), base["_id"].to_numpy(), k, factor)
        own = queries["_id"].to_numpy()
        _, found = search.run(q, own)
        at, place = np.nonzero(found != NOBODY)
        row_of = pd.Series(np.arange(len(base)), index=base["_id"])
        hits = row_of.loc[found[at, place]].to_numpy()
        score = measure(q[at, :-1], x[hits, :-1])  # on the vectors as given
        return pd.DataFrame({"query_id": own[at], "vec_id": found[at, place], "score": score})

    met = left.cogroup(right).applyInPandas(meet, "query_id bigint, vec_id bigint, score double")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
