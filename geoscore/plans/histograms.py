"""Boosted trees and forests from counts per bin: the numpy side of training.

Rows travel in chunks: codes of every column (a number's bin, or the level of a text feature),
the label and, for boosting, the margin. A level of a tree needs only sums per node, column and
code. Gradients are rounded to multiples of a power of two so small that their sums are exact:
a sum doesn't depend on how rows are dealt to tasks, and neither do trees.

Gradients, leaf values, step sizes and class weights are those of Spark ML's boosted trees
(logistic loss, variance of the gradients) and forests (Gini); its model classes score them.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark import cloudpickle

# Tasks may run where this package is not installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows of a chunk: what a task holds at a time.
CHUNK_ROWS = 500_000
# Rows that are counted at a time: few enough for a core's cache.
TILE_ROWS = 32_768
# Order statistics a chunk gives for each number; cuts are taken from those of all chunks.
SKETCH = 2048
# Nodes of a forest's tree whose splits are found, or sent, at a time.
NODES = 32
# A split must gain more than sums of doubles can be off by.
NOISE = 1e-12


@dataclass(frozen=True)
class Columns:
    """How encoded features are held: numbers first, then one code per group of indicators."""

    numbers: tuple[int, ...]
    groups: tuple[tuple[int, int], ...]  # first indicator, number of levels
    cuts: tuple[np.ndarray, ...] = ()

    @property
    def width(self) -> int:
        """Codes per column, the largest count of all columns."""
        return max([len(c) + 1 for c in self.cuts] + [size + 1 for _, size in self.groups])

    @property
    def code_type(self):
        return np.uint8 if self.width <= 256 else np.uint16 if self.width <= 65_536 else np.uint32

    @property
    def features(self) -> int:
        return len(self.numbers) + sum(size for _, size in self.groups)

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Each feature's column, and its level there (-1: a number)."""
        column = np.zeros(self.features, np.int64)
        level = np.full(self.features, -1, np.int64)
        column[list(self.numbers)] = np.arange(len(self.numbers))
        for g, (first, size) in enumerate(self.groups):
            column[first : first + size] = len(self.numbers) + g
            level[first : first + size] = np.arange(size)
        return column, level


@dataclass(frozen=True)
class Raw:
    """Rows as packed: number values and level codes, before cuts are known."""

    key: tuple[int, int]  # task of the layout, block in it
    values: np.ndarray  # numbers x rows
    levels: np.ndarray  # groups x rows
    label: np.ndarray


@dataclass(frozen=True)
class Chunk:
    codes: np.ndarray  # columns x rows
    label: np.ndarray
    parts: tuple[tuple[tuple[int, int], int], ...]  # key and rows of each block
    margin: np.ndarray

    def draws(self, seed: int, tree: int, draw) -> np.ndarray:
        """What ``draw(generator, rows)`` gives for every row, by block."""
        return np.concatenate([draw(np.random.default_rng([seed, tree, *key]), n) for key, n in self.parts])


def pack(columns: Columns, key: tuple[int, int], vectors: np.ndarray, label: np.ndarray) -> Raw:
    """Encoded vectors (rows x features) by column; a row without a level has the code behind the last."""
    values = np.ascontiguousarray(vectors[:, list(columns.numbers)].T)
    levels = np.empty((len(columns.groups), len(vectors)), np.uint32)
    for g, (first, size) in enumerate(columns.groups):
        marks = vectors[:, first : first + size] > 0.5
        levels[g] = np.where(marks.any(1), marks.argmax(1), size) if size else 0
    return Raw(key, values, levels, label.astype(np.uint8))


def sketch(raw: Raw) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    """``column, (values, rows)`` per number: all its values, or evenly spaced ones that stand for equal shares."""
    for c, values in enumerate(raw.values):
        found, rows = np.unique(values, return_counts=True)
        if len(found) > SKETCH:
            ordered, edges = np.sort(values), np.linspace(0, len(values), SKETCH + 1).astype(np.int64)
            found, rows = ordered[(edges[:-1] + edges[1:] - 1) // 2], np.diff(edges)
        yield c, (found, rows)


def cuts_of(sketches: Iterable[tuple[np.ndarray, np.ndarray]], bins: int) -> np.ndarray:
    """Cuts between values, at every value's end if there are few, else at even shares of the rows."""
    values, rows = (np.concatenate(x) for x in zip(*sketches))
    found, at = np.unique(values, return_inverse=True)
    rows = np.bincount(at, weights=rows)
    if len(found) < 2:
        return np.empty(0)
    ends = np.arange(len(found) - 1)
    if len(found) > bins:
        reached = np.cumsum(rows)
        ends = np.unique(np.searchsorted(reached, reached[-1] * np.arange(1, bins) / bins))
        ends = ends[ends < len(found) - 1]
    low, high = found[ends], found[ends + 1]
    with np.errstate(all="ignore"):
        middle = low + (high - low) / 2
    return np.where(np.isfinite(middle), middle, low)


def bin_rows(columns: Columns, raw: Raw) -> Chunk:
    """A value's code is the number of cuts below it, so ``code <= k`` where ``value <= cuts[k]``."""
    codes = np.empty((len(raw.values) + len(raw.levels), len(raw.label)), columns.code_type)
    for c, values in enumerate(raw.values):
        codes[c] = np.searchsorted(columns.cuts[c], values, side="left")
    codes[len(raw.values) :] = raw.levels
    return Chunk(codes, raw.label, ((raw.key, len(raw.label)),), np.zeros(len(raw.label)))


def merge(chunks: Iterable[Chunk], most: int | None = None) -> Iterator[Chunk]:
    """Neighbouring chunks as one, as long as they hold at most ``most`` rows, by default ``CHUNK_ROWS``."""
    most = CHUNK_ROWS if most is None else most
    held: list[Chunk] = []

    def joined() -> Chunk:
        return Chunk(
            np.concatenate([c.codes for c in held], 1),
            np.concatenate([c.label for c in held]),
            tuple(p for c in held for p in c.parts),
            np.concatenate([c.margin for c in held]),
        )

    for chunk in chunks:
        if held and sum(len(c.label) for c in held) + len(chunk.label) > most:
            yield joined()
            held = []
        held.append(chunk)
    if held:
        yield joined()


@dataclass(frozen=True)
class Plan:
    """What a learner's trees are grown by."""

    kind: str
    columns: Columns
    trees: int
    depth: int
    seed: int
    step: float
    row_share: float
    node_features: int
    least_rows: int
    pos_weight: float
    rows: int

    @property
    def scale(self) -> float:
        """Gradients times class weight are at most 4 * pos_weight; sums of their multiples stay below 2**52."""
        largest = 4.0 * max(self.pos_weight, 1.0) * max(self.rows, 1)
        return 2.0 ** min(40, 51 - math.ceil(math.log2(largest)))

    def weight(self, tree: int) -> float:
        return 1.0 if self.kind == "forest" or tree == 0 else self.step

    def offered(self, tree: int, node: int) -> np.ndarray:
        """Features a node may split, in ascending order."""
        n = self.columns.features
        if self.node_features >= n:
            return np.arange(n)
        return np.sort(np.random.default_rng([self.seed, tree, node, 1]).permutation(n)[: self.node_features])


# Fields of a node. ``cut`` is the last code that goes left, or the level that goes right.
FIELDS = ("feature", "column", "cut", "level", "threshold", "left", "right", "neg", "pos", "total", "gain", "depth")


@dataclass
class Tree:
    """Nodes in the order they were found, so children come behind their parents; leaves lead to themselves."""

    nodes: list[list] = field(default_factory=list)
    open: list[int] = field(default_factory=lambda: [0])

    def add(self, neg: float, pos: float, total: float, depth: int) -> int:
        at = len(self.nodes)
        self.nodes.append([-1, 0, -1, -1, 0.0, at, at, neg, pos, total, -1.0, depth])
        return at

    def grow(self, plan: Plan, splits: list[tuple | None]) -> None:
        """Splits the open nodes; their children are open next, unless too deep, too small or pure."""
        reached, self.open = self.open, []
        for node, split in zip(reached, splits):
            if split is None:  # no row was drawn
                split = ((0.0, 0.0, 0.0), -1, 0, -1, -1, 0.0, -1.0, (), ())
            whole, feature, column, cut, level, threshold, gain, left, right = split
            if not self.nodes:
                self.add(*whole, 0)
            if feature < 0:
                continue
            depth = self.nodes[node][-1] + 1
            children = [self.add(*side, depth) for side in (left, right)]
            self.nodes[node][:7] = [feature, column, cut, level, threshold, *children]
            self.nodes[node][10] = gain
            for child, (neg, pos, _) in zip(children, (left, right)):
                pure = plan.kind == "forest" and (neg == 0 or pos == 0)
                if depth < plan.depth and neg + pos >= 2 * plan.least_rows and not pure:
                    self.open.append(child)

    def arrays(self) -> dict[str, np.ndarray]:
        """Each field of all nodes."""
        table = list(zip(*self.nodes)) if self.nodes else [[] for _ in FIELDS]
        whole = {"feature", "column", "cut", "level", "left", "right", "depth"}
        return {f: np.array(x, np.int64 if f in whole else np.float64) for f, x in zip(FIELDS, table)}


def leaf_values(plan: Plan, tree: dict[str, np.ndarray]) -> np.ndarray:
    """The mean gradient of every node."""
    weight = tree["neg"] + plan.pos_weight * tree["pos"]
    return np.divide(tree["total"], weight, out=np.zeros(len(weight)), where=weight > 0)


def descend(tree: dict[str, np.ndarray], codes: np.ndarray, at: np.ndarray, steps: int, width: int) -> np.ndarray:
    """The node each row reaches after so many steps."""
    n, nodes = codes.shape[1], len(tree["column"])
    flat, rows, start = codes.ravel(), np.arange(n), tree["column"] * n
    sides, cut, level = np.stack([tree["right"], tree["left"]], 1).ravel(), tree["cut"], tree["level"]
    # With many rows, the way of every node and code is found once.
    known = n >= nodes * width
    if known:
        every = np.arange(width)
        left = np.where(level[:, None] < 0, every <= cut[:, None], every != level[:, None])
        ways = np.where(left, tree["left"][:, None], tree["right"][:, None]).ravel()
    for _ in range(steps):
        code = flat[start[at] + rows].astype(np.int64)
        if known:
            at = ways[at * width + code]
        else:
            mark = level[at]
            at = sides[2 * at + np.where(mark < 0, code <= cut[at], code != mark)]
    return at


def gradients(plan: Plan, label: np.ndarray, margin: np.ndarray, tree: int) -> np.ndarray:
    """Weighted gradients as exact multiples of ``1 / plan.scale``; the first tree learns the label itself."""
    sign = 2.0 * label - 1.0
    if tree:
        with np.errstate(over="ignore"):
            value = 4.0 * sign / (1.0 + np.exp(2.0 * sign * margin))
    else:
        value = sign
    return np.rint(value * np.where(label == 1, plan.pos_weight, 1.0) * plan.scale)


def sampled(plan: Plan, chunk: Chunk, tree: int) -> np.ndarray | None:
    """Whether a boosted tree learns from each row; None for all."""
    if plan.row_share >= 1.0:
        return None
    return chunk.draws(plan.seed, tree, lambda g, n: g.random(n, np.float32) < plan.row_share)


def slots(tree: Tree, at: np.ndarray) -> np.ndarray:
    """Each row's place among the open nodes, or behind the last."""
    place = np.full(max(len(tree.nodes), 1), len(tree.open), np.int64)
    place[tree.open] = np.arange(len(tree.open))
    return place[at]


def boosted_counts(plan: Plan, codes: np.ndarray, label: np.ndarray, gradient: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
    """open nodes x (negatives, positives, gradients) x columns x codes."""
    width = plan.columns.width
    size = (n + 1) * 2 * width
    kinds, sums = np.zeros((len(codes), size), np.int64), np.zeros((len(codes), size))
    held = np.empty(TILE_ROWS, np.int64)
    for start in range(0, len(label), TILE_ROWS):
        tile = slice(start, start + TILE_ROWS)
        base, part = (slot[tile] * 2 + label[tile]) * width, gradient[tile]
        index = held[: len(base)]
        for c, code in enumerate(codes[:, tile]):
            np.add(base, code, out=index)
            kinds[c] += np.bincount(index, minlength=size)
            sums[c] += np.bincount(index, part, size)
    kinds, sums = (x.reshape(len(codes), n + 1, 2, width)[:, :n] for x in (kinds, sums))
    return np.concatenate([kinds, sums.sum(2, keepdims=True)], 2).transpose(1, 2, 0, 3)


def feature_places(columns: Columns) -> np.ndarray:
    """The feature that a split behind a code of a column is of; one past the last for none."""
    at = np.full((len(columns.numbers) + len(columns.groups), columns.width), columns.features, np.int64)
    for c, feature in enumerate(columns.numbers):
        at[c, : len(columns.cuts[c])] = feature
    for g, (first, size) in enumerate(columns.groups):
        at[len(columns.numbers) + g, :size] = np.arange(first, first + size)
    return at


def boosted_splits(plan: Plan, tree: int, nodes: list[int], counts: np.ndarray, places: np.ndarray) -> list[tuple | None]:
    """The best split of each node, by the sums of all rows."""
    columns, scale = plan.columns, plan.scale
    first_group = len(columns.numbers)
    whole = counts[:, :, 0].sum(-1)
    left = np.empty_like(counts)
    np.cumsum(counts[:, :, :first_group], axis=-1, out=left[:, :, :first_group])
    # An indicator's ones go right.
    left[:, :, first_group:] = whole[:, :, None, None] - counts[:, :, first_group:]
    neg, pos, total = left[:, 0], left[:, 1], left[:, 2] / scale

    may = np.zeros((len(nodes), columns.features + 1), bool)
    for i, node in enumerate(nodes):
        may[i, plan.offered(tree, node)] = True
    least, rows = max(plan.least_rows, 1), neg + pos
    allowed = may[:, places]
    allowed &= (rows >= least) & (rows <= (whole[:, 0] + whole[:, 1] - least)[:, None, None])

    w, sums = whole[:, 0] + plan.pos_weight * whole[:, 1], whole[:, 2] / scale
    weight = neg + plan.pos_weight * pos
    with np.errstate(all="ignore"):
        parts = total**2 / weight + (sums[:, None, None] - total) ** 2 / (w[:, None, None] - weight)
        gain = parts - (sums**2 / w)[:, None, None]
        allowed &= gain > NOISE * parts
    gain[~allowed] = -1.0
    best = gain.reshape(len(nodes), -1).argmax(1)
    out = []
    for i, (c, k) in enumerate(zip(*np.unravel_index(best, gain.shape[1:]))):
        near = left[i, :, c, k]
        sides = [(float(x[0]), float(x[1]), float(x[2]) / scale) for x in (whole[i], near, whole[i] - near)]
        out.append(_split(plan, sides, int(c), int(k), float(gain[i, c, k]), float(w[i]), int(places[c, k])))
    return out


def _split(plan: Plan, sides, column: int, code: int, gain: float, weight: float, feature: int) -> tuple | None:
    whole, left, right = sides
    if whole[0] + whole[1] == 0:
        return None
    if gain <= 0:
        return whole, -1, 0, -1, -1, 0.0, -1.0, whole, whole
    grouped = column >= len(plan.columns.numbers)
    threshold = 0.5 if grouped else float(plan.columns.cuts[column][code])
    return whole, feature, column, -1 if grouped else code, code if grouped else -1, threshold, gain / weight, left, right


def forest_offers(plan: Plan, tree: int, nodes: list[int]) -> np.ndarray:
    return np.array([plan.offered(tree, node) for node in nodes], np.int64).reshape(len(nodes), -1)


def forest_counts(plan: Plan, chunk_codes, label, times, slot, offers: np.ndarray) -> np.ndarray:
    """open nodes x offered features x (negatives, positives) x codes, rows counted as often as drawn."""
    n, k = offers.shape
    width = plan.columns.width
    inside = slot < n
    rows, slot = np.flatnonzero(inside), slot[inside]
    label, times = label[rows], times[rows]
    column, level = plan.columns.places()
    out = np.empty((n, k, 2, width))
    base = (slot * 2 + label) * width
    for j in range(k):
        feature = offers[:, j][slot]
        code = chunk_codes[column[feature], rows].astype(np.int64)
        wanted = level[feature]
        code = np.where(wanted < 0, code, code == wanted)
        out[:, j] = np.bincount(base + code, times, n * 2 * width).reshape(n, 2, width)
    return out


def forest_splits(plan: Plan, offers: np.ndarray, counts: np.ndarray) -> list[tuple | None]:
    column, level = plan.columns.places()
    whole = counts[:, 0].sum(-1)
    left = np.cumsum(counts, -1)
    right = whole[:, None, :, None] - left
    pw = plan.pos_weight

    def purity(neg, pos):
        return (neg**2 + (pw * pos) ** 2) / (neg + pw * pos)

    least = max(plan.least_rows, 1)
    allowed = (left.sum(2) >= least) & (right.sum(2) >= least)
    with np.errstate(all="ignore"):
        parts = purity(left[:, :, 0], left[:, :, 1]) + purity(right[:, :, 0], right[:, :, 1])
        gain = parts - purity(whole[:, 0], whole[:, 1])[:, None, None]
    gain[~(allowed & (gain > NOISE * parts))] = -1.0
    best = gain.reshape(len(whole), -1).argmax(1)
    out = []
    for i, (j, k) in enumerate(zip(*np.unravel_index(best, gain.shape[1:]))):
        sides = [(float(x[0]), float(x[1]), 0.0) for x in (whole[i], left[i, j, :, k], right[i, j, :, k])]
        feature = int(offers[i, j])
        code = int(level[feature]) if level[feature] >= 0 else int(k)
        w = float(whole[i, 0] + pw * whole[i, 1])
        out.append(_split(plan, sides, int(column[feature]), code, float(gain[i, j, k]), w, feature))
    return out


def _tiles(rows: int) -> list[slice]:
    return [slice(start, start + TILE_ROWS) for start in range(0, rows, TILE_ROWS)]


def boosted_alone(plan: Plan, chunk: Chunk) -> list[Tree]:
    """All trees from one chunk, in one task. Beside the chunk it holds 21 bytes a row."""
    rows, width, places = len(chunk.label), plan.columns.width, feature_places(plan.columns)
    margin, gradient, at, tiles = np.zeros(rows), np.empty(rows), np.zeros(rows, np.int32), _tiles(rows)
    found = []
    for number in range(plan.trees):
        for t in tiles:
            gradient[t] = gradients(plan, chunk.label[t], margin[t], number)
        chosen, tree, before = sampled(plan, chunk, number), Tree(), {}
        at[:] = 0
        while tree.open:
            counted, derived = _by_less(tree, before)
            place = np.full(max(len(tree.nodes), 1), len(counted), np.int64)
            place[counted] = np.arange(len(counted))
            nodes, sums = tree.arrays() if tree.nodes else None, 0
            for t in tiles:
                codes = chunk.codes[:, t]
                if nodes is not None:
                    at[t] = descend(nodes, codes, at[t], 1, width)
                slot = place[at[t]]
                inside = slot < len(counted)
                if chosen is not None:
                    inside &= chosen[t]
                label, part = chunk.label[t], gradient[t]
                if not inside.all():
                    inside = np.flatnonzero(inside)
                    codes, label, part, slot = codes.take(inside, 1), label[inside], part[inside], slot[inside]
                sums = sums + boosted_counts(plan, codes, label, part, slot, len(counted))
            own = dict(zip(counted, sums))
            counts = np.stack([before[derived[n][0]] - own[derived[n][1]] if n in derived else own[n] for n in tree.open])
            before = dict(zip(tree.open, counts))
            tree.grow(plan, boosted_splits(plan, number, tree.open, counts, places))
        found.append(tree)
        nodes = tree.arrays()
        added = leaf_values(plan, nodes) * plan.weight(number)
        for t in tiles:
            margin[t] += added[descend(nodes, chunk.codes[:, t], at[t], 1, width)]
    return found


def _by_less(tree: Tree, before: dict) -> tuple[list[int], dict]:
    """The nodes to count. Of two children that is the smaller; the larger has what is left of the parent."""
    counted, derived = [], {}
    parents = {child: p for p in before for child in tree.nodes[p][5:7]}
    for node in tree.open:
        if node not in parents:
            counted.append(node)
            continue
        left, right = tree.nodes[parents[node]][5:7]
        less = min((left, right), key=lambda n: (tree.nodes[n][7] + tree.nodes[n][8], n))
        if less not in counted:
            counted.append(less)
        if node != less:
            derived[node] = (parents[node], less)
    return counted, derived


def margins(plan: Plan, codes: np.ndarray, tree: Tree, number: int) -> np.ndarray:
    """What a tree adds to every row's margin."""
    nodes = tree.arrays()
    at = descend(nodes, codes, np.zeros(codes.shape[1], np.int64), plan.depth, plan.columns.width)
    return (leaf_values(plan, nodes) * plan.weight(number))[at]


def bootstrap(plan: Plan, chunk: Chunk, number: int) -> np.ndarray:
    """How often each row is drawn for a tree, with replacement."""
    return chunk.draws(plan.seed, number, lambda g, n: g.poisson(1.0, n))


def forest_alone(plan: Plan, chunk: Chunk, numbers: Iterable[int]) -> list[Tree]:
    """These trees from one chunk, in one task. Beside the chunk it holds 5 bytes a row."""
    found, tiles, width = [], _tiles(len(chunk.label)), plan.columns.width
    for number in numbers:
        times = np.minimum(bootstrap(plan, chunk, number), 255).astype(np.uint8)
        tree, at = Tree(), np.zeros(len(times), np.int32)
        while tree.open:
            offers = forest_offers(plan, number, tree.open)
            nodes, sums = tree.arrays() if tree.nodes else None, 0
            for t in tiles:
                codes = chunk.codes[:, t]
                if nodes is not None:
                    at[t] = descend(nodes, codes, at[t], 1, width)
                slot = slots(tree, at[t])
                drawn = np.flatnonzero((times[t] > 0) & (slot < len(offers)))
                sums = sums + forest_counts(plan, codes.take(drawn, 1), chunk.label[t][drawn], times[t][drawn], slot[drawn], offers)
            steps = range(0, len(offers), NODES)
            tree.grow(plan, [s for i in steps for s in forest_splits(plan, offers[i : i + NODES], sums[i : i + NODES])])
        found.append(tree)
    return found


@dataclass(frozen=True)
class Flat:
    """All nodes of an ensemble in arrays; a leaf leads to itself."""

    kind: str
    depth: int
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    sides: np.ndarray  # right and left of each node
    value: np.ndarray  # a node's part of the margin, or its share of class 1

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Of class 1, for encoded rows given as features x rows: tree by tree, so that its nodes stay in the cache."""
        n = x.shape[1]
        flat, rows, start = np.ascontiguousarray(x).ravel(), np.arange(n), self.feature * n
        total = np.zeros(n)
        for root in self.roots:
            at = np.full(n, root)
            for _ in range(self.depth):
                at = self.sides[2 * at + (flat[start[at] + rows] <= self.threshold[at])]
            total += self.value[at]
        return 1.0 / (1.0 + np.exp(-2.0 * total)) if self.kind == "boosted" else total / len(self.roots)
