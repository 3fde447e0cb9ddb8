"""Fits of boosted trees and forests on Spark, by the counts of ``histograms``.

Encoded rows are laid out by content and packed into chunks of codes, about a byte for each column
and row. Up to ``ALONE_ROWS`` rows, a task grows all trees of a learner. Beyond, every level of a
tree is a job: tasks count their chunks one by one, counts meet by node, and the driver gets one
split per node. Both ways give the same trees.
"""

from __future__ import annotations

import json
import sys
import time
from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoscore.plans import histograms as h
from geoscore.plans.learners import FEATURES_COL, LABEL_COL, MODEL_CLASSES, Learner, encoded_names
from geoscore.sources.storage import drop, scratch_path

# Tasks may run where this package is not installed.
h.cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows up to which one task grows all trees of a learner: no more than it can hold, some 45 bytes
# for each row and as much again while they arrive. A job for every level costs more until then.
ALONE_ROWS = 4_000_000
# Rows that are packed at a time, before cuts are known.
PACKED_ROWS = 100_000
# Rows of a counting task beyond the session's parallelism.
TASK_ROWS = 4_000_000
# Rounds after which the margins are written to the checkpoint folder.
CHECKPOINT_ROUNDS = 20
# Trees from which on an ensemble is scored by numpy.
MANY_TREES = 50
# Tasks that share a forest's trees, and trees that are counted side by side.
FOREST_TASKS, FOREST_TREES = 4, 8


def columns_of(encoder: PipelineModel) -> h.Columns:
    """Numbers, and indicators of one text feature as one column."""
    names = encoded_names(encoder)
    inputs = [c for c in encoder.stages[-1].getInputCols() if c.startswith("cat__")]
    sizes = {c: len(levels) for s in encoder.stages if hasattr(s, "labelsArray") for c, levels in zip(inputs, s.labelsArray)}
    groups, first = [], 0
    for c in inputs:
        groups.append((first, sizes[c]))
        first += sizes[c]
    return h.Columns(tuple(range(first, len(names))), tuple(groups))


def plan_of(learner: Learner, columns: h.Columns, pos_weight: float, rows: int) -> h.Plan:
    e, n = learner.estimator, columns.features
    forest = learner.kind == "forest"
    share = e.getFeatureSubsetStrategy()
    if share == "auto":
        share = "sqrt" if forest else "all"
    offered = {"sqrt": int(np.ceil(np.sqrt(n))), "all": n}.get(share)
    return h.Plan(
        learner.kind,
        columns,
        e.getNumTrees() if forest else e.getMaxIter(),
        e.getMaxDepth(),
        e.getSeed(),
        1.0 if forest else e.getStepSize(),
        e.getSubsamplingRate(),
        offered or max(1, int(np.ceil(float(share) * n))),
        e.getMinInstancesPerNode(),
        float(pos_weight),
        rows,
    )


def _pack(columns: h.Columns):
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("rows", pa.int32()), *[(c, pa.binary()) for c in ("numbers", "levels", "label")]])

    def run(batches):
        part, block, held, n = TaskContext.get().partitionId(), 0, [], 0

        def packed():
            vectors, label = (np.concatenate(x) for x in zip(*held))
            raw = h.pack(columns, (part, block), vectors, label)
            row = [part, block, len(label), raw.values.tobytes(), raw.levels.tobytes(), raw.label.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            held.append((vectors, batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= PACKED_ROWS:
                yield packed()
                block, held, n = block + 1, [], 0
        if held:
            yield packed()

    return run


def _raw(row) -> h.Raw:
    def matrix(data, kind):
        return np.frombuffer(data, kind).reshape(-1, row.rows)

    return h.Raw((row.part, row.block), matrix(row.numbers, np.float64), matrix(row.levels, np.uint32), np.frombuffer(row.label, np.uint8))


def fit_learners(encoded: DataFrame, encoder: PipelineModel, learners: Sequence[Learner], pos_weight: float, rows: int) -> list[object]:
    """A Spark ML model of every learner, from encoded rows that were laid out by content."""
    spark = encoded.sparkSession
    sc = spark.sparkContext
    columns = columns_of(encoder)
    vectors = encoded.select(vector_to_array(FEATURES_COL).alias("v"), F.col(LABEL_COL).alias("y"))
    packed = vectors.mapInArrow(_pack(columns), "part int, block int, rows int, numbers binary, levels binary, label binary")
    packed = packed.persist(StorageLevel.MEMORY_AND_DISK)
    chunks = None
    try:
        raw = packed.rdd.map(_raw)
        bins = max(m.estimator.getMaxBins() for m in learners)
        cuts = {c: np.empty(0) for c in range(len(columns.numbers))}
        if cuts:
            found = raw.flatMap(h.sketch).groupByKey(len(cuts)).mapValues(lambda s: h.cuts_of(s, bins))
            cuts |= dict(found.collect())
        columns = h.Columns(columns.numbers, columns.groups, tuple(cuts[c] for c in range(len(cuts))))
        alone = rows <= ALONE_ROWS
        tasks = 1 if alone else min(raw.getNumPartitions(), max(sc.defaultParallelism, -(-rows // TASK_ROWS)))
        binned = raw.map(lambda r: h.bin_rows(columns, r))
        most = rows if alone else h.CHUNK_ROWS
        chunks = binned.coalesce(tasks).mapPartitions(lambda found: h.merge(found, most)).persist(StorageLevel.MEMORY_AND_DISK)
        chunks.count()
        packed.unpersist()
        plans = [plan_of(m, columns, pos_weight, rows) for m in learners]
        if alone:
            grown = _alone(sc, chunks, plans)
        else:
            grown = _side_by_side(spark, lambda p: _boosted(spark, chunks, p) if p.kind == "boosted" else _forest(chunks, p), plans)
    finally:
        packed.unpersist()
        if chunks is not None:
            chunks.unpersist()
    return _side_by_side(spark, lambda x: _model(spark, *x), list(zip(learners, plans, grown)))


def _side_by_side(spark: SparkSession, function, given: Sequence) -> list:
    """A learner's jobs fill the time in which those of another are planned."""
    with ThreadPool(len(given)) as pool:
        return pool.map(inheritable_thread_target(spark)(function), given, 1)


def _alone(sc, chunks, plans: Sequence[h.Plan]) -> list[list[dict]]:
    """Every learner in a task of its own, a forest in a few."""
    jobs = []
    for i, plan in enumerate(plans):
        cut = FOREST_TASKS if plan.kind == "forest" else 1
        jobs += [(i, range(t, plan.trees, cut)) for t in range(cut)]

    def run(task, held):
        i, numbers = jobs[task]
        plan = plans[i]
        for chunk in held:
            trees = h.boosted_alone(plan, chunk) if plan.kind == "boosted" else h.forest_alone(plan, chunk, numbers)
            yield from ((i, number, tree.arrays()) for number, tree in zip(numbers, trees))

    found = {(i, n): tree for i, n, tree in sc.union([chunks] * len(jobs)).mapPartitionsWithIndex(run).collect()}
    return [[found[i, n] for n in range(p.trees)] for i, p in enumerate(plans)]


def _splits(counted, keys: int, best) -> dict:
    """Counts with equal keys are added in a task, and turned to splits there."""

    def run(held):
        sums: dict = {}
        for key, counts in held:
            if key in sums:
                sums[key] += counts
            else:
                sums[key] = counts.astype(np.float64)
        for key in list(sums):
            yield key, best(key, sums.pop(key))

    tasks = max(1, min(keys, counted.getNumPartitions()))
    return dict(counted.partitionBy(tasks, lambda key: key).mapPartitions(run).collect())


def _boosted(spark: SparkSession, chunks, plan: h.Plan) -> list[dict]:
    """Trees one after another; margins are kept with the codes, and written out every few rounds."""
    found, written, state, places = [], None, chunks, h.feature_places(plan.columns)
    before = None
    for number in range(plan.trees):
        tree = h.Tree()
        while tree.open:
            nodes, held = list(tree.open), tree.arrays() if tree.nodes else None

            def count(rows, tree=tree, held=held, number=number):
                sums = None
                for chunk in rows:
                    codes, label = chunk.codes, chunk.label
                    gradient, chosen = h.gradients(plan, label, chunk.margin, number), h.sampled(plan, chunk, number)
                    if chosen is not None:
                        chosen = np.flatnonzero(chosen)
                        codes, label, gradient = codes[:, chosen], label[chosen], gradient[chosen]
                    at = np.zeros(len(label), np.int64)
                    if held is not None:
                        at = h.descend(held, codes, at, plan.depth, plan.columns.width)
                    counts = h.boosted_counts(plan, codes, label, gradient, h.slots(tree, at), len(tree.open))
                    sums = counts if sums is None else sums + counts
                yield from enumerate(sums if sums is not None else [])

            def best(key, counts, nodes=nodes, number=number):
                return h.boosted_splits(plan, number, [nodes[key]], counts[None], places)[0]

            splits = _splits(state.mapPartitions(count), len(nodes), best)
            tree.grow(plan, [splits.get(i) for i in range(len(nodes))])
            if before is not None:  # that job stored the margins
                if before is not chunks:
                    before.unpersist()
                before = None
                if state.isCheckpointed():
                    drop(spark, [written] if written else [])
                    written = state.getCheckpointFile()
                    # Files of shuffles that nothing refers to any more go with this.
                    spark.sparkContext._jvm.System.gc()
        found.append(tree.arrays())
        if number + 1 == plan.trees:
            break
        before = state
        state = before.map(lambda c, tree=tree, number=number: h.Chunk(c.codes, c.label, c.parts, c.margin + h.margins(plan, c.codes, tree, number)))
        state = state.persist(StorageLevel.MEMORY_AND_DISK)
        if (number + 1) % CHECKPOINT_ROUNDS == 0:
            state.checkpoint()
    if state is not chunks:
        state.unpersist()
    drop(spark, [written] if written else [])
    return found


def _forest(chunks, plan: h.Plan) -> list[dict]:
    """Level by level, a few trees side by side; counts of a few nodes travel at a time."""
    found = []
    for first in range(0, plan.trees, FOREST_TREES):
        numbers = range(first, min(first + FOREST_TREES, plan.trees))
        trees = {n: h.Tree() for n in numbers}
        while any(t.open for t in trees.values()):
            grown = {n: t for n, t in trees.items() if t.open}
            parts = [(n, i) for n, t in grown.items() for i in range(0, len(t.open), h.NODES)]
            offers = {n: h.forest_offers(plan, n, t.open) for n, t in grown.items()}
            arrays = {n: t.arrays() if t.nodes else None for n, t in grown.items()}
            sent = chunks.context.broadcast(h.cloudpickle.dumps((grown, offers, arrays, parts)))

            def count(rows, sent=sent):
                grown, offers, arrays, parts = h.cloudpickle.loads(sent.value)
                sums = {}
                for chunk in rows:
                    for n, tree in grown.items():
                        times = h.bootstrap(plan, chunk, n)
                        drawn = np.flatnonzero(times)
                        codes, label = chunk.codes[:, drawn], chunk.label[drawn]
                        at = np.zeros(len(drawn), np.int64)
                        if arrays[n] is not None:
                            at = h.descend(arrays[n], codes, at, plan.depth, plan.columns.width)
                        counts = h.forest_counts(plan, codes, label, times[drawn].astype(np.float64), h.slots(tree, at), offers[n])
                        # Times drawn, so whole numbers; narrow ones while they wait and travel.
                        sums[n] = counts.astype(np.uint32) if n not in sums else sums[n] + counts.astype(np.uint32)
                for key, (n, i) in enumerate(parts):
                    if n in sums:
                        yield key, sums[n][i : i + h.NODES]

            def best(key, counts, sent=sent):
                _, offers, _, parts = h.cloudpickle.loads(sent.value)
                n, i = parts[key]
                return h.forest_splits(plan, offers[n][i : i + h.NODES], counts)

            splits = _splits(chunks.mapPartitions(count), len(parts), best)
            for n, tree in grown.items():
                keys = [k for k, (m, _) in enumerate(parts) if m == n]
                tree.grow(plan, [s for k in keys for s in splits[k]])
            sent.destroy()
        found += [trees[n].arrays() for n in numbers]
        chunks.context._jvm.System.gc()
    return found


_SPLIT = pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())])


def _nodes(plan: h.Plan, number: int, tree: dict[str, np.ndarray]) -> pa.Table:
    """A tree's nodes as Spark ML stores them."""
    n = len(tree["feature"])
    inner = tree["feature"] >= 0
    weight = tree["neg"] + plan.pos_weight * tree["pos"]
    value = _values(plan, tree)
    if plan.kind == "forest":
        stats = np.stack([tree["neg"], plan.pos_weight * tree["pos"]], 1)
        safe = np.where(weight > 0, weight, 1.0)
        impurity = np.where(weight > 0, 1 - (stats**2).sum(1) / safe**2, 0.0)
    else:
        # The gradients' squares are not counted, so the impurity that remains is not known.
        stats = np.stack([weight, tree["total"], tree["total"] * value], 1)
        impurity = np.zeros(n)
    lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(inner)]).astype(np.int32), pa.array(tree["threshold"][inner]))
    whole = np.full(n, -1, np.int32)
    split = pa.StructArray.from_arrays(
        [pa.array(np.where(inner, tree["feature"], -1).astype(np.int32)), lists, pa.array(whole)], fields=list(_SPLIT)
    )
    fixed = pa.ListArray.from_arrays(np.arange(0, stats.size + 1, stats.shape[1], dtype=np.int32), pa.array(stats.ravel()))
    node = pa.StructArray.from_arrays(
        [
            pa.array(np.arange(n, dtype=np.int32)),
            pa.array(value),
            pa.array(impurity),
            fixed,
            pa.array((tree["neg"] + tree["pos"]).astype(np.int64)),
            pa.array(np.where(inner, tree["gain"], -1.0)),
            pa.array(np.where(inner, tree["left"], -1).astype(np.int32)),
            pa.array(np.where(inner, tree["right"], -1).astype(np.int32)),
            split,
        ],
        ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"],
    )
    return pa.table({"treeID": pa.array(np.full(n, number, np.int32)), "nodeData": node})


def _values(plan: h.Plan, tree: dict[str, np.ndarray]) -> np.ndarray:
    """A boosted leaf's part of the margin, a forest leaf's class."""
    if plan.kind == "forest":
        return (plan.pos_weight * tree["pos"] > tree["neg"]).astype(np.float64)
    return h.leaf_values(plan, tree)


def _model(spark: SparkSession, learner: Learner, plan: h.Plan, trees: Sequence[dict]) -> object:
    """The Spark ML model of these trees: written in its own file format, read, and deleted."""
    path, e = scratch_path(spark, f"trained-{learner.name}"), learner.estimator

    def described(name: str, uid: str, params: dict, defaults: dict, **more) -> str:
        about = {"class": name, "timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": uid}
        return json.dumps(about | {"paramMap": params, "defaultParamMap": defaults} | more)

    chosen, defaults = ({p.name: v for p, v in m.items()} for m in (e._paramMap, e._defaultParamMap))
    forest = learner.kind == "forest"
    kind = "classification.RandomForestClassificationModel" if forest else "classification.GBTClassificationModel"
    about = described(
        f"org.apache.spark.ml.{kind}", e.uid, chosen, defaults,
        numFeatures=plan.columns.features, numTrees=len(trees), **({"numClasses": 2} if forest else {}),
    )
    member = "classification.DecisionTreeClassificationModel" if forest else "regression.DecisionTreeRegressionModel"
    few = {"maxDepth": plan.depth, "seed": plan.seed}
    members = [
        (n, described(f"org.apache.spark.ml.{member}", f"{e.uid}_tree_{n}", few, {}), plan.weight(n)) for n in range(len(trees))
    ]
    nodes = pa.concat_tables([_nodes(plan, n, t) for n, t in enumerate(trees)])
    try:
        spark.createDataFrame([(about,)], "value string").coalesce(1).write.text(f"{path}/metadata")
        spark.createDataFrame(members, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
        spark.createDataFrame(nodes).write.parquet(f"{path}/data")
        return read_model(spark, learner.kind, path)
    finally:
        drop(spark, [path])


class _Members(Sequence):
    """A model's trees as Python objects, made when asked for."""

    def __init__(self, model, member: type):
        self.model, self.member = model, member

    def __len__(self) -> int:
        return self.model.getNumTrees()

    def __getitem__(self, i):
        if isinstance(i, slice):
            return [self[j] for j in range(*i.indices(len(self)))]
        return self.member(self.model.trees()[range(len(self))[i]])


def read_model(spark: SparkSession, kind: str, path: str) -> tuple[object, h.Flat | None]:
    """A saved model as its class loads it, but for Python objects of every tree: 500 take seconds.

    The nodes of a large one come beside it.
    """
    java = MODEL_CLASSES[kind].read()._jread.load(path)
    model = MODEL_CLASSES[kind]()
    model.__dict__["trees"] = _Members(java, DecisionTreeClassificationModel if kind == "forest" else DecisionTreeRegressionModel)
    model._java_obj = java
    model._create_params_from_java()
    model._resetUid(java.uid())
    model._transfer_params_from_java()
    return model, _flat(spark, kind, path, model.getMaxDepth()) if java.getNumTrees() >= MANY_TREES else None


def _flat(spark: SparkSession, kind: str, path: str, depth: int) -> h.Flat:
    weights = dict(spark.read.parquet(f"{path}/treesMetadata").select("_1", "_3").collect())
    node = F.col("nodeData")
    value = node["prediction"]
    if kind == "forest":
        value = F.try_divide(node["impurityStats"][1], node["impurityStats"][0] + node["impurityStats"][1])
    cut = F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0))
    table = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        node["id"].alias("id"),
        node["split"]["featureIndex"].alias("feature"),
        F.coalesce(cut, F.lit(0.0)).alias("threshold"),
        node["leftChild"].alias("left"),
        node["rightChild"].alias("right"),
        F.coalesce(value, F.lit(0.0)).alias("value"),
    )
    c = {name: column.to_numpy() for name, column in zip(table.columns, table.toArrow().columns)}
    order = np.lexsort((c["id"], c["tree"]))
    c = {name: x[order] for name, x in c.items()}
    roots = np.flatnonzero(c["id"] == 0)
    first = roots[np.cumsum(c["id"] == 0) - 1]
    inner, own = c["feature"] >= 0, np.arange(len(order))
    sides = [np.where(inner, c[s] + first, own) for s in ("right", "left")]
    weight = np.array([1.0 if kind == "forest" else weights[t] for t in c["tree"][roots]])
    value = c["value"] * weight[np.cumsum(c["id"] == 0) - 1]
    feature = np.where(inner, c["feature"], 0).astype(np.int64)
    return h.Flat(kind, depth, roots, feature, c["threshold"], np.stack(sides, 1).ravel().astype(np.int64), value)


def scorer(spark: SparkSession, ensembles: Sequence[h.Flat]):
    """A column function from encoded features, an array, to every ensemble's probability of class 1."""
    sent = spark.sparkContext.broadcast(h.cloudpickle.dumps(list(ensembles)))

    def score(features: pa.Array) -> pa.Array:
        n = len(features)
        x = features.flatten().to_numpy().reshape(n, -1).T if n else np.empty((1, 0))
        found = np.stack([e.probability(x) for e in h.cloudpickle.loads(sent.value)], 1)
        return pa.ListArray.from_arrays(np.arange(0, found.size + 1, found.shape[1], dtype=np.int32), pa.array(found.ravel()))

    return F.arrow_udf(score, "array<double>")
