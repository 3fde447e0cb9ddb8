"""Removal of long byte strings that occur more than once, by column-wise suffix sorting.

Every window of ``length`` bytes has an anchor: the string of ``ANCHOR`` bytes in it with
the smallest hash, the leftmost on ties. Equal windows have equal anchors at equal places,
so documents are cut into segments (consecutive windows with one anchor) and segments meet
under their anchor only. Segments that are equal as a whole repeat as a whole. Those that
share an anchor and differ are compared by the multi-document construction: laid out
around the anchor, one symbol per segment is inserted each round, from the last column to
the first; the round's symbols, stably sorted on top of the order so far, give the next
order (the collection's Burrows-Wheeler transform, column by column), and the common
prefixes of neighbours follow from minima over the ranges between equal symbols. A window
repeats if a neighbour's common prefix reaches over it. The columns of a partition's
segments are read once, in sequence. They are kept in memory rather than in files of the
executor's own, and an anchor with more than ``TOGETHER`` different segments, whose columns
would grow without bound, has its windows counted by hash over all executors instead.

Equal segments are recognised by 64-bit hashes, everything else by its bytes.

Defined results: a null or empty text has no bytes and keeps none; texts shorter than a
window stay whole; repeated rows repeat each other and so lose every window; extra columns
are ignored; an empty table gives an empty one. Very long texts are cut into overlapping
slices that hold each window once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoscore.llm.common import raw, rows_of, texts
from geoscore.sources.storage import store

LENGTH = 200
ANCHOR = 64
#: Different segments of an anchor that are sorted together.
TOGETHER = 20_000
#: Segments in one run of column-wise sorting.
SORTED = 20_000
BATCH_BYTES = 2 << 20
SLICE = 4 << 20
#: Low bits of an anchor's rank that hold its place in the batch.
PLACE = 28
PAD = 256

_U = np.uint64
_BYTE = np.random.default_rng(3).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Hasher:
    """Hashes of any stretch of a buffer, from one pass over it."""

    def __init__(self) -> None:
        self.powers = self.inverses = np.ones(1, np.uint64)

    def load(self, data: np.ndarray) -> None:
        n = len(data) + 1
        if len(self.powers) < n:
            self.powers, self.inverses = (
                np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]))
                for b in (_BASE, _INVERSE)
            )
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(_BYTE[data] * self.powers[: n - 1], out=self.sums[1:])

    def all(self, size: int) -> np.ndarray:
        """The hash of every stretch of ``size`` bytes."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.inverses[:n])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverses[start])


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def pieces(documents: list[bytes], length: int) -> list[tuple[int, int, bytes]]:
    """(document, first byte, bytes): texts with a window, long ones in overlapping slices."""
    out = []
    for i, text in enumerate(documents):
        for first in range(0, max(0, len(text) - length + 1), SLICE):
            out.append((i, first, text[first : first + SLICE + length - 1]))
    return out


def segments(
    parts: list[tuple[int, int, bytes]], length: int, hasher: Hasher
) -> dict[str, np.ndarray]:
    """Segments of pieces; equal neighbours (periodic text) come as one with ``reps``."""
    data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
    sizes = np.array([len(p[2]) for p in parts])
    begins = np.cumsum(sizes) - sizes
    hasher.load(data)
    hashes = hasher.all(ANCHOR)
    ranks = (hashes >> _U(PLACE)) << _U(PLACE) | np.arange(len(hashes), dtype=np.uint64)
    least = sliding_minimum(ranks, length - ANCHOR + 1)
    counts = sizes - length + 1
    owner = np.repeat(np.arange(len(parts)), counts)
    starts = np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    place = (least[starts] & _U((1 << PLACE) - 1)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])])
    windows = np.diff(np.r_[new, len(starts)])
    first, at, own = starts[new], place[new], owner[new]
    anchor = hashes[at]
    offset = at - first
    shape = (offset * 1024 + windows).astype(np.uint64)
    segment = mix(hasher.of(first, first + windows + length - 1) ^ (shape * _U(0x9E3779B97F4A7C15)))
    same = (segment[1:] == segment[:-1]) & (anchor[1:] == anchor[:-1]) & (own[1:] == own[:-1])
    head = np.flatnonzero(np.r_[True, ~same])
    reps = np.diff(np.r_[head, len(segment)])
    doc = np.array([p[0] for p in parts])[own[head]]
    in_doc = first[head] - begins[own[head]] + np.array([p[1] for p in parts])[own[head]]
    return {
        "doc": doc,
        "anchor": anchor[head].view(np.int64),
        "segment": segment[head].view(np.int64),
        "offset": offset[head].astype(np.int32),
        "windows": windows[head].astype(np.int32),
        "start": in_doc.astype(np.int64),
        "reps": reps.astype(np.int32),
    }


SEGMENT = "key bigint, anchor bigint, segment bigint, offset int, windows int, start bigint, reps int"


def anchored(rows: DataFrame, length: int) -> DataFrame:
    """Every document's segments; ``rows`` has ``key`` and ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for part in rows_of(batches, BATCH_BYTES):
            keys = part.column(0).to_numpy()
            parts = pieces(raw(part.column(1)), length)
            while parts:
                size, n = 0, 0
                while n < len(parts) and (not n or size + len(parts[n][2]) <= SLICE):
                    size += len(parts[n][2])
                    n += 1
                found = segments(parts[:n], length, hasher)
                parts = parts[n:]
                own = keys[found.pop("doc")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own), *map(pa.array, found.values())], names=["key", *found]
                )

    return rows.mapInArrow(run, SEGMENT)


def repeated_windows(
    columns: np.ndarray, group: np.ndarray, valid: np.ndarray, length: int
) -> np.ndarray:
    """Which windows of segments repeat within their group.

    ``columns[c]`` has the symbols of column ``c``, ``PAD`` where a segment has none;
    ``valid[c]`` tells which segments have a window that starts there.
    """
    out = np.zeros(valid.shape, bool)
    order = np.argsort(group, kind="stable")
    common = np.zeros(len(order) + 1, np.int32)
    for c in range(len(columns) - 1, -1, -1):
        symbols = columns[c][order]
        moves = np.argsort(group[order] * 512 + symbols, kind="stable")
        order, symbols = order[moves], symbols[moves]
        # Neighbours with one symbol share it and what the range between them shared.
        low, high = moves[:-1] + 1, moves[1:] + 1
        tied = np.flatnonzero((symbols[1:] == symbols[:-1]) & (group[order[1:]] == group[order[:-1]]) & (symbols[1:] != PAD))
        fresh = np.zeros_like(common)
        near = low[tied] + 1 == high[tied]
        fresh[tied[near] + 1] = common[low[tied[near]]] + 1
        far = tied[~near]
        if len(far):
            cuts = np.stack([low[far], high[far]], axis=1).ravel()
            fresh[far + 1] = np.minimum.reduceat(common, cuts)[::2] + 1
        common = fresh
        if c < len(valid):
            longest = np.maximum(common[:-1], common[1:])
            out[c, order] = (longest >= length) & valid[c, order]
    return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.r_[0, flags.view(np.int8), 0]))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _sorter(length: int):
    """Rows sorted by anchor, each with its bytes, to the ranges of single segments that repeat."""

    def solve(rows: list[dict]) -> Iterator[tuple[int, int, int]]:
        left = max(r["offset"] for r in rows)
        right = max(len(r["bytes"]) - r["offset"] for r in rows)
        columns = np.full((left + right, len(rows)), PAD, np.int16)
        valid = np.zeros((left + 1, len(rows)), bool)
        for i, r in enumerate(rows):
            at = left - r["offset"]
            columns[at : at + len(r["bytes"]), i] = np.frombuffer(r["bytes"], np.uint8)
            valid[at : at + r["windows"], i] = True
        group = np.unique([r["anchor"] for r in rows], return_inverse=True)[1]
        found = repeated_windows(columns, group, valid, length)
        for i, r in enumerate(rows):
            if r["single"]:
                at = left - r["offset"]
                for a, b in _runs(found[at : at + r["windows"], i].copy()):
                    yield r["key"], r["start"] + a, r["start"] + b - 1 + length

    def emit(rows: list[dict]) -> pa.RecordBatch:
        found = list(solve(rows))
        arrays = [pa.array([f[k] for f in found], pa.int64()) for k in range(3)]
        return pa.RecordBatch.from_arrays(arrays, names=["key", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for part in rows_of(batches, BATCH_BYTES):
            for row in part.to_pylist():
                if len(held) >= SORTED and row["anchor"] != held[-1]["anchor"]:
                    yield emit(held)
                    held = []
                held.append(row)
        if held:
            yield emit(held)

    return run


def _by_window(rows: DataFrame, length: int) -> DataFrame:
    """Ranges of single segments whose windows repeat, by hashes of all windows of their anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for part in rows_of(batches, BATCH_BYTES):
            out: list[list[np.ndarray]] = [[], [], [], []]
            for r in part.to_pylist():
                hasher.load(np.frombuffer(r["bytes"], np.uint8))
                hashes = hasher.all(length)
                n = len(hashes)
                place = np.arange(n) - r["offset"]
                key = mix(hashes ^ mix(_U(r["anchor"] % (1 << 64)) + place.astype(np.uint64)))
                for column, values in zip(
                    out,
                    (np.full(n, r["key"]), np.arange(n) + r["start"], key.view(np.int64), np.full(n, r["single"])),
                ):
                    column.append(values)
            arrays = [pa.array(np.concatenate(c)) for c in out] if out[0] else None
            if arrays:
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "first", "window", "single"])

    windows = rows.mapInArrow(run, "key bigint, first bigint, window bigint, single boolean")
    windows = store(windows, "windows")
    often = windows.groupBy("window").count().filter(F.col("count") > 1).select("window")
    hits = windows.filter("single").join(often, "window")
    return hits.select("key", "first", (F.col("first") + length).alias("last"))


def ranges(rows: DataFrame, length: int) -> DataFrame:
    """(``key``, ``first``, ``last``): byte ranges of documents to remove, in no order."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    # One shuffle by anchor serves both counts.
    by_segment, by_anchor = Window.partitionBy("anchor", "segment"), Window.partitionBy("anchor")
    counted = (
        anchored(rows, length)
        .repartition(parts, "anchor")
        .withColumn("n", F.sum("reps").over(by_segment))
        .withColumn("number", F.row_number().over(by_segment.orderBy("key", "start")))
        .withColumn("kinds", F.sum((F.col("number") == 1).cast("int")).over(by_anchor))
        .withColumn("fewest", F.min("n").over(by_anchor))
        .filter((F.col("n") > 1) | (F.col("kinds") > 1))
        .drop("segment")
    )
    counted = store(counted, "segments")
    whole = counted.filter("n > 1").select(
        "key",
        F.col("start").alias("first"),
        (F.col("start") + F.col("windows") * F.col("reps") - 1 + length).alias("last"),
    )
    # Of equal segments one stands for all; its own windows are settled already.
    unsure = counted.filter("kinds > 1 and fewest = 1 and number = 1")
    wanted = unsure.withColumn("single", F.col("n") == 1).groupBy("key").agg(
        F.collect_list(F.struct("anchor", "offset", "windows", "start", "single", "kinds")).alias("wanted")
    )
    schema = "key bigint, anchor bigint, offset int, windows int, start bigint, single boolean, kinds bigint, bytes binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "offset", "windows", "start", "single", "kinds"]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64()]
        for part in rows_of(batches, BATCH_BYTES):
            keys, found, taken = [], [], []
            for key, text, each in zip(part.column(0).to_pylist(), raw(part.column(1)), part.column(2).to_pylist()):
                for w in each:
                    keys.append(key)
                    found.append(w)
                    taken.append(text[w["start"] : w["start"] + w["windows"] - 1 + length])
            columns = [pa.array([w[n] for w in found], t) for n, t in zip(names, types)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), *columns, pa.array(taken, pa.binary())], names=["key", *names, "bytes"]
            )

    # Repeated rows would bring a segment twice, but none of their segments is single.
    cutouts = store(rows.join(wanted, "key").select("key", "text", "wanted").mapInArrow(cut, schema), "cutouts")
    few = cutouts.filter(F.col("kinds") <= TOGETHER).drop("kinds")
    sorted_ = few.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(
        _sorter(length), "key bigint, first bigint, last bigint"
    )
    found = whole.unionByName(sorted_)
    many = cutouts.filter(F.col("kinds") > TOGETHER).drop("kinds")
    if not many.isEmpty():
        found = found.unionByName(_by_window(many, length))
    return found


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document ``n_bytes``, the ``removed`` byte ranges (first, end) and the ``kept`` bytes."""
    rows = texts(docs, id_col, text_col)
    rows = rows.withColumn("key", F.xxhash64(id_col, "text"))
    found = ranges(rows.select("key", "text"), length)
    per_key = found.groupBy("key").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
    joined = rows.join(per_key, "key", "left").select(id_col, "text", "ranges")
    id_type = rows.schema[id_col].dataType.simpleString()
    span = pa.struct([("first", pa.int64()), ("last", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches, BATCH_BYTES):
            sizes, removed, kept = [], [], []
            for text, each in zip(raw(part.column(1)), part.column(2).to_pylist()):
                merged: list[list[int]] = []
                for r in sorted((r["first"], r["last"]) for r in each or ()):
                    if merged and r[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], r[1])
                    else:
                        merged.append([*r])
                sizes.append(len(text))
                removed.append([{"first": a, "last": b} for a, b in merged])
                bounds = [0, *(x for m in merged for x in m), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(bounds[::2], bounds[1::2])) if merged else text)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(span)), pa.array(kept, pa.binary())],
                names=[part.schema.names[0], "n_bytes", "removed", "kept"],
            )

    schema = f"`{id_col}` {id_type}, n_bytes bigint, removed array<struct<first:bigint,last:bigint>>, kept binary"
    return joined.mapInArrow(run, schema)


def digests(removed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return removed.select(
        id_col,
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
