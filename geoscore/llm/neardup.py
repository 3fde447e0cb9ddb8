"""Near duplicates by HyperMinHash: compressed MinHash registers, banded.

A document's words give a set of shingles. Its sketch has ``REGISTERS`` buckets; each
keeps the smallest hash falling into it, stored as a count of leading zeros with
``MANTISSA`` bits after it, and an empty bucket borrows another's register by a fixed
order of its own. Documents with equal sets form one class from the start. Classes that
agree in all registers of a band share a bucket. Pairs whose estimated Jaccard similarity,
corrected for registers that agree by chance, could still reach the threshold are compared
on their full sets of shingles.

A bucket isn't turned into all its pairs. First its members meet one pivot, and components
are formed: a large group of copies takes this one round. Members of buckets that still
hold several components then meet in blocks of ``BLOCK``: counts of a set's shingles in
classes by hash bound how many two sets can share, and only pairs of different components
whose bound reaches the threshold are compared. So no link that a bucket can show is lost,
and near misses of a large group are ruled out a block at a time, without a row for each.

At the threshold 0.8 a band of ``ROWS`` registers agrees with probability 0.51, so all of
``BANDS`` bands differ once in three million pairs.

Defined results: a null or empty text has no shingles and stays alone; a text shorter than
a shingle is one shingle; rows that repeat an id are in one component, each text of it with
links of its own; a null id stays alone with
a null component; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoscore.llm.common import raw, rows_of, texts, words
from geoscore.llm.components import components
from geoscore.sources.storage import store

REGISTERS = 64
MANTISSA = 10
BANDS, ROWS = 21, 3
PERCENT = 80
#: Standard errors of the estimate that a pair may fall short and is still compared.
SLACK = 5.0
#: Members of a bucket, on average, that meet at a time.
BLOCK = 512
#: Fewest and most classes of shingles; a set has at least twice as many as shingles, up to the most.
CLASSES = (256, 8192)
BATCH_BYTES = 4 << 20
REMEMBERED = 400_000

_U = np.uint64
_MULTIPLIERS = np.random.default_rng(11).integers(1 << 62, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_hashes(tokens: np.ndarray, size: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a sequence of word hashes."""
    n = min(len(tokens), size)
    if not n:
        return tokens
    total = np.full(len(tokens) - n + 1, n, np.uint64)
    for k in range(n):
        total += tokens[k : len(tokens) - n + 1 + k] * _MULTIPLIERS[k]
    return np.unique(mix(total))


def _borrowing() -> np.ndarray:
    """For each register, the order in which it looks for one to borrow from."""
    rng = np.random.default_rng(5)
    return np.array([[r, *rng.permutation([x for x in range(REGISTERS) if x != r])] for r in range(REGISTERS)])


BORROW = _borrowing()


def registers(smallest: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Registers of documents (rows) from the smallest hash of each bucket, empty ones borrowed."""
    rest = smallest << _U(REGISTERS.bit_length() - 1)
    zeros = np.uint64(64) - np.frexp(rest.astype(np.float64))[1].astype(np.uint64)
    zeros = np.minimum(zeros, _U(63))
    after = (rest << (zeros + _U(1)).clip(0, 63)) >> _U(64 - MANTISSA)
    own = (zeros << _U(MANTISSA) | after).astype(np.uint16)
    out, missing = own.copy(), ~filled
    for step in range(1, REGISTERS):
        if not missing.any():
            break
        source = BORROW[:, step]
        take = missing & filled[:, source]
        out = np.where(take, own[:, source], out)
        missing &= ~take
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    keys = np.empty((len(values), BANDS), np.uint64)
    for band in range(BANDS):
        total = np.full(len(values), band + 1, np.uint64) << _U(50)
        for row in range(ROWS):
            total |= values[:, band + BANDS * row].astype(np.uint64) << _U(16 * row)
        keys[:, band] = mix(total)
    return keys.view(np.int64)


def estimate(left: np.ndarray, right: np.ndarray) -> float:
    """Jaccard similarity from the share of equal registers less those equal by chance."""
    # Of two unrelated minima, leading zeros agree one time in three and the mantissa one in 2**MANTISSA.
    chance = 1 / 3 / 2**MANTISSA
    return float(((left == right).mean() - chance) / (1 - chance))


def sketch(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: a hash of the text, set size, a hash of the whole set, the registers and the band keys."""
    rows = texts(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    id_type = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        bounds = np.arange(REGISTERS, dtype=np.uint64) << _U(64 - REGISTERS.bit_length() + 1)
        for part in rows_of(batches, BATCH_BYTES):
            if len(known) > REMEMBERED:
                known.clear()
            n = part.num_rows
            sizes, wholes = np.zeros(n, np.int64), np.zeros(n, np.uint64)
            smallest, filled = np.zeros((n, REGISTERS), np.uint64), np.zeros((n, REGISTERS), bool)
            for i, text in enumerate(raw(part.column(1))):
                tokens = np.array(list(map(known.__getitem__, words(text))), np.uint64)
                grams = shingle_hashes(tokens, shingle)
                if not len(grams):
                    continue
                at = np.searchsorted(grams, bounds)
                filled[i] = at < np.append(at[1:], len(grams))
                smallest[i] = grams[np.minimum(at, len(grams) - 1)]
                sizes[i], wholes[i] = len(grams), mix(grams * _U(3)).sum(dtype=np.uint64)
            values = registers(smallest, filled)
            keys = band_keys(values)
            lists = pa.ListArray.from_arrays(np.arange(0, (n + 1) * BANDS, BANDS, dtype=np.int32), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(2),
                    pa.array(sizes),
                    pa.array(wholes.view(np.int64)),
                    pa.array([v.tobytes() for v in values], pa.binary()),
                    lists,
                ],
                names=[part.schema.names[0], "h", "n", "whole", "registers", "bands"],
            )

    return rows.mapInArrow(
        run, f"`{id_col}` {id_type}, h bigint, n bigint, whole bigint, registers binary, bands array<bigint>"
    )


def _verifier(shingle: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Compares pairs on their full sets; rows come sorted by pivot, whose set is kept."""
    least = percent / 100 - SLACK * (percent / 100 * (1 - percent / 100) / REGISTERS) ** 0.5

    def grams(text: bytes) -> set:
        w = words(text)
        return set(zip(*(w[k:] for k in range(shingle)))) if len(w) >= shingle else {tuple(w)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, kept = None, set()
        for part in rows_of(batches, BATCH_BYTES):
            linked = []
            columns = [part.column(k).to_pylist() for k in (2, 3)]
            for a, ra, rb, ta, tb in zip(
                part.column(0).to_pylist(), *columns, raw(part.column(4)), raw(part.column(5))
            ):
                left, right = np.frombuffer(ra, np.uint16), np.frombuffer(rb, np.uint16)
                if estimate(left, right) < least:
                    linked.append(False)
                    continue
                if pivot != a:
                    pivot, kept = a, grams(ta)
                other = grams(tb)
                both = len(kept & other)
                linked.append(100 * both >= percent * (len(kept) + len(other) - both))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"]
            )

    return run


def class_counts(grams: np.ndarray) -> bytes:
    """How many shingles fall into each class, a byte each, and what goes beyond 255 in all.

    Of two sets, the smaller counts of every class and the smaller excess add up to at
    least what they share.
    """
    low, high = CLASSES
    classes = min(max(1 << (2 * len(grams)).bit_length(), low), high)
    counts = np.bincount((grams >> _U(7)).astype(np.int64) & (classes - 1), minlength=classes)
    over = np.maximum(counts - 255, 0).sum()
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + np.int64(over).tobytes()


def _counted(shingle: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for part in rows_of(batches, BATCH_BYTES):
            if len(known) > REMEMBERED:
                known.clear()
            found = []
            for text in raw(part.column(1)):
                tokens = np.array(list(map(known.__getitem__, words(text))), np.uint64)
                found.append(class_counts(shingle_hashes(tokens, shingle)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], names=["node", "counts"])

    return run


def may_link(counts: list[bytes], n: np.ndarray, label: np.ndarray, left: np.ndarray, percent: int) -> tuple[list, list]:
    """Positions of pairs of different labels, and of different sides if there are two, that may link."""
    matrices = {}
    for size in {len(c) for c in counts}:
        rows = np.array([i for i, c in enumerate(counts) if len(c) == size])
        both = np.frombuffer(b"".join(counts[i] for i in rows), np.uint8).reshape(len(rows), size)
        matrices[size - 8] = rows, both[:, :-8].astype(np.uint16), both[:, -8:].copy().view(np.int64).ravel()
    one_side = left.all() or not left.any()
    found_a, found_b = [], []
    for k, (rows_a, base_a, over_a) in matrices.items():
        for other in (k, 2 * k, 4 * k):  # sizes of linked sets differ by less than classes do
            if other not in matrices:
                continue
            rows_b, base_b, over_b = matrices[other]
            base_b = base_b.reshape(len(rows_b), -1, k).sum(1, dtype=np.uint16)  # classes fold
            for i, row in enumerate(rows_a):
                ask = (label[rows_b] != label[row]) & (100 * np.minimum(n[row], n[rows_b]) >= percent * np.maximum(n[row], n[rows_b]))
                ask &= (rows_b > row) if one_side and other == k else one_side | (left[rows_b] != left[row])
                at = np.flatnonzero(ask)
                if not len(at):
                    continue
                most = np.minimum(base_a[i], base_b[at]).sum(1, dtype=np.int64) + np.minimum(over_a[i], over_b[at])
                near = at[100 * most >= percent * (n[row] + n[rows_b[at]] - most)]
                found_a += [row] * len(near)
                found_b += rows_b[near].tolist()
    return found_a, found_b


def _meet(members: DataFrame, bodies: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(``a``, ``b``): pairs of a bucket's members of different labels that may link."""
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    wanted = members.select("node").distinct().join(bodies.select("node", "text"), "node")
    counted = store(wanted.mapInArrow(_counted(shingle), f"node {_type(members, 'node')}, counts binary"), "class-counts")
    blocks = F.ceil(F.col("size") / BLOCK)
    dealt = members.join(sizes, "bucket").select(
        "bucket", "node", "n", "label", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).alias("own")
    )
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select(
        "bucket", "node", "n", "label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own"
    )

    def meet(group: pa.Table) -> pa.Table:
        node, n, label = (group[c].to_numpy() for c in ("node", "n", "label"))
        left = group["own"].to_numpy() == group["i"].to_numpy()
        if group["i"][0] == group["j"][0]:
            left[:] = True
        elif left.all() or not left.any():  # a block without members on the other side
            return pa.table([pa.array([], group["node"].type)] * 2, names=["a", "b"])
        a, b = (node[np.array(x, int)] for x in may_link(group["counts"].to_pylist(), n, label, left, percent))
        return pa.table([np.minimum(a, b), np.maximum(a, b)], names=["a", "b"])

    kind = _type(members, "node")
    together = dealt.join(counted, "node")
    return together.groupBy("bucket", "i", "j").applyInArrow(meet, f"a {kind}, b {kind}").distinct()


def groups(
    docs: DataFrame,
    shingle: int = 5,
    percent: int = PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per document ``id_col``, ``n_shingles``, ``component_id`` (the smallest id it reaches) and ``kept``."""
    rows = store(sketch(docs, shingle, id_col, text_col), "sketches")
    full = rows.filter((F.col("n") > 0) & F.col(id_col).isNotNull())
    # A class of equal sets goes by the hash of its set; one row of it stands for all.
    classes = full.groupBy(F.col("whole").alias("node")).agg(
        F.min_by(F.struct("n", F.col(id_col).alias("id"), "h", "registers", "bands"), F.struct(id_col, "h")).alias("row")
    )
    classes = store(classes.select("node", "row.*"), "classes")
    members = classes.select("node", "id", "n", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").count().filter(F.col("count") > 1).select("bucket")
    members = store(members.join(shared, "bucket"), "members")
    # Texts of the classes that share a bucket, read once.
    wanted = members.select("node").distinct().join(classes.select("node", "id", "h", "registers"), "node")
    source = texts(docs, id_col, text_col).withColumnRenamed(id_col, "id").withColumn("h", F.xxhash64("text"))
    bodies = wanted.join(source, ["id", "h"]).groupBy("node", "registers").agg(F.min("text").alias("text"))
    bodies = store(bodies.select("node", "registers", "text"), "bodies")

    # An id on several rows ties their classes together.
    nodes = full.select(F.col(id_col).alias("doc"), F.col("whole").alias("node"))
    same_id = nodes.groupBy("doc").agg(F.min("node").alias("a"), F.max("node").alias("b"))
    same_id = nodes.join(same_id.filter("a < b"), "doc").select("a", F.col("node").alias("b")).distinct()

    def checked(pairs: DataFrame) -> DataFrame:
        """The pairs that link, by their estimates and then their full sets."""
        right = bodies.select(F.col("node").alias("b"), F.col("registers").alias("rb"), F.col("text").alias("tb"))
        left = bodies.select(F.col("node").alias("a"), F.col("registers").alias("ra"), F.col("text").alias("ta"))
        together = pairs.join(right, "b").join(left, "a").select("a", "b", "ra", "rb", "ta", "tb")
        found = together.mapInArrow(_verifier(shingle, percent), "a bigint, b bigint, linked boolean")
        return found.filter("linked").select("a", "b")

    # The pivot has the smallest id: more often than not what the others were copied from.
    pivots = members.groupBy("bucket").agg(F.min(F.struct("id", "node", "n")).alias("p"))
    near = 100 * F.least("n", "p.n") >= percent * F.greatest("n", "p.n")
    first = members.join(pivots, "bucket").filter(near & (F.col("node") != F.col("p.node")))
    ends = F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")
    first = store(first.select(*ends).distinct(), "pairs")
    links = store(same_id.unionByName(checked(first)), "linked")
    labels = components(links)
    labelled = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = store(labelled, "labelled")
    open_ = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    labelled = store(labelled.join(open_.filter("low < high").select("bucket"), "bucket"), "open")
    second = store(_meet(labelled, bodies, shingle, percent).join(first, ["a", "b"], "left_anti"), "pairs")
    if not second.isEmpty():
        labels = components(links.unionByName(store(checked(second), "linked")))
    named = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = store(named.select("doc", "label").distinct(), "named")
    smallest = named.groupBy("label").agg(F.min("doc").alias("component_id"))
    named = named.join(smallest, "label").select(F.col("doc").alias(id_col), "component_id").distinct()
    out = rows.select(id_col, F.col("n").alias("n_shingles")).join(named, id_col, "left")
    component = F.coalesce("component_id", id_col)
    return out.select(
        id_col,
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col(id_col), F.lit(True)).alias("kept"),
    )


def _type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()

