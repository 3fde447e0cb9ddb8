"""A convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the mean of the hashed vectors of the word, its beginnings and its
ending; of a word longer than 32 bytes, its first 32 and its length stand for the word. Filters of several widths slide over the words of a text; each stretch of
``STRETCH`` words keeps every filter's maximum, and a text is described by the maximum
of those, their mean, and the logarithm of their sum, so that one chance hit in a long
text differs from many. A logistic layer gives the score.

Training takes every labelled row but those kept for calibration, a quarter by a hash of
the id. Rows lie in partitions by that hash; a task learns an epoch from its rows in units
of bounded size, all starting from the same weights. What units learned is averaged on the
executors: a word's vector over the steps that moved it, filters and the logistic layer
over rows. The driver sends and gets back the weights alone, a fixed number, once an epoch.
A text of over ``PIECE`` words is learned from in pieces, each with its label. Raw scores
are shifted so that the best cut over all calibration rows is ``CUT``, and each language
with enough positives there gets a cut of its own, used only after scoring. Cuts are told
apart to 1 / ``GRID``.

Defined results: a null or empty text has no stretch and gets the score of the bias; an
unlabelled or one-class sample gives every text that class's prior; extra columns are
ignored; repeated rows come out repeated; an empty table gives an empty one.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoscore.llm.common import batch, crc_remainder, raw, rows_of, share, texts, words
from geoscore.sources.storage import store

WIDTHS = (1, 2, 3)
STRETCH = 64
#: The score at and above which a text is toxic.
CUT = 0.3
BATCH_BYTES = 4 << 20
#: Texts in a training step.
BATCH = 64
#: Words whose filter responses one task remembers before it starts afresh.
REMEMBERED = 150_000
#: New words whose parts are worked out together in training.
FRESH = 8192
#: Labelled rows for each partition, partitions at most, and rows and bytes of a unit.
PART_ROWS, PARTITIONS = 10_000, 2048
UNIT_ROWS, UNIT_BYTES = 10_000, 32 << 20
#: Words of a piece of a long text, and of a training step.
PIECE = 1 << 17
STEP_WORDS = 1 << 19
#: Logits are counted by steps of 1 / GRID within REACH.
GRID, REACH = 256, 40
#: Values of a block that tasks add up.
BLOCK = 1 << 13
#: Rows of the bitmap of labelled ids and bits in a row: 16 MiB at most.
MARKS, MARKS_IN_ROW = 1 << 12, 1 << 15
STRIPPED = b".,;:!?\"'()[]{}|&%$#*"
#: Bytes of a word's beginnings that have vectors of their own; with word and ending, its parts.
BEGINNINGS = (4, 6, 7)
PARTS = len(BEGINNINGS) + 2


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 16
    dim: int = 16
    filters: int = 8
    #: Positives a language needs among them for a cut of its own.
    least_positives: int = 40
    epochs: int = 4
    rate: float = 0.01
    seed: int = 7


@dataclass
class Model:
    settings: Settings
    table: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    head: np.ndarray
    offset: float
    shift: float = 0.0
    cuts: dict[str, float] = field(default_factory=dict)


def parts(words_: Sequence[bytes], buckets: int) -> np.ndarray:
    """Buckets of each word's letters, its beginnings and its ending, a row per word."""
    bare = [w.strip(STRIPPED) for w in words_]
    letters = np.array(bare, "S32").view(np.uint8).reshape(len(bare), 32).astype(np.uint64)
    endings = np.array([w[-4:] for w in bare], "S4").view(np.uint8).reshape(len(bare), 4)
    out = np.empty((len(bare), PARTS), np.int32)
    state = np.full(len(bare), 1469598103934665603, np.uint64)
    prime = np.uint64(1099511628211)
    for k in range(32):
        state = (state ^ letters[:, k]) * prime
        if k + 1 in BEGINNINGS:
            out[:, BEGINNINGS.index(k + 1)] = _bucket(state, buckets)
    out[:, -2] = _bucket(state + np.array([len(w) for w in bare], np.uint64), buckets)
    state = np.full(len(bare), 7, np.uint64)
    for k in range(4):
        state = (state ^ endings[:, k]) * prime
    out[:, -1] = _bucket(state, buckets)
    return out


def _bucket(state: np.ndarray, buckets: int) -> np.ndarray:
    return ((state ^ (state >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)) % buckets


def slots(filters: int) -> list[tuple[int, int, slice]]:
    """(width, offset, columns of the kernel) of each filter bank."""
    pairs = [(w, j) for w in WIDTHS for j in range(w)]
    return [(w, j, slice(k * filters, (k + 1) * filters)) for k, (w, j) in enumerate(pairs)]


class Lexicon(dict):
    """Word to row number; row 0 is no word. ``fresh`` words have no parts yet."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.fresh.append(word)
        self[word] = n = len(self) + 1
        return n


def features(stretches: np.ndarray, owner: np.ndarray, docs: int) -> np.ndarray:
    """Maximum, mean and log of the sum over each text's stretches; zeros without any."""
    width = stretches.shape[1]
    out = np.zeros((docs, 3 * width), np.float32)
    if len(owner):
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        at = owner[starts]
        total = np.add.reduceat(stretches, starts, axis=0)
        count = np.diff(np.r_[starts, len(owner)])[:, None]
        out[at, :width] = np.maximum.reduceat(stretches, starts, axis=0)
        out[at, width : 2 * width] = total / count
        out[at, 2 * width :] = np.log1p(total)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class State:
    """What an epoch starts from and leaves: weights and the sizes of their steps so far."""

    table: np.ndarray
    squares: np.ndarray
    #: Kernel, bias, head and offset, with their first and second moments.
    dense: list[np.ndarray]
    first: list[np.ndarray]
    second: list[np.ndarray]
    step: int = 0

    def model(self, settings: Settings) -> Model:
        kernel, bias, head, offset = self.dense
        return Model(settings, self.table, kernel, bias, head, float(offset[0]))


@dataclass
class Unit:
    """Texts as numbers of words, the buckets of each word, and labels."""

    coded: list[np.ndarray]
    codes: np.ndarray
    labels: np.ndarray


def unit(rows: Iterable[tuple[bytes, int]], settings: Settings) -> Unit:
    lexicon = Lexicon()
    coded, marks, codes = [], [], [np.zeros((1, PARTS), np.int32)]
    for t, y in rows:
        text = np.fromiter((lexicon[w] for w in words(t)), np.int32)
        for start in range(0, max(len(text), 1), PIECE):
            coded.append(text[start : start + PIECE])
            marks.append(y)
        if len(lexicon.fresh) >= FRESH:
            codes.append(parts(lexicon.fresh, settings.buckets))
            lexicon.fresh = []
    if lexicon.fresh:
        codes.append(parts(lexicon.fresh, settings.buckets))
    return Unit(coded, np.concatenate(codes), np.array(marks, np.float32))


def started(settings: Settings, counts: np.ndarray, texts_: np.ndarray) -> State:
    """Seeded weights; each bucket starts from its log odds by ``counts`` of texts per class."""
    s = settings
    rng = np.random.default_rng(s.seed)
    banks, columns = slots(s.filters), len(WIDTHS) * s.filters
    table = rng.normal(0, 0.1, (s.buckets, s.dim)).astype(np.float32)
    table[:, 0] = log_odds(counts, texts_)
    kernel = rng.normal(0, 0.1, (s.dim, len(banks) * s.filters)).astype(np.float32)
    kernel[0] += 1.0
    head = rng.normal(0, 0.1, 3 * columns).astype(np.float32)
    dense = [kernel, np.zeros(columns, np.float32), head, np.zeros(1, np.float32)]
    squares = np.full(s.buckets, 1e-3, np.float32)
    return State(table, squares, dense, [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense])


def steps(coded: Sequence[np.ndarray], order: np.ndarray) -> Iterator[np.ndarray]:
    """``order`` in steps of at most ``BATCH`` texts and ``STEP_WORDS`` words, or one text."""
    start = size = 0
    for k, i in enumerate(order):
        if k - start == BATCH or (k > start and size + len(coded[i]) > STEP_WORDS):
            yield order[start:k]
            start, size = k, 0
        size += len(coded[i])
    if start < len(order):
        yield order[start:]


def learn(state: State, u: Unit, settings: Settings, epoch: int, part: int = 0) -> np.ndarray:
    """One epoch of Adam steps over a unit, in place; how many steps moved each bucket."""
    s = settings
    rng = np.random.default_rng([s.seed, epoch, part])
    banks, columns = slots(s.filters), len(WIDTHS) * s.filters
    coded, codes, labels = u.coded, u.codes, u.labels
    table, squares = state.table, state.squares
    kernel, bias, head, offset = state.dense
    moved = np.zeros(s.buckets, np.float32)
    for chosen in steps(coded, rng.permutation(len(coded))):
        owner, padded, valid = _stretches([coded[i] for i in chosen])
        if not len(owner):
            continue
        used, local = np.unique(padded, return_inverse=True)
        local = local.reshape(padded.shape)
        vectors = table[codes[used]].mean(1)
        vectors[used == 0] = 0
        response = vectors @ kernel
        winners, value = [], np.empty((len(owner), columns), np.float32)
        for k, width in enumerate(WIDTHS):
            out = sum(response[local[:, j : j + STRETCH], c] for w, j, c in banks if w == width)
            out = np.where(valid[:, :, None], out, -np.inf)
            best = out.argmax(1)
            winners.append(best)
            cols = slice(k * s.filters, (k + 1) * s.filters)
            value[:, cols] = np.take_along_axis(out, best[:, None], 1)[:, 0]
        value += bias
        hidden = np.maximum(value, 0)
        x = features(hidden, owner, len(chosen))
        error = (sigmoid(x @ head + offset[0]) - labels[chosen]) / len(chosen)
        g_head, g_offset = x.T @ error + 1e-5 * head, error.sum(keepdims=True)
        g_x = error[:, None] * head
        size = np.bincount(owner, minlength=len(chosen))[:, None]
        total = np.expm1(x[:, 2 * columns :])
        g = g_x[owner, columns : 2 * columns] / size[owner]
        g = g + (g_x[:, 2 * columns :] / (1 + total))[owner]
        top = hidden == x[owner, :columns]
        g = (g + np.where(top, g_x[owner, :columns], 0)) * (value > 0)
        # The gradient of each used word's response to each kernel column.
        rows_at = np.arange(len(owner))[:, None]
        cells, weights = [], []
        for w, j, c in banks:
            k = WIDTHS.index(w)
            seen = local[rows_at, winners[k] + j]
            cells.append((seen * kernel.shape[1] + np.arange(c.start, c.stop)).ravel())
            weights.append(g[:, k * s.filters : (k + 1) * s.filters].ravel())
        pulled = np.bincount(
            np.concatenate(cells), np.concatenate(weights), len(used) * kernel.shape[1]
        )
        pulled = pulled.reshape(len(used), -1).astype(np.float32)
        pulled[used == 0] = 0
        hot = np.flatnonzero(pulled.any(1))
        g_kernel = vectors[hot].T @ pulled[hot]
        g_hot = pulled[hot] @ kernel.T
        at = codes[used[hot]].ravel()
        push = np.repeat(g_hot / codes.shape[1], codes.shape[1], axis=0)
        np.add.at(squares, at, (push**2).sum(1))
        np.subtract.at(table, at, s.rate * 5 * push / np.sqrt(squares[at])[:, None])
        moved[at] += 1  # once a step, however often a bucket is there
        state.step += 1
        gradients = (g_kernel, g.sum(0), g_head, g_offset)
        for p, gradient, m, v in zip(state.dense, gradients, state.first, state.second):
            m += 0.1 * (gradient - m)
            v += 0.01 * (gradient**2 - v)
            p -= s.rate * (1 - epoch / s.epochs) * (m / (1 - 0.9**state.step)) / (
                np.sqrt(v / (1 - 0.99**state.step)) + 1e-8
            )
    return moved


def train(rows: Iterable[tuple[bytes, int]], settings: Settings) -> Model:
    """Fits the classifier to (text, label) rows as one unit."""
    u = unit(rows, settings)
    state = started(settings, class_counts(u, settings.buckets), np.bincount(u.labels.astype(int), minlength=2))
    for epoch in range(settings.epochs):
        learn(state, u, settings, epoch)
    return state.model(settings)


def class_counts(u: Unit, buckets: int) -> np.ndarray:
    """Texts of each class that hold a bucket."""
    counts = np.zeros((2, buckets))
    for c, y in zip(u.coded, u.labels):
        counts[int(y), np.unique(u.codes[np.unique(c)])] += 1
    return counts


def log_odds(counts: np.ndarray, texts_: np.ndarray) -> np.ndarray:
    """Where training starts: how much likelier a bucket is in class 1, shrunk if it is rare."""
    share = (counts + 1) / (texts_[:, None] + 2)
    seen = counts.sum(0)
    return np.log(share[1] / share[0]) * seen / (seen + 20)


def _stretches(coded: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches as padded rows, which text each is of, and which places hold words."""
    reach = max(WIDTHS) - 1
    counts = [-(-len(c) // STRETCH) for c in coded]
    owner = np.repeat(np.arange(len(coded)), counts)
    padded = np.zeros((len(owner), STRETCH + reach), np.int32)
    valid = np.zeros((len(owner), STRETCH), bool)
    row = 0
    for c in coded:
        for start in range(0, len(c), STRETCH):
            piece = c[start : start + STRETCH + reach]
            padded[row, : len(piece)] = piece
            valid[row, : min(STRETCH, len(c) - start)] = True
            row += 1
    return owner, padded, valid


class Scorer:
    """Logits of texts under a model."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._restart()

    def _restart(self) -> None:
        self.lexicon = Lexicon()
        self.response = np.zeros((1, self.model.kernel.shape[1]), np.float32)

    def logits(self, texts_: Sequence[bytes]) -> np.ndarray:
        m, s = self.model, self.model.settings
        if len(self.lexicon) > REMEMBERED:
            self._restart()
        lexicon, reach = self.lexicon, max(WIDTHS) - 1
        pad = [0] * reach
        flat: list[int] = []
        ends, lengths = [], []
        for t in texts_:
            coded = list(map(lexicon.__getitem__, words(t)))
            lengths.append(len(coded))
            flat += coded
            flat += pad
            ends.append(len(flat))
        if lexicon.fresh:
            codes = parts(lexicon.fresh, s.buckets)
            self.response = np.concatenate([self.response, m.table[codes].mean(1) @ m.kernel])
            lexicon.fresh = []
        ids = np.array(flat, np.int32)
        size = np.array(lengths)
        begins = np.array(ends) - size - reach
        counts = -(-size // STRETCH)
        owner = np.repeat(np.arange(len(size)), counts)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = begins[owner] + STRETCH * within
        # Each text's stretches, then its padding, which is dropped again.
        cuts = np.concatenate([starts, begins[size > 0] + size[size > 0]])
        order = np.argsort(cuts, kind="stable")
        keep = order < len(starts)
        stretches = np.empty((len(starts), len(WIDTHS) * s.filters), np.float32)
        for k, width in enumerate(WIDTHS):
            n = len(ids)
            out = np.zeros((n, s.filters), np.float32)
            for w, j, c in slots(s.filters):
                if w == width:
                    out[: n - j] += self.response[:, c][ids[j:]]
            if len(starts):
                best = np.maximum.reduceat(out, cuts[order], axis=0)[keep]
                stretches[:, k * s.filters : (k + 1) * s.filters] = best
        hidden = np.maximum(stretches + m.bias, 0)
        return features(hidden, owner, len(size)) @ m.head + m.offset


def fit(
    docs: DataFrame,
    labels: DataFrame,
    settings: Settings = Settings(),
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    lang_col: str = "lang",
) -> Model:
    """Trains and calibrates on all labelled rows.

    Repeated labels of one id count as their maximum; ids that are null and labels but 0 and 1 don't count.
    """
    marked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    marked = marked.filter(F.col("_y").isin(0, 1)).dropna()
    partitions = min(max(1, -(-marked.count() // PART_ROWS)), PARTITIONS)
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.struct(
            F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.coalesce(F.col(lang_col), F.lit("")).alias("_lang")
        ).alias("_row"),
    )
    # Texts and labels meet by id in one shuffle, which is the layout of all epochs too. Of
    # several texts of one id the smallest counts.
    rows = labelled(rows, marked).unionByName(marked, allowMissingColumns=True).repartition(partitions, "_id")
    rows = rows.groupBy("_id").agg(F.max("_y").alias("_y"), F.min("_row").alias("_row")).dropna()
    rows = rows.withColumn("_h", F.xxhash64("_id"))
    calibrates = (F.pmod(F.col("_h"), F.lit(4)) == 3).alias("_calibrates")
    rows = rows.select("_id", "_h", "_y", "_row.*", calibrates)
    # Kept on disk; a lost block is made again in the same order.
    rows = rows.sortWithinPartitions("_h", "_id")
    rows = rows.persist(StorageLevel.DISK_ONLY)
    try:
        counts = {(r[0], r[1]): r[2] for r in rows.groupBy("_calibrates", "_y").count().collect()}
        classes = {y: c for (apart, y), c in counts.items() if not apart}
        if len(classes) < 2:
            return constant(settings, float(min(classes, default=0)))
        model = taught(rows.filter(~F.col("_calibrates")).select("_text", "_y"), settings)
        if any(apart for apart, _ in counts):
            calibrate(rows.filter("_calibrates").select("_text", "_y", "_lang"), model)
        return model
    finally:
        rows.unpersist()


def labelled(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """The rows whose id may be in ``marked``, by a bitmap of fixed size that is sent to all.

    Keeps texts without a label out of the shuffle; meeting the labels drops the
    few that share a bit with another id.
    """
    place = F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(MARKS * MARKS_IN_ROW))
    at = marked.select((place / MARKS_IN_ROW).cast("int").alias("_at"), (place % MARKS_IN_ROW).alias("_place"))
    bitmap = at.groupBy("_at").agg(F.bitmap_construct_agg("_place").alias("_bits"))
    placed = rows.select("*", (place / MARKS_IN_ROW).cast("int").alias("_at"), (place % MARKS_IN_ROW).cast("int").alias("_place"))
    byte = F.expr("conv(hex(substring(_bits, _place div 8 + 1, 1)), 16, 10)").cast("int")
    found = placed.join(F.broadcast(bitmap), "_at")
    return found.filter(byte.bitwiseAND(F.expr("shiftleft(1, _place % 8)")) != 0).select(*rows.columns)


def constant(settings: Settings, prior: float) -> Model:
    """A model that gives every text the one class there is."""
    s, width = settings, len(WIDTHS) * settings.filters
    empty = np.zeros((s.buckets, s.dim), np.float32)
    kernel = np.zeros((s.dim, len(slots(s.filters)) * s.filters), np.float32)
    return Model(s, empty, kernel, np.zeros(width), np.zeros(3 * width), 40.0 if prior == 1 else -40.0)


def units(batches: Iterator[pa.RecordBatch], settings: Settings) -> Iterator[Unit]:
    """A task's (text, label) rows in units of at most ``UNIT_ROWS`` rows and about ``UNIT_BYTES``."""
    held: list[tuple[bytes, int]] = []
    size = 0
    for part in batches:
        for t, y in zip(raw(part.column(0)), part.column(1).to_pylist()):
            held.append((t, y))
            size += len(t)
            if len(held) == UNIT_ROWS or size >= UNIT_BYTES:
                yield unit(held, settings)
                held, size = [], 0
    if held:
        yield unit(held, settings)


def summed(rows: DataFrame, length: int, dtype: str, run: Callable[[Iterator[pa.RecordBatch], int], np.ndarray]) -> np.ndarray:
    """The sum over all tasks of the ``length`` values that ``run`` makes of a task's rows.

    Blocks of values meet on the executors; the driver reads one sum of fixed size. Tasks
    are added in their order, so that equal rows give equal sums.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        values = run(batches, task)
        for k, start in enumerate(range(0, length, BLOCK)):
            piece = values[start : start + BLOCK]
            if piece.any():
                yield batch(_BLOCKS, [[k], [task], [piece.astype(dtype).tobytes()]])

    def add(table: pa.Table) -> pa.Table:
        held = sorted(zip(table["task"].to_pylist(), table["sums"].to_pylist()))
        total = np.sum([np.frombuffer(v, dtype) for _, v in held], axis=0, dtype=np.float64)
        return pa.Table.from_batches([batch(_BLOCKS, [[table["block"][0].as_py()], [0], [total.astype(dtype).tobytes()]])])

    out = np.zeros(length, dtype)
    schema = "block int, task int, sums binary"
    for r in rows.mapInArrow(blocks, schema).groupBy("block").applyInArrow(add, schema).collect():
        piece = np.frombuffer(r["sums"], dtype)
        out[r["block"] * BLOCK :][: len(piece)] = piece
    return out


_BLOCKS = pa.schema([("block", pa.int32()), ("task", pa.int32()), ("sums", pa.binary())])


def taught(rows: DataFrame, settings: Settings) -> Model:
    """Trains on all ``_text, _y`` rows, epoch by epoch."""
    s = settings

    def count(batches: Iterator[pa.RecordBatch], task: int) -> np.ndarray:
        total = np.zeros(2 * s.buckets + 2)
        for u in units(batches, s):
            total[: 2 * s.buckets] += class_counts(u, s.buckets).ravel()
            total[2 * s.buckets :] += np.bincount(u.labels.astype(int), minlength=2)
        return total

    total = summed(rows, 2 * s.buckets + 2, "f8", count)
    state = started(s, total[: 2 * s.buckets].reshape(2, -1), total[2 * s.buckets :])
    for epoch in range(s.epochs):
        state = after(state, rows, s, epoch)
    return state.model(s)


def after(state: State, rows: DataFrame, settings: Settings, epoch: int) -> State:
    """The state after an epoch in which every unit starts from ``state``, averaged."""
    s, n = settings, settings.buckets
    small = [*state.dense, *state.first, *state.second]
    ends = np.cumsum([n * s.dim, n, n, *(p.size for p in small), 1, 1])
    shared = share(rows, state)  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch], task: int) -> np.ndarray:
        total = np.zeros(ends[-1], np.float32)
        table, squares, moves, *others, steps_, texts_ = np.split(total, ends[:-1])
        before = shared()
        for k, u in enumerate(units(batches, s)):
            own = copy.deepcopy(before)
            moved, weight = learn(own, u, s, epoch, task + PARTITIONS * k), len(u.labels)
            table += (moved[:, None] * (own.table - before.table)).ravel()
            squares += moved * (own.squares - before.squares)
            moves += moved
            pairs = zip([*own.dense, *own.first, *own.second], [*before.dense, *before.first, *before.second])
            for sum_, (new, old) in zip(others, pairs):
                sum_ += weight * (new - old).ravel()
            steps_ += weight * (own.step - before.step)
            texts_ += weight
        return total

    table, squares, moves, *others, steps_, texts_ = np.split(summed(rows, int(ends[-1]), "f4", run), ends[:-1])
    share_of = np.maximum(moves, 1)
    small = [p + (d / texts_[0]).reshape(p.shape) for p, d in zip(small, others)]
    k = len(state.dense)
    return State(
        state.table + table.reshape(state.table.shape) / share_of[:, None],
        state.squares + squares / share_of,
        small[:k],
        small[k : 2 * k],
        small[2 * k :],
        state.step + max(1, round(float(steps_[0] / texts_[0]))),
    )


def calibrate(rows: DataFrame, model: Model) -> None:
    """Sets the shift and the languages' cuts of ``model`` from all ``_text, _y, _lang`` rows."""
    shared = share(rows, model)
    least = model.settings.least_positives

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared())
        for part in rows_of(batches, BATCH_BYTES):
            logits = np.clip(scorer.logits(raw(part.column(0))), -REACH, REACH)
            steps_ = pa.array(np.rint(logits * GRID).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column(2), part.column(1), steps_], names=["_lang", "_y", "_step"])

    counted = rows.mapInArrow(run, "_lang string, _y int, _step int").groupBy("_lang", "_step")
    counted = store(counted.agg(F.sum("_y").alias("hits"), F.count(F.lit(1)).alias("rows")), "toxicity-logits")
    # At most 2 * REACH * GRID + 1 steps, whatever the number of rows.
    both = counted.groupBy("_step").agg(F.sum("hits"), F.sum("rows")).toPandas().to_numpy(float)
    at_cut = np.log(CUT / (1 - CUT))
    model.shift = float(at_cut - best_cut(both[:, 0] / GRID, both[:, 1], both[:, 2]))

    def own(table: pa.Table) -> pa.Table:
        step, hits, n = (table[c].to_numpy().astype(float) for c in ("_step", "hits", "rows"))
        found = hits.sum() >= least
        cut = [best_cut(step / GRID, hits, n)] if found else []
        return pa.table({"_lang": table["_lang"].slice(0, len(cut)), "cut": pa.array(cut, pa.float64())})

    for r in counted.groupBy("_lang").applyInArrow(own, "_lang string, cut double").collect():
        model.cuts[r["_lang"]] = float(sigmoid(np.array(r["cut"] + model.shift)))


def best_cut(logits: np.ndarray, y: np.ndarray, rows: np.ndarray | None = None) -> float:
    """The middle of the widest range of cuts with the best F1; 0 without positives.

    With ``rows``, a logit stands for so many rows, ``y`` of them positive.
    """
    if not y.any():
        return 0.0
    order = np.argsort(-logits, kind="stable")
    ranked = logits[order]
    hits = np.cumsum(y[order])
    seen = np.arange(1, len(y) + 1) if rows is None else np.cumsum(rows[order])
    f1 = 2 * hits / (seen + y.sum())
    last = np.flatnonzero(np.r_[ranked[1:] != ranked[:-1], True])  # ties fall together
    best = last[f1[last] == f1[last].max()]
    below = np.where(best + 1 < len(ranked), ranked[np.minimum(best + 1, len(ranked) - 1)], ranked[best] - 2)
    k = int(np.argmax(ranked[best] - below))
    return float((ranked[best[k]] + below[k]) / 2)


def score(
    docs: DataFrame,
    model: Model,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id_col`` and ``score``, from the text alone."""
    rows = texts(docs, id_col, text_col)
    shared = share(docs, model)  # a fixed number of weights
    id_type = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_scorer(shared), f"`{id_col}` {id_type}, score double")


def _scorer(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared())
        for part in rows_of(batches, BATCH_BYTES):
            logits = scorer.logits(raw(part.column(1))) + scorer.model.shift
            values = sigmoid(logits.astype(np.float64))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(values, pa.float64())],
                names=[part.schema.names[0], "score"],
            )

    return run


def scored_with_rows(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Every column of ``docs`` with ``toxicity`` in front, for filters on the same pass."""
    schema = f"toxicity double, {', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema)}"
    shared = share(docs, model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared())
        for part in rows_of(batches, BATCH_BYTES):
            column = raw(part.column(names.index(text_col)))
            logits = scorer.logits([t or b"" for t in column]) + scorer.model.shift
            values = pa.array(sigmoid(logits.astype(np.float64)), pa.float64())
            yield pa.RecordBatch.from_arrays([values, *part.columns], names=["toxicity", *names])

    return docs.mapInArrow(run, schema)


def language_cut(model: Model, lang_col: str = "lang") -> Column:
    """The calibrated cut of a row's language, ``CUT`` where it has none of its own."""
    cut = F.lit(CUT)
    for lang, value in sorted(model.cuts.items()):
        cut = F.when(F.col(lang_col) == lang, F.lit(value)).otherwise(cut)
    return cut


def contract_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The labelled rows that may be learned from: crc32 of the id modulo 4 is not 2."""
    return labels.filter(crc_remainder(id_col, 4) != 2)


def predictions(scored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return scored.select(
        id_col,
        (crc_remainder(id_col, 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )
