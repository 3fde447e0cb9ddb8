"""Language-model scoring by online logistic mixing of hashed-context bit predictors.

A text, A-Z in lower case, is a sequence of bytes and an end. Each byte is a path of binary
decisions in a prefix code, short for frequent bytes, so frequent bytes take few steps.
Every context (``CONTEXTS``: the last bytes, or the word so far) has
counts of both outcomes at each step, gathered by Spark from all training documents. A
prediction is the log odds of those counts. Predictions are added with weights
from a set that a gate picks, by which contexts have been seen, and each document refines
its weights as it is read: after every stretch, the first of ``STRETCH`` decisions, each double
the one before up to ``LONGEST``, they move along the gradient of the coding cost. The cost of
all decisions gives total bits, and bits per byte.

The base score is the add-one unigram over tokens. A block of documents lists its distinct
tokens once, packed by parts that a hash of the token deals; counts are summed per token over
all blocks and come back to each block, so no vocabulary is ever held whole in one place. The model goes the same way: a block, stored as
a row of packed texts, lists its distinct pairs of a context and the byte after it, counts are summed per pair in parts dealt by
a hash of the context, and the log odds along each byte's path come back to the blocks that
listed it. The last bytes are kept as they are and words by 56 bits of hash, so contexts don't
share counts, and the number of parts follows the input.

Defined results: a null or empty text is an end alone; without training documents every
prediction is even and the base knows no token; rows without an id count as held in by the
remainder of the empty text; extra columns are ignored; repeated rows come out repeated;
an empty table gives an empty one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoscore.llm.common import crc_remainder, raw, rows_of, share
from geoscore.sources.storage import store

#: What predicts: so many of the last bytes, and then the word so far.
ORDERS = (3, 5)
CONTEXTS = (*ORDERS, "word")
#: Text whose pairs of all contexts are summed in one part.
PART_BYTES = 16 << 20
#: Steps of log odds kept in a byte.
STEPS = 10
#: Text of a block, and of a batch of the byte model; the model of a batch fits the cache.
BLOCK_BYTES = 8 << 20
BATCH_BYTES = 1 << 15
#: Decisions in a document's first stretch, and in the longest.
STRETCH, LONGEST = 256, 4096
#: Where every document's weights start; the gate adds 1 if the longer history, 2 if the word, is known.
WEIGHTS = np.array([[0.76, 0, 0], [0.72, 0.39, 0], [0.47, 0, 0.27], [0.3, 0.57, 0.29]], np.float32)
RATE = 0.6
#: The gate and the input of each weight that can matter: an unknown context gives no log odds.
GATE_OF = np.array([0, 1, 2, 3, 1, 3, 2, 3])
INPUT_OF = np.array([0, 0, 0, 0, 1, 1, 2, 2])
END = 255


@dataclass
class Code:
    """A prefix code over bytes: the nodes passed and the branches taken."""

    lengths: np.ndarray
    begins: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray


def prefix_code(counts: np.ndarray) -> Code:
    """The Huffman code of byte counts; every byte counts once more, so all have a path."""
    heap = [(int(c) + 1, i, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parents: dict[int, tuple[int, int]] = {}
    size = len(counts)
    for node in range(size - 1):
        for branch in (0, 1):
            weight, _, child = heapq.heappop(heap)
            parents[child] = (node, branch)
            total = weight if not branch else total + weight
        heapq.heappush(heap, (total, size + node, size + node))
    paths = []
    for symbol in range(size):
        path, at = [], symbol
        while at in parents:
            node, branch = parents[at]
            path.append((node, branch))
            at = size + node
        paths.append(path[::-1])
    flat = [step for p in paths for step in p]
    lengths = np.array([len(p) for p in paths], np.int32)
    return Code(
        lengths,
        np.cumsum(lengths, dtype=np.int32) - lengths,
        np.array([n for n, _ in flat], np.uint32),
        np.array([b for _, b in flat], np.uint8),
    )


def context(data: np.ndarray, begins: np.ndarray, kind: int | str) -> np.ndarray:
    """Every byte's context in 56 bits; documents start anew at ``begins``."""
    n = len(data)
    if kind != "word":
        wide = data.astype(np.uint64)
        recent = np.zeros(n, np.uint64)
        for k in range(1, kind + 1):
            recent[k:] |= wide[:-k] << np.uint64(8 * (k - 1))
        for k in range(kind):  # what stands before the document is no context
            early = begins + k
            recent[early[early < n]] &= np.uint64((1 << 8 * k) - 1)
        return recent
    index = np.arange(n, dtype=np.int32)
    fresh = np.zeros(n, bool)
    fresh[begins] = True
    # Words start after white space, and with the document.
    fresh[1:] |= data[:-1] <= 32
    start = np.maximum.accumulate(np.where(fresh, index, 0))
    powers, inverses = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:n], out=sums[1:])
    x = (sums[:n] - sums[start]) * inverses[start]
    return ((x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(8)


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        base = 0xD1342543DE82EF95
        for k, b in enumerate((base, pow(base, -1, 1 << 64))):
            ones = np.ones(1, np.uint64)
            _POWERS[k] = np.multiply.accumulate(np.concatenate([ones, np.full(n, b, np.uint64)]))
    return _POWERS


def joined(documents: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of documents, A-Z in lower case, each with its end; and how many each has."""
    data = np.frombuffer(b"".join(d.lower() + b"\xff" for d in documents), np.uint8)
    return data, np.array([len(d) + 1 for d in documents])


def mixed(sizes: np.ndarray, bit: np.ndarray, inputs: Sequence[np.ndarray]) -> np.ndarray:
    """Bits of each document of so many decisions with these branches and log odds; see :func:`weighed`."""
    sign = np.float32(1) - np.float32(2) * bit
    return weighed(sizes, [i * sign for i in inputs])


def weighed(sizes: np.ndarray, inputs: Sequence[np.ndarray]) -> np.ndarray:
    """Bits of each document of so many decisions, its weights refined stretch by stretch.

    Inputs are log odds of what did not come, so that weights times rows are the log odds of a wrong
    decision. A weight of a gate is the weight of a row that is zero where another gate holds.
    """
    x, longer, word = inputs
    n = len(x)
    gates = np.empty((4, n), np.float32)
    known = longer != 0, word != 0
    both = known[0] & known[1]
    gates[0] = ~(known[0] | known[1])
    gates[1], gates[2], gates[3] = known[0] ^ both, known[1] ^ both, both
    rows = np.empty((len(GATE_OF), n), np.float32)
    rows[0], rows[4], rows[6] = x, longer, word
    np.multiply(gates[1:], rows[0], out=rows[1:4])
    rows[0] *= gates[0]
    # An input is zero where it is not known, so what is not in both gates is in the other one.
    np.multiply(gates[3], rows[4], out=rows[5])
    np.multiply(gates[3], rows[6], out=rows[7])
    rows[4::2] -= rows[5::2]
    above = np.empty(n, np.float32)
    ones = np.ones(LONGEST, np.float32)
    ends = np.cumsum(sizes)
    start = WEIGHTS[GATE_OF, INPUT_OF] / np.float32(STEPS)
    for begin, end in zip((ends - sizes).tolist(), ends.tolist()):
        weights, stretch = start, STRETCH
        while begin < end:
            now = slice(begin, min(begin + stretch, end))
            x = rows[:, now]
            odds = weights @ x
            np.minimum(odds, np.float32(30), out=odds)
            np.exp(odds, out=odds)
            np.add(odds, np.float32(1), out=above[now])
            begin, stretch = now.stop, min(stretch * 2, LONGEST)
            if begin < end:  # what ends here has no use for better weights
                odds /= above[now]
                seen = gates[:, now] @ ones[: len(odds)] + np.float32(64)
                weights = weights - x @ odds * (np.float32(RATE / STEPS**2) / seen)[GATE_OF]
    np.log2(above, out=above)
    return np.add.reduceat(above.astype(np.float64), ends - sizes)


def observe(docs: DataFrame, id_col: str) -> DataFrame:
    """One pass: blocks of documents (kind 0, a row each) and byte counts (1)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    out_schema = (
        f"kind int, block bigint, ids array<{id_type}>, held_out array<boolean>, "
        "data binary, numbers binary, number int, n bigint"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "block", "ids", "held_out", "data", "numbers", "number", "n"]
        types = [pa.int32(), pa.int64(), None, pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.int32(), pa.int64()]

        def rows(kind: int, n: int, given: dict) -> pa.RecordBatch:
            given |= {"kind": pa.array(np.full(n, kind, np.int32)), "block": pa.array(np.full(n, block))}
            return pa.RecordBatch.from_arrays(
                [given[c] if c in given else pa.nulls(n, t) for c, t in zip(names, types)], names=names
            )

        block = TaskContext.get().partitionId() << 24
        pack = zstandard.ZstdCompressor(level=6)
        histogram = np.zeros(256, np.int64)
        texts: list[bytes] = []
        kept: list[tuple[pa.Array, pa.Array]] = []

        def close() -> Iterator[pa.RecordBatch]:
            held = pa.concat_arrays([held for _, held in kept])
            whole = pa.array([0, len(texts)], pa.int32())
            sizes = np.array([len(t) for t in texts], np.uint32)
            given = {
                "ids": pa.ListArray.from_arrays(whole, pa.concat_arrays([ids for ids, _ in kept])),
                "held_out": pa.ListArray.from_arrays(whole, held),
                "data": pa.array([pack.compress(b"".join(texts))], pa.binary()),
                "numbers": pa.array([packed(sizes)], pa.binary()),
            }
            yield rows(0, 1, given)

        size = 0
        for part in rows_of(batches):
            types[2] = pa.list_(part.column(0).type)
            documents, held = raw(part.column(1)), part.column(2).to_numpy(zero_copy_only=False)
            learned = [t for t, h in zip(documents, held) if not h]
            if learned:
                histogram += np.bincount(joined(learned)[0], minlength=256)
            texts += documents
            kept.append((part.column(0), part.column(2)))
            size += part.nbytes
            if size >= BLOCK_BYTES:
                yield from close()
                block, size, texts, kept = block + 1, 0, [], []
        if types[2] is not None:
            if texts:
                yield from close()
            yield rows(1, 256, {"number": pa.array(np.arange(256, dtype=np.int32)), "n": pa.array(histogram)})

    return docs.mapInArrow(run, out_schema)


def documents_of(data: bytes, numbers: bytes) -> list[bytes]:
    """The texts of a block."""
    text = zstandard.ZstdDecompressor().decompress(data)
    ends = np.cumsum(unpacked(numbers, np.uint32), dtype=np.int64).tolist()
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def tokens(documents: Sequence[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct tokens, the end being the empty one; the number and the document of each that isn't an end."""
    text = b"".join(d.lower() for d in documents)
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in documents])]).astype(np.int64)
    column = pa.LargeStringArray.from_buffers(len(documents), pa.py_buffer(offsets), pa.py_buffer(text))
    split = pc.ascii_split_whitespace(column)
    flat = split.flatten().dictionary_encode()
    found = flat.dictionary.view(pa.large_binary())
    document = np.repeat(np.arange(len(documents), dtype=np.int32), np.diff(split.offsets.to_numpy()))
    number = flat.indices.to_numpy()
    # White space at either side leaves empty words.
    empty = pc.index(found, pa.scalar(b"", pa.large_binary())).as_py()
    if empty < 0:
        return pa.concat_arrays([found, pa.array([b""], pa.large_binary())]), number, document
    word = number != empty
    return found, number[word], document[word]


def dealt(found: pa.Array, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of tokens in the order of their parts and then of themselves; each one's part."""
    offsets = np.frombuffer(found.buffers()[1], np.int64)[found.offset : found.offset + len(found) + 1]
    text = np.frombuffer(found.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    ends, lengths = offsets - offsets[0], np.diff(offsets)
    place = np.arange(len(text)) - np.repeat(ends[:-1], lengths)
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * _powers(int(lengths.max()) + 1)[0][place], out=sums[1:])
    x = (sums[ends[1:]] - sums[ends[:-1]]) * np.uint64(0xD1342543DE82EF95)
    part = (((x ^ x >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
    order = pc.sort_indices(found).to_numpy()
    order = order[np.argsort(part[order], kind="stable")]
    return order, part[order]


def lines(found: pa.Array, cuts: list[int]) -> pa.Array:
    """Tokens from each cut to the next as one text, a line each; a token holds no line end."""
    lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), found)
    return pc.binary_join(lists, pa.scalar(b"\n", found.type))


def of_lines(text: bytes) -> pa.Array:
    """The lines of a text."""
    stops = np.flatnonzero(np.frombuffer(text, np.uint8) == 10)
    # Each line keeps its end, which is cut from all of them at once.
    offsets = np.concatenate([[0], stops + 1, [len(text) + 1]]).astype(np.int64)
    ended = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(text + b"\n")])
    return pc.binary_slice(ended, 0, -1)


def pair_keys(documents: Sequence[bytes], kind: int | str) -> np.ndarray:
    """Every byte's pair: the context and, in the low 8 bits, the byte."""
    keys, end = np.empty(sum(map(len, documents)) + len(documents), np.uint64), 0
    for few in batches_of(documents):
        data, sizes = joined(few)
        keys[end : end + len(data)] = context(data, np.cumsum(sizes) - sizes, kind) << np.uint64(8) | data
        end += len(data)
    return keys


def by_part(values: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of pairs, given in their order, by part and pair; each one's part."""
    x = (values >> np.uint64(8)) * np.uint64(0xD1342543DE82EF95)
    part = ((x ^ x >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)) % np.uint64(parts)
    order = np.argsort(part.astype(np.min_scalar_type(parts)), kind="stable")
    return order, part[order].astype(np.int64)


def pairs(documents: Sequence[bytes], kind: int | str, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of a context and the byte after it, by part and pair; each one's part; each byte's pair."""
    values, index = encoded(pair_keys(documents, kind))
    order = np.argsort(values)
    again, part = by_part(values[order], parts)
    order = order[again]
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return values[order], part, place[index]


def counted_pairs(
    documents: Sequence[bytes], learned: np.ndarray, kind: int | str, parts: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs and their parts as from :func:`pairs`; how often each is among the learned bytes."""
    keys = pair_keys(documents, kind)
    if kind in range(4):  # as sorting half the width takes half the time
        keys = keys.astype(np.uint32)
    others, keys = np.sort(keys[~learned]), np.sort(keys[learned])
    begins = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    known = keys[begins]
    values = np.sort(np.concatenate([known, others[np.flatnonzero(np.diff(others, prepend=~others[:1]))]]))
    values = values[np.flatnonzero(np.diff(values, prepend=~values[:1]))].astype(np.uint64)
    n = np.zeros(len(values), np.uint32)
    n[np.searchsorted(values, known.astype(np.uint64))] = np.diff(begins, append=len(keys))
    order, part = by_part(values, parts)
    return values[order], part, n[order]


def encoded(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, in the order of their first places, and the number of each key."""
    found = pa.array(keys).dictionary_encode()
    return found.dictionary.to_numpy(), found.indices.to_numpy()


def by_word(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`encoded`, by way of the distinct words: the pair that ends a word tells all its pairs."""
    last = keys & np.uint64(255)
    stops = np.flatnonzero((last <= 32) | (last == END)).astype(np.int32)
    lengths = np.diff(stops, prepend=np.int32(-1))
    word = encoded(keys[stops])[1]
    first = np.flatnonzero(np.diff(np.maximum.accumulate(word), prepend=-1))
    size = lengths[first]
    if (lengths != size[word]).any():  # two words of one hash
        return encoded(keys)
    begins = np.cumsum(size, dtype=np.int32) - size
    values, index = encoded(keys[np.repeat(stops[first] + 1 - size - begins, size) + np.arange(size.sum(), dtype=np.int32)])
    at = np.repeat(begins[word] - (stops + 1 - lengths), lengths)
    at += np.arange(len(keys), dtype=np.int32)
    return values, index[at]


def batches_of(documents: Sequence[bytes]) -> Iterator[Sequence[bytes]]:
    """Documents in runs of about ``BATCH_BYTES``, or one."""
    begin = size = 0
    for i, d in enumerate(documents):
        if size and size + len(d) > BATCH_BYTES:
            yield documents[begin:i]
            begin, size = i, 0
        size += len(d) + 1
    if begin < len(documents):
        yield documents[begin:]


def packed(values: np.ndarray) -> bytes:
    """Numbers as bytes, the lowest byte of all first."""
    planes = values.view(np.uint8).reshape(len(values), -1).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def path_odds(keys: np.ndarray, counts: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sums the counts of equal pairs. Log odds, in ``STEPS`` per unit, along each pair's path;
    where each path begins and its length; and the pair of every key."""
    # Bytes in the order of their paths, so that those below a node are side by side.
    paths = [tuple(code.bits[b : b + n].tolist()) for b, n in zip(code.begins, code.lengths)]
    symbols = np.array(sorted(range(len(paths)), key=paths.__getitem__), np.uint8)
    ranks = np.argsort(symbols).astype(np.uint64)
    low = np.uint64(255)
    found, inverse = np.unique((keys & ~low) | ranks[keys & low], return_inverse=True)
    n = np.zeros(len(found), np.int64)
    np.add.at(n, inverse, counts.astype(np.int64))
    symbol, known = symbols[found & low], found >> np.uint64(8)
    lengths = code.lengths[symbol]
    begins = np.cumsum(lengths, dtype=np.int64) - lengths
    out = np.zeros(int(lengths.sum()), np.int8)
    for level in range(int(lengths.max(initial=0))):
        live = np.flatnonzero(lengths > level)
        at = code.begins[symbol[live]] + level
        node, c, m = code.nodes[at], known[live], n[live]
        fresh = np.ones(len(live), bool)
        fresh[1:] = (c[1:] != c[:-1]) | (node[1:] != node[:-1])
        first = np.flatnonzero(fresh)
        one = np.add.reduceat(m * code.bits[at], first)
        none = np.add.reduceat(m, first) - one
        odds = np.clip(np.rint(np.log((one + 0.4) / (none + 0.4)) * STEPS), -127, 127).astype(np.int8)
        out[begins[live] + level] = odds[np.cumsum(fresh) - 1]
    return out, begins, lengths, inverse


def token_counts(observed: DataFrame, parts: int) -> DataFrame:
    """Per block and part, the sums over all blocks for the block's tokens, in their order.

    ``n`` and ``known`` add up to all training tokens and the distinct ones.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for block in rows_of(batches, 1):
            texts = documents_of(block["data"][0].as_py(), block["numbers"][0].as_py())
            train = ~block["held_out"].flatten().to_numpy(zero_copy_only=False)
            found, number, document = tokens(texts)
            n = np.bincount(number[train[document]], minlength=len(found)).astype(np.uint32)
            n[pc.index(found, pa.scalar(b"", found.type)).as_py()] = train.sum()
            order, part = dealt(found, parts)
            cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
            cuts.append(len(order))
            spans = [order[a:b] for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_pydict(
                {
                    "block": np.full(len(spans), block["block"][0].as_py()),
                    "number": part[cuts[:-1]].astype(np.int32),
                    "data": pa.array([pack.compress(t.as_buffer()) for t in lines(found.take(order), cuts)], pa.binary()),
                    "numbers": pa.array([packed(n[x]) for x in spans], pa.binary()),
                }
            )

    def add(part: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        lists = [of_lines(unpack.decompress(x)) for x in part["data"].to_pylist()]
        found = pa.concat_arrays(lists).dictionary_encode()
        index = found.indices.to_numpy()
        sums = np.zeros(len(found.dictionary), np.int64)
        np.add.at(sums, index, np.concatenate([unpacked(x, np.uint32) for x in part["numbers"].to_pylist()]).astype(np.int64))
        cuts = np.cumsum([len(x) for x in lists])[:-1]
        once = np.arange(len(lists)) == 0
        return pa.table(
            {
                "block": part["block"],
                "part": part["number"],
                "counts": pa.array([packed(x) for x in np.split(sums[index], cuts)], pa.binary()),
                "n": pa.array(once * sums.sum()),
                "known": pa.array(once * np.count_nonzero(sums)),
            }
        )

    blocks = observed.filter("kind = 0").select("block", "held_out", "data", "numbers")
    dealt_out = blocks.mapInArrow(listed, "block bigint, number int, data binary, numbers binary")
    return dealt_out.groupBy("number").applyInArrow(add, "block bigint, part int, counts binary, n bigint, known bigint")


def model(observed: DataFrame, parts: int, code: Code) -> DataFrame:
    """Per block and part, the log odds along the paths of the block's pairs, in their order."""
    shared = share(observed, code)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in rows_of(batches, 1):
            texts = documents_of(block["data"][0].as_py(), block["numbers"][0].as_py())
            held = block["held_out"].flatten().to_numpy(zero_copy_only=False)
            learned = ~np.repeat(held, [len(t) + 1 for t in texts])
            for k, kind in enumerate(CONTEXTS):
                keys, part, n = counted_pairs(texts, learned, kind, parts)
                cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
                spans = [slice(a, b) for a, b in zip(cuts, [*cuts[1:], len(keys)])]
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": np.full(len(spans), block["block"][0].as_py()),
                        "number": (k * parts + part[cuts]).astype(np.int32),
                        "keys": pa.array([packed(np.diff(keys[x], prepend=np.uint64(0))) for x in spans], pa.binary()),
                        "numbers": pa.array([packed(n[x]) for x in spans], pa.binary()),
                    }
                )

    def add(part: pa.Table) -> pa.Table:
        code = shared()
        keys = [np.cumsum(unpacked(x, np.uint64), dtype=np.uint64) for x in part["keys"].to_pylist()]
        counts = [unpacked(x, np.uint32) for x in part["numbers"].to_pylist()]
        odds, begins, lengths, pair = path_odds(np.concatenate(keys), np.concatenate(counts), code)
        out, end = [], 0
        for k in keys:
            mine = pair[end : end + len(k)]
            end += len(k)
            reps = lengths[mine]
            ends = np.cumsum(reps)
            at = np.arange(ends[-1]) + np.repeat(begins[mine] - (ends - reps), reps)
            out.append(zstandard.ZstdCompressor(level=3).compress(odds[at].tobytes()))
        columns = [part["block"], part["number"], pa.array(out, pa.binary())]
        return pa.table(columns, names=["block", "part", "odds"])

    blocks = observed.filter("kind = 0").select("block", "held_out", "data", "numbers")
    dealt_out = blocks.mapInArrow(listed, "block bigint, number int, keys binary, numbers binary")
    return dealt_out.groupBy("number").applyInArrow(add, "block bigint, part int, odds binary")


def block_costs(documents: Sequence[bytes], odds: dict[int, bytes], parts: int, code: Code) -> np.ndarray:
    """Bits of each document of a block by what came back of its pairs, per part."""
    known = []
    for k, kind in enumerate(CONTEXTS):
        values, part, pair = pairs(documents, kind, parts)
        lengths = code.lengths[values & np.uint64(255)]
        begins = np.cumsum(lengths, dtype=np.int32) - lengths
        unpack = zstandard.ZstdDecompressor()
        own = b"".join(unpack.decompress(odds[k * parts + p]) for p in np.unique(part).tolist())
        if len(own) != lengths.sum():
            raise ValueError("log odds don't fit the pairs of the block")
        # The byte of a pair tells the branches of its path: turn the odds to those of what did not come.
        at = np.arange(len(own), dtype=np.int32) + np.repeat(code.begins[values & np.uint64(255)] - begins, lengths)
        turned = np.frombuffer(own, np.int8) * (1 - 2 * code.bits.view(np.int8))[at]
        known.append((turned, begins, pair))
        del values, part, pair, at
    out, begin = [], 0
    for few in batches_of(documents):
        data, sizes = joined(few)
        reps = code.lengths[data]
        ends = np.cumsum(reps, dtype=np.int64)
        starts = ends - reps
        now = slice(begin, begin + len(data))
        index = np.arange(ends[-1])
        inputs = []
        for odds_of, begins, pair in known:
            at = np.repeat(begins.take(pair[now]) - starts, reps)
            at += index
            inputs.append(odds_of.take(at))
        out.append(weighed(np.add.reduceat(reps, np.cumsum(sizes) - sizes), inputs))
        begin = now.stop
    return np.concatenate(out)


def scored(observed: DataFrame, id_col: str, id_type: str, parts: int, code: Code) -> DataFrame:
    """Per document n_tokens, n_known, train_tokens and the scores."""
    counted = store(token_counts(observed, parts), "lm-counts")
    total, distinct = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    # Ids as text, since pandas turns integers beside nulls into floats.
    blocks = observed.filter("kind = 0").select(
        "block", F.col("ids").cast("array<string>").alias("ids"), "held_out", "data", "numbers"
    )
    log_all = float(np.log10(total + distinct + 1))

    shared = share(observed, code)

    def score(blocks: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        [block] = blocks.itertuples()
        texts = documents_of(block.data, block.numbers)
        odds = back[back["odds"].notna()]
        counts = back[back["odds"].isna()].set_index("part")["counts"]
        bits = block_costs(texts, dict(zip(odds["part"].astype(int), odds["odds"])), parts, shared())
        found, number, document = tokens(texts)
        order, part = dealt(found, parts)
        c = np.zeros(len(found), np.int64)
        c[order] = np.concatenate([unpacked(counts[p], np.int64) for p in np.unique(part).tolist()])
        logs = np.log10(c + 1.0) - log_all
        end = pc.index(found, pa.scalar(b"", found.type)).as_py()
        n = len(texts)
        return pd.DataFrame(
            {
                id_col: list(block.ids),
                "held_out": list(block.held_out),
                "n_tokens": np.bincount(document, minlength=n) + 1,
                "n_known": np.bincount(document[c[number] > 0], minlength=n) + int(c[end] > 0),
                "train_tokens": total,
                "base_score": np.bincount(document, logs[number], n) + logs[end],
                "score": bits * -np.log10(2),
                "bits_per_byte": bits / np.array([len(t) + 1 for t in texts]),
            }
        )

    schema = (
        f"`{id_col}` string, held_out boolean, n_tokens bigint, n_known bigint, "
        "train_tokens bigint, base_score double, score double, bits_per_byte double"
    )
    right = counted.select("block", "part", "counts").unionByName(model(observed, parts, code), allowMissingColumns=True)
    out = blocks.groupBy("block").cogroup(right.groupBy("block")).applyInPandas(score, schema)
    return out.withColumn(id_col, F.col(id_col).cast(id_type))


def byte_code(observed: DataFrame) -> Code:
    counts = np.zeros(256, np.int64)
    for row in observed.filter("kind = 1").groupBy("number").agg(F.sum("n").alias("n")).collect():
        counts[row["number"]] = row["n"]
    return prefix_code(counts)


def score_texts(
    docs: DataFrame,
    held_out: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Scores every document by a model of those that ``held_out`` leaves in.

    Returns ``id_col``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score``, ``score`` (log10) and ``bits_per_byte``, the end counted as a byte.
    """
    held_out = crc_remainder(id_col, 7) == 2 if held_out is None else held_out
    rows = docs.select(
        F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), held_out.alias("held_out")
    )
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    parts = 1 + size // PART_BYTES
    observed = store(observe(rows, id_col), "lm-tokens", ["kind"])
    return scored(observed, id_col, rows.schema[id_col].dataType.simpleString(), parts, byte_code(observed))
