"""Alignment of two tokenizers' tokens over the same bytes, by lockstep merging.

Tokenizer A is a byte-level merge vocabulary read by the tokenizers library, B a
sentencepiece model. Both give tokens of known bytes, so each token ends at a byte offset.
Offsets where tokens of both end cut the text into groups, and the tokens of a group are
linked, each of A with each of B.

The documents of a batch are merged side by side: state vectors hold where every document
stands in A and in B. A step compares the two ends of all documents at once, moves A where
A's token ends first, B where B's does, and both where they end together, which emits a
cut. Documents that are through leave the vectors. A long document takes several places
(lanes), each from one common end to another, so that it doesn't keep a step for itself.

How many documents hold a pair of ids linked is counted over the whole corpus: a block of
documents lists its distinct pairs once with their numbers of documents, numbers are summed
per pair, and the highest of each A id is found among the sums. Up to ``SENT`` distinct
pairs are then sent to all tasks; beyond, they return to the blocks that listed them, which
changes the plan and no row. A group's pairs are made from its distinct ids and how often each
occurs, so long groups of repeated tokens don't multiply.

Defined results: a null or empty text has no tokens, and neither has one whose tokens don't
spell a space and the text in both; control strings inside texts are plain text; rows that
repeat an id are documents of their own; extra columns are ignored; an empty table gives
an empty one. A text longer than a block is a block; memory follows it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoscore.llm.common import rows_of, share, texts
from geoscore.sources.storage import store

#: Text of a block, of a batch, and of a lane.
BLOCK_BYTES = 4 << 20
BATCH_BYTES = 2 << 20
LANE_BYTES = 4096
#: Links made at a time.
TOGETHER = 1 << 19
#: Below this character all releases of Unicode agree on what is a letter, digit or space.
SETTLED = "ɐ"
ID_BITS = 20
#: Distinct pairs sent to every task, 17 bytes each.
SENT = 2_000_000


class ByteTokenizer:
    """A byte-level merge vocabulary: ids of a space and the text.

    Texts of settled characters are encoded by tiktoken with the same merges and pattern,
    which is several times as fast; all others by the tokenizers library itself.
    """

    def __init__(self, path: str, pattern: str) -> None:
        # Loaded by tasks alone; the driver has no use for the libraries.
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        model = json.loads(self.library.to_str())["model"]
        letters = byte_letters()
        spoken = {}
        for piece, i in model["vocab"].items():
            if all(c in letters for c in piece):
                spoken[i] = bytes(letters[c] for c in piece)
        self.bytes = [spoken.get(i, b"") for i in range(self.library.get_vocab_size())]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        order = [model["vocab"][a + b] for a, b in merges]
        self.fast = None
        if order == sorted(order):  # ids stand in the order of merges: they are ranks
            special = {t.content for t in self.library.get_added_tokens_decoder().values()}
            ranks = {spoken[i]: i for p, i in model["vocab"].items() if i in spoken and p not in special}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts_: list[str]) -> list[list[int]]:
        settled = [self.fast is not None and (t.isascii() or max(t) < SETTLED) for t in texts_]
        rest = iter(self.library.encode_batch([" " + t for t, s in zip(texts_, settled) if not s], add_special_tokens=False))
        return [self.fast.encode_ordinary(" " + t) if s else next(rest).ids for t, s in zip(texts_, settled)]


def byte_letters() -> dict[str, int]:
    """The characters that stand for bytes: printable ones for themselves, others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class PieceTokenizer:
    """A sentencepiece model: ids of the text, before which it puts a space."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.library
        self.bytes = [
            bytes([int(m.id_to_piece(i)[3:5], 16)])
            if m.is_byte(i)
            else b""
            if m.is_control(i) or m.is_unknown(i)
            else m.id_to_piece(i).replace("▁", " ").encode()
            for i in range(m.get_piece_size())
        ]

    def encode(self, texts_: list[str]) -> list[list[int]]:
        return self.library.encode(texts_, num_threads=1)


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts as (tokens of A, tokens of B) up to each, in order of place.

    ``ends_a`` and ``ends_b`` are the end offsets of all documents' tokens one after the
    other; each row of ``lanes`` is a stretch of both that starts and ends at a common
    offset: first token and end (exclusive) in A, the same in B.
    """
    a, stop_a, b, stop_b = lanes.T.copy()
    cuts = []
    while len(a):
        x, y = ends_a[a], ends_b[b]
        equal = x == y
        a = a + (x <= y)
        b = b + (y <= x)
        if equal.any():
            cuts.append((a[equal], b[equal]))
            live = ~(equal & (a == stop_a))
            if not live.all():
                a, stop_a, b, stop_b = a[live], stop_a[live], b[live], stop_b[live]
    if not cuts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut_a, cut_b = (np.concatenate(c) for c in zip(*cuts))
    order = np.argsort(cut_a, kind="stable")
    return cut_a[order], cut_b[order]


def lanes_of(ends_a: np.ndarray, ends_b: np.ndarray, first_a: int, first_b: int, size: int) -> list[tuple]:
    """A document as lanes of about ``size`` bytes between common ends."""
    begin_a = begin_b = 0
    lanes = []
    goal = size
    while len(ends_a) and goal + size < ends_a[-1]:
        # The first common end at or after the goal, looked for a stretch at a time.
        low, high = np.searchsorted(ends_a, [goal, goal + size])
        near = ends_a[low:high]
        at = np.searchsorted(ends_b, near)
        hit = np.flatnonzero(ends_b[np.minimum(at, len(ends_b) - 1)] == near)
        if len(hit):
            cut_a, cut_b = int(low + hit[0] + 1), int(at[hit[0]] + 1)
            lanes.append((first_a + begin_a, first_a + cut_a, first_b + begin_b, first_b + cut_b))
            begin_a, begin_b = cut_a, cut_b
            goal = int(ends_a[cut_a - 1]) + size
        else:
            goal += size
    if len(ends_a):
        lanes.append((first_a + begin_a, first_a + len(ends_a), first_b + begin_b, first_b + len(ends_b)))
    return lanes


def merged(ids_a: list[np.ndarray], ids_b: list[np.ndarray], size_a: np.ndarray, size_b: np.ndarray) -> list[np.ndarray]:
    """Per document its cuts, a row each: tokens of A and of B up to there."""
    begins_a = np.cumsum([0, *map(len, ids_a)])
    begins_b = np.cumsum([0, *map(len, ids_b)])
    all_a, all_b, lanes, shift = [], [], [], 0
    for k, (a, b) in enumerate(zip(ids_a, ids_b)):
        ends_a, ends_b = np.cumsum(size_a[a], dtype=np.int64), np.cumsum(size_b[b], dtype=np.int64)
        lanes += lanes_of(ends_a, ends_b, begins_a[k], begins_b[k], LANE_BYTES)
        all_a.append(ends_a + shift)
        all_b.append(ends_b + shift)
        shift += int(ends_a[-1]) if len(ends_a) else 0
    if not lanes:
        return [np.zeros((0, 2), np.int32) for _ in ids_a]
    cut_a, cut_b = lockstep(np.concatenate(all_a), np.concatenate(all_b), np.array(lanes, np.int64))
    where = np.searchsorted(cut_a, begins_a, side="right")
    return [
        np.stack([cut_a[i:j] - begins_a[k], cut_b[i:j] - begins_b[k]], axis=1).astype(np.int32)
        for k, (i, j) in enumerate(zip(where.tolist(), where[1:].tolist()))
    ]


def links(ids_a: np.ndarray, ids_b: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Linked ids: the row of ``cuts`` whose group it is of, a key of both ids, and how often.

    In groups of more than 8 tokens equal ids meet once, with the product of their numbers.
    """
    sizes = np.diff(cuts, axis=0, prepend=np.zeros((1, 2), cuts.dtype)).astype(np.int64)
    starts = cuts - sizes
    single = (sizes == 1).all(1)
    for chunk in _chunks(single.astype(np.int64), TOGETHER):
        rows = np.flatnonzero(single[chunk]) + chunk.start
        a, b = ids_a[starts[rows, 0]].astype(np.int64), ids_b[starts[rows, 1]]
        yield rows, a << ID_BITS | b, np.ones(len(rows), np.int64)
    plain = (sizes <= 8).all(1) & ~single
    for chunk in _chunks(np.where(plain, sizes.prod(1), 0), TOGETHER):
        rows = np.flatnonzero(plain[chunk]) + chunk.start
        n, m = sizes[rows].T
        group = np.repeat(rows, n * m)
        within = np.arange(len(group)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
        wide = np.repeat(m, n * m)
        a = ids_a[starts[group, 0] + within // wide].astype(np.int64)
        b = ids_b[starts[group, 1] + within % wide].astype(np.int64)
        yield group, a << ID_BITS | b, np.ones(len(group), np.int64)
    for row in np.flatnonzero(~plain & ~single).tolist():
        (i, j), (n, m) = starts[row], sizes[row]
        a, times_a = np.unique(ids_a[i : i + n], return_counts=True)
        b, times_b = np.unique(ids_b[j : j + m], return_counts=True)
        for part in _chunks(np.full(len(a), len(b)), TOGETHER):
            key = (a[part].astype(np.int64)[:, None] << ID_BITS | b).ravel()
            yield np.full(len(key), row), key, (times_a[part][:, None] * times_b).ravel()


def _chunks(weights: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive slices of about ``most`` in weight."""
    place = np.cumsum(weights) // most
    edges = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(weights)]
    return (slice(i, j) for i, j in zip(edges, edges[1:]) if i < j)


def _pairs(ids_a: list[np.ndarray], ids_b: list[np.ndarray], cuts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of ids linked in these documents, and how many documents hold each."""
    keys = []
    for run in _documents(cuts):
        joined, owner = _together(ids_a[run], ids_b[run], cuts[run])
        found = [np.unique(owner[group] << 2 * ID_BITS | key) for group, key, _ in links(*joined)]
        if found:
            both = np.unique(np.concatenate(found)) if len(found) > 1 else found[0]
            keys.append(both & ((1 << 2 * ID_BITS) - 1))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.unique(np.concatenate(keys), return_counts=True)


def _documents(cuts: list[np.ndarray]) -> Iterator[slice]:
    return _chunks(np.array([len(c) for c in cuts]), TOGETHER)


def _together(ids_a, ids_b, cuts) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """Documents as one: their ids, their cuts counted on, and the document of every cut."""
    shifts = np.cumsum([[0, 0], *([len(a), len(b)] for a, b in zip(ids_a, ids_b))], axis=0)
    moved = [c + s for c, s in zip(cuts, shifts)]
    owner = np.repeat(np.arange(len(cuts), dtype=np.int64), [len(c) for c in cuts])
    return (np.concatenate(ids_a), np.concatenate(ids_b), np.concatenate(moved)), owner


def tokenized(docs: DataFrame, path_a: str, path_b: str, pattern: str, id_col: str, text_col: str) -> DataFrame:
    """One pass: documents with ids and cuts (kind 0), and each block's distinct pairs (kind 1)."""
    rows = texts(docs, id_col, text_col)
    id_type = rows.schema[id_col].dataType.simpleString()
    names = ["kind", "block", id_col, "tokens", "pair", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int64(), None, pa.binary(), pa.int64(), pa.int64()]
        a, b = ByteTokenizer(path_a, pattern), PieceTokenizer(path_b)
        size_a, size_b = (np.array([len(x) for x in t.bytes]) for t in (a, b))
        if max(len(size_a), len(size_b)) > 1 << ID_BITS:
            raise ValueError("a vocabulary is too large")
        block, size = TaskContext.get().partitionId() << 24, 0
        pairs: list[tuple[np.ndarray, np.ndarray]] = []

        def out(n: int, given: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([given.get(c, pa.nulls(n, t)) for c, t in zip(names, types)], names=names)

        def close() -> pa.RecordBatch:
            keys, inverse = np.unique(np.concatenate([k for k, _ in pairs]), return_inverse=True)
            n = np.bincount(inverse, np.concatenate([n for _, n in pairs]), len(keys)).astype(np.int64)
            count = len(keys)
            return out(
                count,
                {
                    "kind": pa.array(np.ones(count, np.int32)),
                    "block": pa.array(np.full(count, block)),
                    "pair": pa.array(keys),
                    "n": pa.array(n),
                },
            )

        for part in rows_of(batches, BATCH_BYTES):
            types[2] = part.column(0).type
            words = part.column(1).to_pylist()
            ids_a = [np.array(i, np.int32) for i in a.encode(words)]
            ids_b = [np.array(i, np.int32) for i in b.encode(words)]
            for k, text in enumerate(words):
                whole = b" " + text.encode()
                # A's tokens stand for bytes one by one; only whole tokens can be missing.
                spelt = b"".join(map(b.bytes.__getitem__, ids_b[k].tolist()))
                if not text or spelt != whole or size_a[ids_a[k]].sum() != len(whole):
                    ids_a[k] = ids_b[k] = np.zeros(0, np.int32)
            cuts = merged(ids_a, ids_b, size_a, size_b)
            n = part.num_rows
            yield out(
                n,
                {
                    "kind": pa.array(np.zeros(n, np.int32)),
                    "block": pa.array(np.full(n, block)),
                    id_col: part.column(0),
                    "tokens": pa.array(map(packed, ids_a, ids_b, cuts), pa.binary()),
                },
            )
            pairs.append(_pairs(ids_a, ids_b, cuts))
            size += part.nbytes
            if size >= BLOCK_BYTES:
                yield close()
                block, size, pairs = block + 1, 0, []
        if pairs:
            yield close()

    return rows.mapInArrow(run, f"kind int, block bigint, `{id_col}` {id_type}, tokens binary, pair bigint, n bigint")


def packed(ids_a: np.ndarray, ids_b: np.ndarray, cuts: np.ndarray) -> bytes:
    """A document's ids and the sizes of its groups, each in as few bytes as the largest needs."""
    sizes = np.diff(cuts, axis=0, prepend=np.zeros((1, 2), cuts.dtype))
    arrays = [x.astype(np.min_scalar_type(x.max(initial=0))) for x in (ids_a, ids_b, sizes[:, 0], sizes[:, 1])]
    head = np.array([(len(x), x.itemsize) for x in arrays], np.int64)
    return zstandard.compress(head.tobytes() + b"".join(x.tobytes() for x in arrays), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = zstandard.decompress(data)
    head, at, arrays = np.frombuffer(data, np.int64, 8).reshape(4, 2), 64, []
    for n, width in head.tolist():
        arrays.append(np.frombuffer(data, f"u{width}", n, at).astype(np.int32))
        at += n * width
    ids_a, ids_b, *sizes = arrays
    return ids_a, ids_b, np.cumsum(np.stack(sizes, axis=1), axis=0, dtype=np.int32)


def counts(listed: DataFrame) -> DataFrame:
    """``pair``, its number of documents ``count``, and whether no pair of its A id has more."""
    summed = listed.groupBy("pair").agg(F.sum("n").alias("count"))
    summed = store(summed.withColumn("a", F.shiftright("pair", ID_BITS)), "align-counts")
    highest = summed.groupBy("a").agg(F.max("count").alias("highest"))
    return summed.join(highest, "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def align(
    docs: DataFrame,
    path_a: str,
    path_b: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row ``tokens``, both tokenizers' ids and the cuts in packed form, and what the corpus counts.

    :func:`expanded` spells ``tokens`` out. ``n_links``, ``n_best`` (links whose count is
    the highest of their A id) and ``count_sum`` (counts of all links) follow. Both paths
    must exist on every executor; ``pattern`` parts a text into words for tokenizer A.
    """
    rows = store(tokenized(docs, path_a, path_b, pattern, id_col, text_col), "align", ["kind"])
    id_type = rows.schema[id_col].dataType.simpleString()
    listed = rows.filter("kind = 1").select(F.col("block").alias("home"), "pair", "n")
    counted = store(counts(listed), "align-pairs")
    documents = rows.filter("kind = 0").select("block", id_col, "tokens")
    schema = f"`{id_col}` {id_type}, tokens binary, n_links bigint, n_best bigint, count_sum bigint"
    names = [id_col, "tokens", "n_links", "n_best", "count_sum"]

    def weighed(ids: pa.Array, tokens: pa.Array, known: tuple) -> list:
        return [ids, tokens, *map(pa.array, weigh(list(map(unpacked, tokens.to_pylist())), *known))]

    if counted.count() <= SENT:
        found = counted.orderBy("pair").toArrow()
        shared = share(docs, tuple(found[c].to_numpy() for c in ("pair", "count", "best")))

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared()
            for part in rows_of(batches, BATCH_BYTES):
                yield pa.RecordBatch.from_arrays(weighed(part.column(1), part.column(2), known), names=names)

        return documents.mapInArrow(each, schema)

    def together(docs: pa.Table, back: pa.Table) -> pa.Table:
        order = np.argsort(back["pair"].to_numpy())
        known = tuple(back[c].to_numpy(zero_copy_only=False)[order] for c in ("pair", "count", "best"))
        return pa.table(weighed(docs[id_col], docs["tokens"], known), names=names)

    back = listed.select("home", "pair").join(counted, "pair")
    return documents.groupBy("block").cogroup(back.groupBy("home")).applyInArrow(together, schema)


def weigh(documents: list[tuple], keys: np.ndarray, count: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Links, best links and sum of counts (rows) of documents; ``keys`` in order hold all their pairs."""
    totals = np.zeros((3, len(documents)), np.int64)
    a, b, cuts = map(list, zip(*documents)) if documents else ([], [], [])
    for run in _documents(cuts):
        joined, owner = _together(a[run], b[run], cuts[run])
        for group, key, times in links(*joined):
            at, of = np.searchsorted(keys, key), owner[group]
            for total, weight in zip(totals, (times, times * best[at], times * count[at])):
                # Exact: a chunk's sums stay far below 2**53.
                total[run] += np.bincount(of, weight, run.stop - run.start).astype(np.int64)
    return totals


def expanded(aligned: DataFrame) -> DataFrame:
    """``tokens`` spelt out: ``a_ids``, ``b_ids``, ``a_cuts`` and ``b_cuts``, the tokens of each up to every group's end."""
    others = [c for c in aligned.columns if c != "tokens"]
    names = [*others, "a_ids", "b_ids", "a_cuts", "b_cuts"]
    kinds = [f"`{c}` {aligned.schema[c].dataType.simpleString()}" for c in others]

    def listed(arrays: list[np.ndarray]) -> pa.Array:
        ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *arrays])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches, BATCH_BYTES):
            found = list(map(unpacked, part.column("tokens").to_pylist()))
            lists = [[a for a, _, _ in found], [b for _, b, _ in found], *([c[:, k] for _, _, c in found] for k in (0, 1))]
            yield pa.RecordBatch.from_arrays([*map(part.column, others), *map(listed, lists)], names=names)

    return aligned.mapInArrow(run, ", ".join([*kinds, *(f"{c} array<int>" for c in names[-4:])]))


def digests(aligned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row the numbers of tokens, groups and links, and a hash of the groups as text."""
    id_type = aligned.schema[id_col].dataType.simpleString()
    numbers = ["n_links", "n_best", "count_sum"]
    names = [id_col, "n_a", "n_b", "n_groups", *numbers, "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell: list[str] = []
        for part in rows_of(batches, BATCH_BYTES):
            found = list(map(unpacked, part.column("tokens").to_pylist()))
            size = 1 + max((int(x.max()) for a, b, _ in found for x in (a, b) if len(x)), default=0)
            if 3 * size > len(spell):
                spell = [f"{i}{mark}" for mark in ",|;" for i in range(2 * size)]
            written = [groups_text(a, b, cuts[:, 0], cuts[:, 1], spell) for a, b, cuts in found]
            hashes = [hashlib.sha256(w.encode()).hexdigest() if w else "" for w in written]
            sizes = [pa.array([len(each[k]) for each in found], pa.int64()) for k in range(3)]
            columns = [part.column(id_col), *sizes, *(part.column(c) for c in numbers), pa.array(hashes, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"`{id_col}` {id_type}, " + ", ".join(f"{c} bigint" for c in names[1:-1]) + ", groups_sha256 string"
    return aligned.mapInArrow(run, schema)


def groups_text(a: np.ndarray, b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray, spell: list[str]) -> str:
    """``a1,a2|b1;a3|b2,b3``: ids of each group. ``spell`` has every id with each of the marks ``,|;``."""
    if not len(a):
        return ""
    size = len(spell) // 3
    out = np.empty(len(a) + len(b), np.int64)
    codes_a, codes_b = a.astype(np.int64), b.astype(np.int64)
    codes_a[cuts_a - 1] += size
    codes_b[cuts_b - 1] += 2 * size
    # Before a token of A stand the tokens of B of earlier groups, and the other way round.
    group_a = np.repeat(np.arange(len(cuts_a)), np.diff(cuts_a, prepend=0))
    group_b = np.repeat(np.arange(len(cuts_b)), np.diff(cuts_b, prepend=0))
    out[np.arange(len(a)) + np.r_[0, cuts_b][group_a]] = codes_a
    out[np.arange(len(b)) + cuts_a[group_b]] = codes_b
    return "".join(map(spell.__getitem__, out.tolist()))[:-1]
