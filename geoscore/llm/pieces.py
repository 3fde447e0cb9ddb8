"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Each text is cut where no merge can cross: before white space, line ends, and a full
stop or comma after a letter. A cut piece is merged by a score-ordered agenda of
adjacent symbol pairs: the best pair is taken first, the leftmost on ties, and its new
neighbours join the agenda. Long pieces use a heap; the short ones of an Arrow batch
keep their agendas as rows of one matrix and merge in step. Characters outside the
vocabulary fall back to bytes. Pieces a task has met are remembered in a table of
bounded size, and every piece that is new to it is also given to the sentencepiece
library, a batch at a time; a difference fails the job.

Defined results: a null or empty text has the end id alone and decodes to the empty
text; extra columns are ignored; repeated rows come out repeated; an empty table gives
an empty one.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoscore.llm.common import rows_of, share, texts

SPACE = "▁"
#: Pieces remembered by one task before it starts afresh.
REMEMBERED = 500_000
#: Text bytes per batch.
BATCH_BYTES = 2 << 20
#: Pieces up to this length merge in step, longer ones with a heap.
IN_STEP = 24
#: A mark that no piece of the vocabulary has after a letter.
MARK = re.compile(r"(?<=[A-Za-zÀ-ÖØ-öø-ÿ])[.,]")
NO_PAIR = np.iinfo(np.int32).max
#: In place of an id: a character that no piece has.
UNKNOWN = -2
#: A run of spaces with what follows, or a line's first word.
RUNS = re.compile(r"▁+[^▁\n]*|\n[^▁\n]*")


class Vocabulary:
    """The merge table of a model file with the settings this operator covers."""

    def __init__(self, model_path: str) -> None:
        self.path = model_path
        model = self.library()
        size = model.get_piece_size()
        plain = [
            i
            for i in range(size)
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))
        ]
        self.text = [model.id_to_piece(i) for i in range(size)]
        self.rank = {self.text[i]: (-model.get_score(i), i) for i in plain}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.bytes)}
        self.end = model.eos_id()
        if not all(map(model.is_byte, self.bytes)) or self.end < 0:
            raise ValueError("the model needs byte fallback and an end id")
        if any(SPACE in p.lstrip(SPACE) or "\n" in p or MARK.search(p) for p in self.rank):
            raise ValueError("the model merges across white space or marks")
        order = {s: k for k, s in enumerate(sorted({s for s, _ in self.rank.values()}))}
        pairs = {}
        for piece, (score, i) in self.rank.items():
            for k in range(1, len(piece)):
                left, right = self.rank.get(piece[:k]), self.rank.get(piece[k:])
                if left and right:
                    pairs[left[1] << 16 | right[1]] = (order[score], i)
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_values = np.array([pairs[k] for k in sorted(pairs)], np.int32)

        self.spoken = [t.replace(SPACE, " ") for t in self.text]
        self.id_of = np.full(0x110000, UNKNOWN, np.int32)
        for piece, (_, i) in self.rank.items():
            if len(piece) == 1:
                self.id_of[ord(piece)] = i
        self.id_of[0] = -1  # the filling of short rows; a text with it merges with a heap

    def library(self) -> sentencepiece.SentencePieceProcessor:
        return sentencepiece.SentencePieceProcessor(model_file=self.path)

    def merge(self, piece: str) -> list[int]:
        """Ids of one piece by the agenda."""
        rank = self.rank
        symbols: list[str | None] = list(piece)
        n = len(symbols)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in rank:
                agenda.append((rank[pair][0], i, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            j = after[i] if symbols[i] is not None else n
            # Stale unless both halves still stand as they did.
            if j >= n or symbols[i] + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                longer = pair + symbols[k]
                if longer in rank:
                    heapq.heappush(agenda, (rank[longer][0], i, longer))
            h = before[i]
            if h >= 0:
                longer = symbols[h] + pair
                if longer in rank:
                    heapq.heappush(agenda, (rank[longer][0], h, longer))
        return self._ids(symbols)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge order and merged id of pairs; ``NO_PAIR`` where none."""
        keys = left.astype(np.int64) << 16 | right
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        found = (self.pair_keys[at] == keys) & (left >= 0) & (right >= 0)
        order = np.where(found, self.pair_values[at, 0], NO_PAIR)
        return order, self.pair_values[at, 1]

    def merge_in_step(self, pieces: list[str]) -> list[list[int]]:
        """Ids of pieces of like length: each step takes every piece's best pair."""
        width = max(map(len, pieces)) + 1
        points = np.array(pieces, f"U{width}").view(np.uint32).reshape(len(pieces), width)
        symbols = self.id_of[points]
        order, merged = self._pairs(symbols[:, :-1], symbols[:, 1:])
        live = np.arange(len(pieces))
        columns = np.arange(width)[None, :]
        while True:
            best = order[live].argmin(1)
            more = order[live, best] < NO_PAIR
            live, best = live[more], best[more]
            if not len(live):
                break
            new = merged[live, best]
            n = np.arange(len(live))
            source = np.minimum(columns + (columns > best[:, None]), width - 1)
            rows = symbols[live[:, None], source]
            rows[n, best] = new
            symbols[live] = rows
            source = np.minimum(source[:, :-1], width - 2)
            order[live], merged[live] = order[live[:, None], source], merged[live[:, None], source]
            for at in (best, np.maximum(best - 1, 0)):
                order[live, at], merged[live, at] = self._pairs(rows[n, at], rows[n, at + 1])
        odd = (symbols == UNKNOWN).any(1)
        ends = np.cumsum((symbols != -1).sum(1)).tolist()
        flat = symbols[symbols != -1].tolist()
        ids = [flat[a:b] for a, b in zip([0, *ends], ends)]
        for r in np.flatnonzero(odd):
            # Each unknown character stands where it stood in the piece: replay it as bytes.
            ids[r] = self.merge(pieces[r])
        return ids

    def _ids(self, symbols: list[str | None]) -> list[int]:
        ids = []
        for s in symbols:
            if s is None:
                continue
            known = self.rank.get(s)
            if known:
                ids.append(known[1])
            else:
                ids.extend(self.bytes[b] for b in s.encode())
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of ids, the space before the first word included."""
        if not any(i in self.byte_of for i in ids):
            return "".join([self.spoken[i] for i in ids])
        out, pending = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                pending.append(b)
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            out.append(self.spoken[i])
        if pending:
            out.append(pending.decode("utf-8", "replace"))
        return "".join(out)

    def check(self, found: dict[str, list[int]], library: sentencepiece.SentencePieceProcessor) -> None:
        """Holds pieces against the library, which puts a space before each.

        A piece's own first space is that space; before a line's first word it stands alone.
        """
        space = self.rank[SPACE][1]
        pieces = [p for p in found if p[0] == SPACE and len(p) > 1]
        lines = [p for p in found if p[0] == "\n"]
        theirs = library.encode([p[1:] for p in pieces] + lines, num_threads=1)
        ours = [found[p] for p in pieces] + [[space, *found[p]] for p in lines]
        if theirs != ours:
            at = next(i for i, (a, b) in enumerate(zip(theirs, ours)) if a != b)
            raise ValueError(f"{[*pieces, *lines][at]!r}: {ours[at]} here, {theirs[at]} in the library")


def cut(text: str) -> list[str]:
    """Pieces of a text: words with the spaces before them, and lines' first words.

    The first piece starts with the space that the model puts before a text. A word after
    exactly one space goes without it; ``piece_of`` puts it back.
    """
    if not text:
        return []
    plain = not (text[0] == " " or text[-1] == " " or "  " in text or " \n" in text)
    if plain and SPACE not in text and "\x00" not in text:
        return text.replace("\n", " \n").split(" ")
    return RUNS.findall(SPACE + text.replace(" ", SPACE))


def piece_of(key: str) -> str:
    return key if key and key[0] in "\n▁" else SPACE + key


def stems(piece: str) -> list[str]:
    """A piece cut once more, before marks that follow a letter."""
    if "." not in piece and "," not in piece:
        return [piece]
    starts = [0, *(m.start() for m in MARK.finditer(piece)), len(piece)]
    return [piece[a:b] for a, b in zip(starts, starts[1:])]


class Memory:
    """Ids (as bytes) and text of the pieces met; starts afresh beyond ``REMEMBERED``."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.library = vocabulary, vocabulary.library()
        self.ids: dict[str, bytes] = {}
        self.texts: dict[str, str] = {}
        self.stems: dict[str, list[int]] = {}

    def learn(self, keys: Iterable[str]) -> None:
        """Merges what is new, checks it against the library and remembers it."""
        for kept in (self.ids, self.texts) if len(self.ids) > REMEMBERED else ():
            kept.clear()
        if len(self.stems) > REMEMBERED:
            self.stems.clear()
        vocabulary, known = self.vocabulary, self.stems
        parts = {k: stems(piece_of(k)) for k in set(keys).difference(self.ids)}
        fresh = {s for each in parts.values() for s in each}.difference(known)
        by_length: dict[int, list[str]] = defaultdict(list)
        for piece in fresh:
            short = len(piece) <= IN_STEP and "\x00" not in piece
            by_length[-(-len(piece) // 4) if short else 0].append(piece)
        found = {p: vocabulary.merge(p) for p in by_length.pop(0, ())}
        for like in by_length.values():
            found.update(zip(like, vocabulary.merge_in_step(like)))
        vocabulary.check(found, self.library)
        known.update(found)
        for key, each in parts.items():
            ids = known[each[0]] if len(each) == 1 else [i for s in each for i in known[s]]
            self.ids[key] = array("i", ids).tobytes()
            self.texts[key] = vocabulary.decode(ids)


def encode_decode(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Adds ``ids`` array<int>, the end id last, and ``decoded``, the text read back from them.

    Returns ``id_col``, ``text``, ``ids`` and ``decoded``. ``model_path`` must exist on
    every executor.
    """
    rows = texts(docs, id_col, text_col)
    id_type = rows.schema[id_col].dataType.simpleString()
    # A vocabulary of fixed size.
    shared = share(docs, Vocabulary(model_path))
    return rows.mapInArrow(_encoder(shared), f"`{id_col}` {id_type}, ids array<int>, decoded string")


def _encoder(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared()
        memory = Memory(vocabulary)
        end = array("i", [vocabulary.end]).tobytes()
        for part in rows_of(batches, BATCH_BYTES):
            cuts = [cut(text) for text in part.column(1).to_pylist()]
            memory.learn(chain.from_iterable(cuts))
            ids = [b"".join(map(memory.ids.__getitem__, each)) + end for each in cuts]
            decoded = ["".join(map(memory.texts.__getitem__, each))[1:] for each in cuts]
            offsets = np.cumsum([0, *(len(i) // 4 for i in ids)], dtype=np.int32)
            flat = np.frombuffer(b"".join(ids), np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                    pa.array(decoded, pa.string()),
                ],
                names=[part.schema.names[0], "ids", "decoded"],
            )

    return run


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document the number of ids and hashes of the ids and of the decoded text."""
    joined: Column = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(
        id_col,
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
