"""Periodic runs of words, from a dictionary of basic factors.

Every stretch of 2**k words of a text gets a name, equal stretches equal names: a pair of
names one level below. At each level, successive occurrences of one name that lie at most
twice its length apart are looked at; where the same distance comes twice in a row they
form an arithmetic progression, whose distance is proposed as a period. The proposal is
extended to both sides by comparing names from the longest level down, so a run is found
in logarithmic time wherever it was proposed, and runs proposed more than once are one.

A run of period q and at least ``TIMES`` * q words is always proposed: at the level whose
length lies in [q, 2q) its first stretch comes again q and 2q words later, and no sooner,
since two periods of a stretch that long would have a common divisor as a period.

The texts of an Arrow batch are named together, each with words of its own, so nothing
crosses documents. Stretches that come once in their text have no name, and levels end
where no stretch comes twice. Memory is 4 bytes per word and level of a batch.

Defined results: a null or empty text, or white space alone, has no words, no runs and an
empty collapsed text; words are compared byte by byte, letter case included; extra columns
are ignored; repeated rows come out repeated; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoscore.llm.common import raw, rows_of, texts

#: A run has at least so many words, and so many times its period.
LEAST = 6
TIMES = 4
BATCH_BYTES = 1 << 20


class Factors:
    """Names of the stretches of 2**k words of a sequence; 0 for a stretch that comes once."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.size = len(symbols)
        self.levels: list[np.ndarray] = []
        #: Per level the named places by name, then place.
        self.groups: list[tuple[np.ndarray, np.ndarray]] = []
        keys, places = symbols, np.arange(self.size)
        while len(places):
            order = np.argsort(keys, kind="stable")
            keys, places = keys[order], places[order]
            same = keys[1:] == keys[:-1]
            more = np.zeros(len(keys), bool)
            more[1:] |= same
            more[:-1] |= same
            number = np.cumsum(np.r_[True, ~same])[more]
            places = places[more]
            names = np.zeros(self.size, np.int32)
            names[places] = number
            self.levels.append(names)
            self.groups.append((number, places))
            length = 1 << (len(self.levels) - 1)
            left = np.sort(places)
            left = left[left + length < self.size]
            right = names[left + length]
            left, right = left[right > 0], right[right > 0]
            keys, places = names[left].astype(np.int64) << 32 | right, left

    def after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from places ``a`` and ``b`` on are equal."""
        a, b = a.copy(), b.copy()
        start = a.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            names, length = self.levels[k], 1 << k
            # A level may have to be taken twice only at the top.
            while True:
                inside = b + length <= self.size
                x = names[np.where(inside, a, 0)]
                equal = inside & (x > 0) & (x == names[np.where(inside, b, 0)])
                if not equal.any():
                    break
                a[equal] += length
                b[equal] += length
                if k < len(self.levels) - 1:
                    break
        return a - start

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols up to places ``a`` and ``b`` (exclusive) are equal; ``a`` < ``b``."""
        a, b = a.copy(), b.copy()
        start = a.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            names, length = self.levels[k], 1 << k
            while True:
                inside = a >= length
                x = names[np.where(inside, a - length, 0)]
                equal = inside & (x > 0) & (x == names[np.where(inside, b - length, 0)])
                if not equal.any():
                    break
                a[equal] -= length
                b[equal] -= length
                if k < len(self.levels) - 1:
                    break
        return start - a


def proposals(factors: Factors) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of each stretch of neighbouring places in arithmetic progression."""
    found = []
    for k, (names, places) in enumerate(factors.groups):
        gap = np.where(names[1:] == names[:-1], places[1:] - places[:-1], 0)
        steady = (gap[:-1] == gap[1:]) & (gap[:-1] > 0) & (gap[:-1] <= 2 << k)
        at, period = places[:-2][steady], gap[:-1][steady]
        order = np.argsort(at)
        at, period = at[order], period[order]
        # Neighbours that propose one period are of one run.
        fresh = np.r_[True, (at[1:] != at[:-1] + 1) | (period[1:] != period[:-1])] if len(at) else []
        found.append((at[fresh], period[fresh]) if len(at) else (at, period))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def find_runs(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of every run, by start and period."""
    factors = Factors(symbols)
    at, period = proposals(factors)
    if not len(at):
        return at, at, at
    back = factors.before(at, at + period)
    length = back + factors.after(at, at + period) + period
    start = at - back
    good = length >= np.maximum(LEAST, TIMES * period)
    start, length, period = start[good], length[good], period[good]
    # A multiple of a run's period proposes the same stretch of words: the smallest stays.
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


class Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def collapsed(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by a space."""
    if len(start):
        edges = np.zeros(len(words) + 1, np.int64)
        np.add.at(edges, start + period, 1)
        np.add.at(edges, start + length, -1)
        kept = np.cumsum(edges[:-1]) == 0
        words = [w for w, k in zip(words, kept.tolist()) if k]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``id_col``, ``n_words``, ``runs`` (array of start, length, period) and ``collapsed``."""
    rows = texts(docs, id_col, text_col)
    id_type = rows.schema[id_col].dataType.simpleString()
    run_type = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches, BATCH_BYTES):
            split = [t.split() for t in raw(part.column(1))]
            sizes = np.array([len(w) for w in split], np.int64)
            ends = np.cumsum(sizes)
            numbers = Numbers()
            coded = np.fromiter((numbers[w] for each in split for w in each), np.int64, int(sizes.sum()))
            # Each document has words of its own.
            symbols = np.repeat(np.arange(len(split)), sizes) * max(len(numbers), 1) + coded
            start, length, period = find_runs(symbols)
            owner = np.searchsorted(ends, start, side="right")
            start = start - (ends - sizes)[owner]
            cuts = np.searchsorted(owner, np.arange(len(split) + 1))
            texts_ = [
                collapsed(w, start[a:b], length[a:b], period[a:b])
                for w, a, b in zip(split, cuts.tolist(), cuts[1:].tolist())
            ]
            flat = pa.StructArray.from_arrays(list(map(pa.array, (start, length, period))), fields=list(run_type))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(sizes),
                    pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), flat),
                    pa.array(texts_, pa.binary()).cast(pa.string()),
                ],
                names=[part.schema.names[0], "n_words", "runs", "collapsed"],
            )

    schema = (
        f"`{id_col}` {id_type}, n_words bigint, "
        "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    )
    return rows.mapInArrow(find, schema)


def planted(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text in which one document in ten repeats a stretch of its words to its end.

    With h the crc32 of the id, g = h div 10, n words, a = g mod n and
    p = 1 + (n - a) div (3 + g mod 8): word i >= a becomes word a + (i - a) mod p of the
    text if 10 divides h. A null id or text stays as it is.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))

    def repeat(words: Column) -> Column:
        n, g = F.size(words).cast("bigint"), F.floor(h / 10)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        each = F.transform(words, lambda w, i: F.get(words, place(i.cast("bigint")).cast("int")))
        return F.when(n > 0, F.array_join(each, " ")).otherwise(text)

    # One-element arrays name a value, so that it is worked out once.
    changed = F.element_at(F.transform(F.array(words), repeat), 1)
    return F.when(h % 10 == 0, changed).otherwise(F.col(text_col))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row the number of runs, the longest (ties: first, then shortest period) and hashes."""
    ranked = F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"]))
    best = F.array_max(ranked).alias("best")
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "")
    row = found.select(id_col, "runs", "collapsed", best).withColumn("period", -F.col("best.col3"))
    return row.select(
        id_col,
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("best.col2")).alias("start"),
        F.col("best.length").alias("length"),
        "period",
        F.floor(1000 * F.col("best.length") / F.col("period")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
