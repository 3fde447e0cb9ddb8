"""Language identification by a string kernel with Nyström landmarks.

A text is its set of n-grams of ``LENGTHS`` bytes, blended over all lengths, after A-Z are
lower-cased and everything that is no letter became one space; n-grams are counted as
present or not, by a hash into ``BUCKETS``. The kernel of two texts is the number of
n-grams both have over the root of the product of their numbers. ``landmarks`` training
texts stand for all: with their kernel matrix K = U diag(s) U', a text is described by
its kernels with them times U diag(s)**-1/2, and one ridge regression per language, fitted
on those descriptions, says +1 or -1. Scoring multiplies a batch's presence matrix by the
landmarks', and the kernels by the weights of all languages.

Training reads a bounded sample: at most ``Settings.per_language`` texts of each language,
those with the smallest hashes, found without bringing a language to one task: the share
of its rows that is looked at follows from their number. More than ``MOST`` languages are
refused, so numbers and weights per language have a proven bound. Texts never leave the executors:
landmarks come to the driver as bits and the sample as sums of ``landmarks`` squared.

The score is the language's share in a softmax of ``Settings.sharpness`` times all values.

Defined results: a null text or one without a letter is ``und`` with score 0, and so is
every text if nothing was learned; one learned language has score 1; ties go to the
language first in order; null languages teach nothing; rows without an id count by the
remainder of the empty text; extra columns are ignored; repeated rows come out repeated;
an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoscore.llm.common import crc_remainder, raw, rows_of, share
from geoscore.sources.storage import store

LENGTHS = (1, 2, 3, 4)
BUCKETS = 1 << 14
BATCH_BYTES = 1 << 20
#: Texts in one product.
TOGETHER = 256
UNKNOWN = "und"
#: Languages that can be told apart; more fail.
MOST = 4096
#: A-Z to a-z; bytes of letters beyond ASCII as they are; all else to a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Settings:
    #: Texts of each language that training reads at most.
    per_language: int = 512
    #: Texts that stand for all, dealt evenly over the languages.
    landmarks: int = 192
    #: Tasks that sum the sample.
    tasks: int = 16
    ridge: float = 1e-2
    sharpness: float = 6.0


@dataclass
class Model:
    langs: list[str]
    #: Presence of each bucket in each landmark, and one over the root of each one's number.
    base: np.ndarray
    scale: np.ndarray
    #: From kernels with the landmarks to a value per language; the last row is added to all.
    weights: np.ndarray
    sharpness: float


def presence(texts_: list[bytes]) -> np.ndarray:
    """A row per text: which buckets its n-grams fall into."""
    out = np.zeros((len(texts_), BUCKETS), bool)
    folded = [b" ".join([b"", *t.translate(FOLD).split(), b""]) for t in texts_]
    # Spaces part the texts; n-grams that reach into the next text are left out.
    data = np.frombuffer(b"".join(folded), np.uint8)
    sizes = np.array([len(t) for t in folded])
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts_), dtype=np.int64), sizes)
    left = np.repeat(ends, sizes) - np.arange(len(data))
    code = np.zeros(len(data), np.uint32)
    flat = out.reshape(-1)
    for n in range(1, max(LENGTHS) + 1):
        code[: max(len(data) - n + 1, 0)] |= data[n - 1 :].astype(np.uint32) << np.uint32(8 * (n - 1))
        if n not in LENGTHS:
            continue
        whole = left >= n
        x = code[whole] * np.uint32(0x9E3779B1) ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
        x = (x ^ x >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
        flat[owner[whole] * BUCKETS + (x >> np.uint32(32 - BUCKETS.bit_length() + 1))] = True
    return out


def kernels(texts_: list[bytes], base: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Kernels of texts (rows) with the landmarks; zeros for a text without n-grams."""
    rows = presence(texts_)
    size = np.maximum(rows.sum(1), 1)
    return (rows.astype(np.float32) @ base) * scale / np.sqrt(size)[:, None]


def _sample(rows: DataFrame, per_language: int) -> DataFrame:
    """``lang``, ``text``, ``h`` and ``rank`` of at most so many texts of each language."""
    hashed = rows.select("lang", "text", F.xxhash64("id", "text").alias("h"))
    counts = hashed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    known = counts.limit(MOST + 1).collect()
    if len(known) > MOST:
        raise ValueError(f"more than {MOST} languages")
    counts = rows.sparkSession.createDataFrame([(r["lang"], r["n"]) for r in known], "lang string, n bigint")
    # Twice the number wanted falls below this share of the hashes, or all do.
    place = F.pmod(F.col("h"), F.lit(1 << 30)) / float(1 << 30)
    few = hashed.join(F.broadcast(counts), "lang").filter(place * F.col("n") < 2.0 * per_language)
    few = few.dropDuplicates(["lang", "h"])  # rows that repeat id and text
    by_hash = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h", "text")
    rank = F.row_number().over(by_hash).alias("rank")
    return few.select("lang", "text", "h", rank).filter(F.col("rank") <= per_language)


def fit(
    docs: DataFrame,
    settings: Settings = Settings(),
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> Model:
    """Learns from the texts of rows whose language is not null and whose text has a letter."""
    s = settings
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    rows = rows.filter(F.col("lang").isNotNull() & has_letter("text"))
    sample = store(_sample(rows, s.per_language), "language-sample")
    langs = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    marks = sample.orderBy("rank", "lang").limit(s.landmarks)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            packed = np.packbits(presence(raw(part.column(0))), axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([p.tobytes() for p in packed], pa.binary()), part.column(1), part.column(2)],
                names=["bits", "rank", "lang"],
            )

    # A fixed number of bits for each of a fixed number of landmarks.
    found = marks.select("text", "rank", "lang").mapInArrow(bits, "bits binary, rank int, lang string")
    kept = sorted(found.collect(), key=lambda r: (r["rank"], r["lang"]))
    if not kept:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), np.zeros((1, 0)), s.sharpness)
    base = np.stack([np.unpackbits(np.frombuffer(r["bits"], np.uint8)) for r in kept], axis=1).astype(np.float32)
    scale = (1 / np.sqrt(np.maximum(base.sum(0), 1))).astype(np.float32)
    own = (base.T @ base * scale * scale[:, None]).astype(np.float64)
    values, vectors = np.linalg.eigh(own)
    good = values > values.max() * 1e-6  # equal landmarks add no direction
    mapped = vectors[:, good] / np.sqrt(values[good])
    width = mapped.shape[1] + 1

    shared = share(docs, (base, scale, mapped, langs))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, scale, mapped, langs = shared()
        number = {lang: k for k, lang in enumerate(langs)}
        gram, cross = np.zeros((width, width)), np.zeros((width, len(langs)))
        for part in batches:
            x = kernels(raw(part.column(0)), base, scale) @ mapped
            x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
            y = np.full((len(x), len(langs)), -1.0)
            y[np.arange(len(x)), [number[lang] for lang in part.column(1).to_pylist()]] = 1.0
            gram += x.T @ x
            cross += x.T @ y
        both = np.concatenate([gram, cross], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array([both.tobytes()], pa.binary())], names=["sums"])

    dealt = sample.repartition(s.tasks, "h").sortWithinPartitions("h", "lang", "text").select("text", "lang")
    total = np.zeros((width, width + len(langs)))
    for row in dealt.mapInArrow(sums, "sums binary").collect():  # one row per task
        total += np.frombuffer(row["sums"]).reshape(total.shape)
    gram, cross = total[:, :width], total[:, width:]
    penalty = np.eye(width) * s.ridge * max(gram[-1, -1], 1)
    penalty[-1, -1] = 0
    ridge = np.linalg.solve(gram + penalty + 1e-9 * np.eye(width), cross)
    weights = np.concatenate([mapped @ ridge[:-1], ridge[-1:]])
    return Model(langs, base, scale, weights, s.sharpness)


def has_letter(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred`` and ``score``, from the text alone."""
    rows = docs.select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("text"), has_letter(text_col).alias("told"))
    id_type = rows.schema[id_col].dataType.simpleString()
    shared = share(docs, model)  # landmarks and weights, both of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        names = [*model.langs, UNKNOWN]
        for part in rows_of(batches, BATCH_BYTES):
            n = part.num_rows
            texts_, told = raw(part.column(1)), part.column(2).to_numpy(zero_copy_only=False)
            best, score = np.full(n, len(model.langs)), np.zeros(n)
            for start in range(0, n if model.langs else 0, TOGETHER):
                now = slice(start, start + TOGETHER)
                values = kernels(texts_[now], model.base, model.scale) @ model.weights[:-1] + model.weights[-1]
                best[now] = values.argmax(1)
                odds = np.exp(model.sharpness * (values - values.max(1, keepdims=True)))
                score[now] = 1 / odds.sum(1)
            best[~told], score[~told] = len(model.langs), 0.0
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([names[b] for b in best], pa.string()), pa.array(score)],
                names=[part.schema.names[0], "lang_pred", "score"],
            )

    return rows.mapInArrow(run, f"`{id_col}` {id_type}, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    return crc_remainder(id_col, 3) == 1


def predictions(predicted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return predicted.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
