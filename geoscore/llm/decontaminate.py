"""Benchmark decontamination by SimHash over item-sized windows, on DataFrame functions alone.

A document window of an item's length whose shingles are at least ``SIMILAR`` like the
item's is a leak. Such a window shares at least that part of the item's shingles, so the
shingles of both are joined first and tell where windows can start: at a shared shingle, or
in line with one. A window with too few shared shingles for the similarity, wherever in the
item they are, is ruled out. Each window left gets a SimHash fingerprint and meets the items of its length
through a multi-index over ``BLOCKS`` blocks of the fingerprint: if two fingerprints
differ in at most ``RADIUS`` bits, one of their blocks differs in at most
``RADIUS // BLOCKS``, and items are listed under all block values that near. What comes
within the radius is verified exactly: the shingles, weighted by how often they occur, sum
of minima over sum of maxima.

Words are runs of letters and digits in lower case; a shingle is five of them, or all of a
shorter item. Defined results: a null or empty text or item matches nothing; repeated
documents and items give one row per pair of ids; extra columns are ignored; an empty
table on either side gives an empty one.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoscore.llm.common import texts

SIMILAR = 0.8
SHINGLE = 5
BITS = 64
BLOCKS = 8
#: Fingerprints of windows at the limit differ in about 10 bits, give or take 3.
RADIUS = 23
#: The SQL that checks this asks for this part of an item's shingles in line with a window start.
IN_LINE = 0.2
#: Most item shingles that are sent to every executor (16 bytes each); beyond, they are shuffled.
SENT = 2_000_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(tokens: Column) -> Column:
    """Shingles as text, repeats included; a shorter sequence is one shingle, none is none."""
    n = F.size(tokens)
    starts = F.sequence(F.lit(1), F.greatest(n - (SHINGLE - 1), F.lit(1)))
    made = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(SHINGLE)), " "))
    return F.when(n > 0, made).otherwise(F.array().cast("array<string>"))


def fingerprint(grams: Column) -> Column:
    """SimHash: bit by bit, the majority of the shingles' hash bits."""
    hashes = F.transform(grams, lambda g: F.xxhash64(g))
    # Folding a one-element array makes the hashes once.
    return F.element_at(F.transform(F.array(hashes), _fold), 1)


def _fold(hashes: Column) -> Column:
    def votes(b: Column) -> Column:
        one = lambda h: F.call_function("shiftrightunsigned", h, b).bitwiseAND(F.lit(1)).cast("int")
        return F.aggregate(hashes, F.lit(0), lambda a, h: a + one(h) * 2 - 1)

    def put(f: Column, b: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), b)
        return f.bitwiseOR(F.when(votes(b) > 0, bit).otherwise(F.lit(0).cast("bigint")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("bigint"), put)


def blocks(print_: Column) -> Column:
    """(block, value) of each block of a fingerprint."""
    width = BITS // BLOCKS
    return F.array(
        *(
            F.struct(
                F.lit(k).alias("block"),
                F.shiftrightunsigned(print_, k * width).bitwiseAND(F.lit(2**width - 1)).cast("int").alias("value"),
            )
            for k in range(BLOCKS)
        )
    )


def near_values() -> list[int]:
    """What to flip in a block value to reach all values within its share of the radius."""
    width = BITS // BLOCKS
    flips = (c for r in range(RADIUS // BLOCKS + 1) for c in combinations(range(width), r))
    return [sum(1 << b for b in c) for c in flips]


def similarity(left: Column, right: Column) -> Column:
    """Shingles weighted by their number: sum of minima over sum of maxima."""

    def times(grams: Column, g: Column) -> Column:
        return F.size(F.filter(grams, lambda x: x == g))

    both = F.aggregate(
        F.array_distinct(left), F.lit(0), lambda a, g: a + F.least(times(left, g), times(right, g))
    )
    return both / (F.size(left) + F.size(right) - both)


def indexed_items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Items with their words, length, shingles and fingerprint."""
    rows = texts(items.dropDuplicates([id_col, text_col]), id_col, text_col)
    made = rows.select(F.col(id_col).alias("_item"), words(F.col("text")).alias("_words"))
    made = made.filter(F.size("_words") > 0)
    made = made.select("_item", "_words", F.size("_words").alias("_length"), shingles(F.col("_words")).alias("_grams"))
    return made.withColumn("_print", fingerprint(F.col("_grams")))


def hashes(tokens: Column, size: int) -> Column:
    """A hash of each run of ``size`` words."""
    starts = F.sequence(F.lit(0), F.size(tokens) - size)
    made = F.transform(starts, lambda i: F.xxhash64(*(F.get(tokens, i + k) for k in range(size))))
    return F.when(F.size(tokens) >= size, made).otherwise(F.array().cast("array<bigint>"))


def window_starts(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(``_row``, ``_windows``): where windows of which length may hold an item."""
    size = F.least(F.col("_length"), F.lit(SHINGLE))
    # Items shorter than a shingle are one shingle of their own length.
    sizes = [r["size"] for r in items.select(size.alias("size")).distinct().collect()]
    tokens = docs.select(F.col("_hash_key").alias("_row"), words(F.col("text")).alias("_words"))

    def listed(k: int) -> DataFrame:
        return items.filter(size == k).select(
            "_item",
            "_length",
            F.size("_grams").alias("_n"),
            F.posexplode(hashes(F.col("_words"), k)).alias("_j", "_hash"),
        )

    def seen(k: int) -> DataFrame:
        total = F.size("_words").alias("_total")
        return tokens.select("_row", total, F.posexplode(hashes(F.col("_words"), k)).alias("_i", "_hash"))

    last = F.greatest(F.col("_total") - F.col("_length"), F.lit(0))
    start = F.greatest(F.least(F.col("_i") - F.col("_j"), last), F.lit(0))
    met = None
    for k in sizes or [SHINGLE]:
        seeds = listed(k)
        if seeds.count() <= SENT:
            seeds = F.broadcast(seeds)
        part = seen(k).join(seeds, "_hash")
        met = part if met is None else met.unionByName(part)
    # Of two sets of n and m, similar ones share at least this: 0.8 / 1.8 of n + m.
    inside = F.greatest(F.least(F.col("_total"), F.col("_length")) - (SHINGLE - 1), F.lit(1))
    needed = (F.col("_n") + inside) * (SIMILAR / (1 + SIMILAR)) - 1e-6
    # A window that starts at no shared shingle loses none by moving on to the next.
    starts = F.array_union("_starts", F.transform("_hits", lambda i: F.least(i, last)))
    full = F.filter(
        starts, lambda s: F.size(F.filter("_hits", lambda i: (i >= s) & (i < s + inside))) >= needed
    )
    return (
        met.groupBy("_row", "_item", "_length", "_n", "_total")
        .agg(F.collect_set("_i").alias("_hits"), F.collect_set(start).alias("_starts"))
        .filter(F.size("_hits") >= needed)
        .select("_row", "_length", F.explode(full).alias("_start"))
        .groupBy("_row")
        .agg(F.collect_set(F.struct("_length", "_start")).alias("_windows"))
    )


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = texts(docs, id_col, text_col)
    return rows.withColumn("_hash_key", F.xxhash64(id_col, "text"))


def leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``id_col``, ``item_col``, the best ``similarity`` and the ``start`` word of that window."""
    rows = keyed(docs, id_col, text_col)
    index = indexed_items(items, item_col, item_text_col)
    where = window_starts(rows, index)
    tokens = words(F.col("text"))
    cut = F.transform(
        "_windows",
        lambda w: F.struct(
            w["_length"].alias("_length"),
            w["_start"].alias("_start"),
            F.slice("_words", w["_start"] + 1, w["_length"]).alias("_window"),
        ),
    )
    windows = (
        rows.join(where.withColumnRenamed("_row", "_hash_key"), "_hash_key")
        .select(id_col, "_windows", tokens.alias("_words"))
        .select(id_col, F.inline(cut))
        .select(id_col, "_length", "_start", shingles(F.col("_window")).alias("_seen"))
        .withColumn("_mark", fingerprint(F.col("_seen")))
    )
    flips = F.array(*map(F.lit, near_values()))
    listed = (
        index.select("_item", "_length", "_print", "_grams", F.inline(blocks(F.col("_print"))))
        .withColumn("_flip", F.explode(flips))
        .withColumn("value", F.col("value").bitwiseXOR(F.col("_flip")))
        .drop("_flip")
    )
    met = (
        windows.withColumn("_blocks", blocks(F.col("_mark")))
        .select(id_col, "_length", "_start", "_seen", "_mark", F.inline("_blocks"))
        .join(listed, ["_length", "block", "value"])
        .filter(F.bit_count(F.col("_mark").bitwiseXOR(F.col("_print"))) <= RADIUS)
        .dropDuplicates([id_col, "_item", "_length", "_start"])
        .withColumn("similarity", similarity(F.col("_seen"), F.col("_grams")))
        .filter(F.col("similarity") >= SIMILAR)
    )
    best = F.max(F.struct(F.col("similarity"), (-F.col("_start")).alias("_early")))
    return (
        met.groupBy(id_col, F.col("_item").alias(item_col))
        .agg(best.alias("_best"))
        .select(id_col, item_col, F.col("_best.similarity").alias("similarity"), (-F.col("_best._early")).alias("start"))
    )


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those that hold an item."""
    key = F.xxhash64(id_col, F.coalesce(F.col(text_col), F.lit("")))
    marked = docs.withColumn("_key", key)
    found = leaks(marked.select("_key", F.col(text_col).alias("text")), items, "_key", "text")
    return marked.join(found.select("_key").distinct(), "_key", "left_anti").select(*docs.columns)
