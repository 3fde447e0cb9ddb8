"""Personal data by bootstrapped contextual extraction.

Well-formed identifiers (``KINDS``) are the seeds. The words around a seed are its
lexical patterns. Every identifier-like string that is no seed is an instance too, and
Spark scores the graph of patterns and instances over a few rounds: a pattern is as
good as the share of its instances that are known or believed, an instance as good as
its best pattern. Strings in a pattern that scores ``CONFIDENT`` with ``SUPPORT`` seeds
or more are found as well.

Defined results: a null or empty text has no spans; extra columns are ignored; repeated
rows come out repeated, while the graph counts a string once per pattern however often
it occurs; an empty table gives an empty one. Positions are code points, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoscore.llm.common import rows_of, texts
from geoscore.sources.storage import store

KINDS = ("email", "ip", "card", "phone")
CONFIDENT = 0.8
#: Different seeds that a pattern needs before it may find anything.
SUPPORT = 8
ROUNDS = 2
BATCH_BYTES = 4 << 20

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The look-behind lets a match start at the first digit of a run alone, where the
# leftmost match always starts; without it a long run of digits takes quadratic time.
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NUMBER = re.compile(r"[0-9](?:[ ().-]{0,2}[0-9]){6,}")
DIGITS = re.compile(r"[0-9]")
NON_DIGITS = re.compile(r"[^0-9]+")

SPANS = "array<struct<kind:string,start:int,end:int>>"
SEEN = "array<struct<pattern:string,token:string,kind:string,seed:boolean,start:int,end:int>>"

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def seeds(text: str) -> list[Span]:
    """Well-formed identifiers, leftmost and non-overlapping within a kind."""
    found: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        before = text[free:at]
        local = len(before) - len(before.rstrip(LOCAL))
        match = DOMAIN.match(text, at) if local else None
        if match:
            found.append(("email", at - local, match.end()))
        free = match.end() if match else at + 1
        at = text.find("@", free)
    if DIGITS.search(text):
        for m in IP.finditer(text):
            values = [p.lstrip("0") for p in m.group().split(".")]
            if all(len(p) < 4 and int(p or 0) <= 255 for p in values):
                found.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            digits = NON_DIGITS.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(NON_DIGITS.sub("", m.group())) <= 15:
                    found.append(("phone", *m.span()))
    return found


def candidates(text: str, known: list[Span]) -> list[Span]:
    """Strings that look like an identifier of a kind and touch no seed."""
    taken = sorted((s, e) for _, s, e in known)
    found: list[Span] = []
    if DIGITS.search(text):
        for m in NUMBER.finditer(text):
            digits = len(NON_DIGITS.sub("", m.group()))
            if digits <= 15:
                found.append(("phone", *m.span()))
            elif digits <= 19:
                found.append(("card", *m.span()))
    at = text.find("@")
    while at >= 0:
        left = max(text.rfind(c, max(0, at - 64), at) for c in " \n\t") + 1
        left = max(left, at - 64, 0)
        right = min((p for p in (text.find(c, at, at + 64) for c in " \n\t") if p >= 0), default=min(len(text), at + 64))
        if left < at < right - 1:
            found.append(("email", left, right))
        at = text.find("@", max(right, at + 1))
    out, k = [], 0
    for kind, s, e in sorted(found, key=lambda x: x[1]):
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if k == len(taken) or taken[k][0] >= e:
            out.append((kind, s, e))
            taken.insert(k, (s, e))
    return out


def patterns(text: str, start: int, end: int) -> tuple[str, ...]:
    """The two words before a span, and the words on either side of it; brackets aside."""
    left = text[max(0, start - 60) : start].rstrip("([{<\"'+ ").lower().split()[-2:]
    right = text[end : end + 40].lstrip(")]}>\"'.,; ").lower().split()[:1]
    left = [DIGITS.sub("0", w) for w in left] or ["^"]
    right = [DIGITS.sub("0", w) for w in right] or ["$"]
    return " ".join(left) + " _", f"{left[-1]} _ {right[0]}"


def observe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_row``, ``id_col``, ``spans`` (the seeds) and ``seen`` (every instance in its patterns)."""
    rows = texts(docs, id_col, text_col)
    id_type = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches, BATCH_BYTES):
            spans, seen = [], []
            for text in part.column(1).to_pylist():
                known = seeds(text)
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e in known])
                rest = candidates(text, known)
                seen.append(
                    [
                        {"pattern": p, "token": text[s:e], "kind": k, "seed": seed, "start": s, "end": e}
                        for seed, group in ((True, known), (False, rest))
                        for k, s, e in group
                        for p in patterns(text, s, e)
                    ]
                )
            span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
            instance = pa.struct(
                [("pattern", pa.string()), ("token", pa.string()), ("kind", pa.string())]
                + [("seed", pa.bool_()), ("start", pa.int32()), ("end", pa.int32())]
            )
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(spans, pa.list_(span)), pa.array(seen, pa.list_(instance))],
                names=[part.schema.names[0], "spans", "seen"],
            )

    found = rows.mapInArrow(run, f"`{id_col}` {id_type}, spans {SPANS}, seen {SEEN}")
    # The table is stored before any other use, so these numbers stay as they are.
    return found.withColumn("_row", F.monotonically_increasing_id())


def _instances(observed: DataFrame) -> DataFrame:
    return observed.filter(F.size("seen") > 0).select("_row", F.inline("seen"))


def confident_patterns(observed: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, confidence, support) of patterns good enough to find identifiers."""
    edges = (
        _instances(observed)
        .groupBy("pattern", "token", "kind")
        .agg(F.max("seed").alias("seed"))
        .withColumn("belief", F.col("seed").cast("double"))
    )
    for k in range(rounds):
        edges = store(edges, f"pii-edges-{k}")
        scored = edges.join(_pattern_scores(edges), ["pattern", "kind"], "left")
        best = F.max(F.coalesce(F.col("confidence"), F.lit(0.0)))
        believed = scored.filter(~F.col("seed")).groupBy("token", "kind").agg(best.alias("_best"))
        edges = edges.join(believed, ["token", "kind"], "left").select(
            "pattern",
            "token",
            "kind",
            "seed",
            F.when(F.col("seed"), 1.0).otherwise(F.coalesce("_best", F.lit(0.0))).alias("belief"),
        )
    good = _pattern_scores(store(edges, "pii-edges-last"))
    return good.filter((F.col("confidence") >= CONFIDENT) & (F.col("support") >= SUPPORT))


def _pattern_scores(edges: DataFrame) -> DataFrame:
    """A pattern's confidence for a kind: belief in its instances over all of them, plus two."""
    sums = [F.sum(F.when(F.col("kind") == k, F.col("belief"))) for k in KINDS]
    counts = [F.sum(F.when((F.col("kind") == k) & F.col("seed"), 1)) for k in KINDS]
    per_kind = F.array(
        *(
            F.struct(
                F.lit(k).alias("kind"),
                F.coalesce(s / (F.count(F.lit(1)) + 2), F.lit(0.0)).alias("confidence"),
                F.coalesce(c, F.lit(0)).alias("support"),
            )
            for k, s, c in zip(KINDS, sums, counts)
        )
    )
    return edges.groupBy("pattern").agg(per_kind.alias("_k")).select("pattern", F.inline("_k"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``spans`` (the seeds) and ``found`` (what patterns add), one row per document."""
    observed = store(observe(docs, id_col, text_col), "pii-observed")
    good = confident_patterns(observed).select("pattern", "kind")
    more = (
        _instances(observed)
        .filter(~F.col("seed"))
        .join(good, ["pattern", "kind"])
        .groupBy("_row")
        .agg(F.collect_set(F.struct("kind", "start", "end")).alias("found"))
    )
    nothing = F.array().cast(SPANS)
    joined = observed.select("_row", id_col, "spans").join(more, "_row", "left")
    return joined.select(id_col, "spans", F.coalesce("found", nothing).alias("found"))


def _rank(kind: Column) -> Column:
    """A kind's place in the list."""
    rank = F.lit(len(KINDS))
    for k, name in enumerate(KINDS):
        rank = F.when(kind == name, k).otherwise(rank)
    return rank


def ordered(spans: Column) -> Column:
    """Spans by start, then by kind as listed."""
    keyed = F.transform(
        spans,
        lambda x: F.struct(
            x["start"].alias("start"),
            _rank(x["kind"]).alias("rank"),
            x["end"].alias("end"),
            x["kind"].alias("kind"),
        ),
    )
    return F.array_sort(keyed)


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint")

    return found.select(
        id_col,
        *(count(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(written(ordered(F.col("spans"))).cast("binary"), 256).alias("base_sha256"),
        written(ordered(F.concat("spans", "found"))).alias("spans"),
    )


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets, and spans joined if they touch.

    Rows are matched by id and by a hash of the text, so repeated ids keep their own spans.
    """
    key = lambda: F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(text_col, F.lit("")))
    keyed = docs.withColumn("_key", key())
    found = find(keyed.select("_key", F.col(text_col).alias("text")), "_key", "text")
    spans = found.select("_key", F.concat("spans", "found").alias("_spans"))
    spans = spans.filter(F.size("_spans") > 0).dropDuplicates(["_key"])
    joined = keyed.join(spans, "_key", "left")
    columns = docs.columns
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches, BATCH_BYTES):
            text = part.column(columns.index(text_col)).to_pylist()
            for i, spans_ in enumerate(part.column(len(columns)).to_pylist()):
                if spans_:
                    text[i] = replaced(text[i], [(s["kind"], s["start"], s["end"]) for s in spans_])
            arrays = [part.column(c) for c in range(len(columns))]
            arrays[columns.index(text_col)] = pa.array(text, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return joined.select(*columns, "_spans").mapInArrow(run, schema)


def replaced(text: str, spans: list[Span]) -> str:
    """Text with spans masked; overlapping ones become one mask of the first kind."""
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]))):
        if start >= done:
            out += [text[done:start], f"<{kind}>"]
        done = max(done, end)
    return "".join(out) + text[done:]
