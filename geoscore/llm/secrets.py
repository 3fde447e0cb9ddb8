"""Secret scans over a trigram inverted index, on DataFrame functions alone.

From each rule's regular expression follows a Boolean query: every match holds, in lower
case, all trigrams of one of its alternatives. The index posts, for each trigram that any
rule asks for, the documents holding it. Intersecting a rule's postings leaves its
candidates, and only they are searched with the expression itself. A rule without
mandatory trigrams searches every document.

Defined results: a null or empty text has no spans; extra columns are ignored; repeated
rows come out repeated; an empty table gives an empty one. Positions are code points, end
exclusive. A document is posted under a hash of its id and text: should two share it, each
is a candidate wherever the other is, and the expression still decides.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoscore.llm.common import texts

#: Alternatives kept apart while a regular expression is turned into trigrams.
MOST_ALTERNATIVES = 64
SPANS = "array<struct<kind:string,start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, and the least length of the match or of a group."""

    kind: str
    regex: str
    least: int = 0
    group: int = 0


RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        12,
        2,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    # All of a run that has 16 characters, which is what [0-9a-f]+ finds and then keeps.
    Rule("hex", r"[0-9a-f]{16,}", 16),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")


def trigram_query(regex: str) -> list[frozenset[str]]:
    """Alternatives, each a set of lower-case trigrams that a match must hold together.

    An empty list: no trigram is mandatory.
    """
    runs: list[set[str]] = []
    _literals(re._parser.parse(regex), runs)  # noqa: SLF001
    queries = []
    for run in runs:
        grams = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run]
        if grams and all(grams):
            queries.append(list(dict.fromkeys(grams)))
    whole = [frozenset()]
    for query in sorted(queries, key=len):
        if len(whole) * len(query) <= MOST_ALTERNATIVES:
            whole = list(dict.fromkeys(a | b for a, b in product(whole, query)))
    whole = [a for a in whole if not any(b < a for b in whole)]
    return sorted(whole, key=sorted) if all(whole) else []


def _literals(parsed, runs: list[set[str]]) -> None:
    """Splits an expression into runs of literal text, each the set of strings it may be.

    A run ends at whatever isn't a small set of strings; leaving something out of a run
    makes the query weaker, never wrong.
    """
    run = {""}

    def close() -> None:
        nonlocal run
        runs.append(run)
        run = {""}

    for op, value in parsed:
        strings = _strings(op, value)
        if strings is None:
            close()
            if str(op) == "SUBPATTERN":
                _literals(value[3], runs)
            elif str(op) in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0:
                _literals(value[2], runs)
        elif len(run) * len(strings) > MOST_ALTERNATIVES:
            close()
            run = strings
        else:
            run = {a + b for a, b in product(run, strings)}
    close()


def _strings(op, value) -> set[str] | None:
    """The strings that one node can be in lower case, if they are few."""
    name = str(op)
    if name == "LITERAL":
        return {chr(value).lower()}
    if name == "IN":
        found: set[str] = set()
        for kind, what in value:
            if str(kind) == "LITERAL":
                found.add(chr(what).lower())
            elif str(kind) == "RANGE":
                found |= {chr(c).lower() for c in range(what[0], what[1] + 1)}
            else:
                return None
        return found if len(found) <= 8 else None
    if name == "SUBPATTERN":
        return _sequence(value[3])
    if name == "BRANCH":
        parts = [_sequence(b) for b in value[1]]
        return None if None in parts else set().union(*parts)
    if name in ("MAX_REPEAT", "MIN_REPEAT"):
        low, high, body = value
        inner = _sequence(body) if int(high) <= 8 else None
        if inner is None:
            return None
        repeated = {"".join(p) for n in range(low, int(high) + 1) for p in product(inner, repeat=n)}
        return repeated if len(repeated) <= MOST_ALTERNATIVES else None
    return None


def _sequence(parsed) -> set[str] | None:
    run = {""}
    for op, value in parsed:
        strings = _strings(op, value)
        if strings is None or len(run) * len(strings) > MOST_ALTERNATIVES:
            return None
        run = {a + b for a, b in product(run, strings)}
    return run


def postings(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The index: (trigram, ``_key``) for every trigram that a rule asks for.

    One pass over a text finds them all, overlapping ones too: the pattern looks ahead from
    every place and takes up none of the text.
    """
    wanted = sorted({t for r in rules for a in trigram_query(r.regex) for t in a})
    if not wanted:
        return rows.select("_key", F.lit("").alias("trigram")).limit(0)
    by_first: dict[str, list[str]] = {}
    for t in wanted:
        by_first.setdefault(re.escape(t[0]), []).append(re.escape(t[1:]))
    looked = "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in by_first.items())
    held = F.regexp_extract_all(F.lower("text"), F.lit(f"(?=({looked}))"), F.lit(1))
    return rows.select("_key", F.explode(F.array_distinct(held)).alias("trigram"))


def candidates(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(``_key``, ``kinds``): the rules whose query a document's trigrams satisfy."""
    spark = rows.sparkSession
    terms = [
        (t, r.kind, k, len(a))
        for r in rules
        for k, a in enumerate(trigram_query(r.regex))
        for t in sorted(a)
    ]
    asked = spark.createDataFrame(terms, "trigram string, kind string, alternative int, size int")
    return (
        postings(rows, rules)
        .join(F.broadcast(asked), "trigram")  # a row per rule and trigram
        .groupBy("_key", "kind", "alternative", "size")
        .count()
        .filter(F.col("count") >= F.col("size"))
        .groupBy("_key")
        .agg(F.collect_set("kind").alias("kinds"))
    )


def matches(text: Column, rule: Rule) -> Column:
    """A rule's spans in a text, leftmost and non-overlapping.

    Each match is taken together with the text before it, so lengths add up to positions;
    ``\\G`` ties it to the end of the one before.
    """
    whole = rf"(?s)\G(.*?)({rule.regex})"
    groups = [F.regexp_extract_all(text, F.lit(whole), F.lit(g)) for g in (1, 2)]
    kept = groups[1] if not rule.group else F.regexp_extract_all(text, F.lit(whole), F.lit(2 + rule.group))
    steps = F.arrays_zip(groups[0].alias("gap"), groups[1].alias("hit"), kept.alias("kept"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def add(done: Column, step: Column) -> Column:
        begin = done["at"] + F.char_length(step["gap"])
        end = begin + F.char_length(step["hit"])
        span = F.struct(F.lit(rule.kind).alias("kind"), begin.alias("start"), end.alias("end"))
        one = F.array(span).cast(SPANS)
        good = F.char_length(step["kept"]) >= rule.least
        out = F.when(good, F.concat(done["out"], one)).otherwise(done["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    return F.aggregate(steps, start, add, lambda done: done["out"])


def scan(
    docs: DataFrame,
    rules: Sequence[Rule] = RULES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id_col`` and ``spans``: every rule's matches in every document."""
    rows = texts(docs, id_col, text_col)
    rows = rows.withColumn("_key", F.xxhash64(id_col, "text"))
    indexed = [r for r in rules if trigram_query(r.regex)]
    joined = rows.join(candidates(rows, indexed), "_key", "left")
    nothing = F.array().cast(SPANS)
    found = []
    for rule in rules:
        chosen = F.array_contains("kinds", rule.kind) if rule in indexed else F.col("text").rlike(rule.regex)
        found.append(F.when(chosen, matches(F.col("text"), rule)).otherwise(nothing))
    return joined.select(id_col, F.concat(*found).alias("spans"))


def ordered(spans: Column, kinds: Sequence[str]) -> Column:
    """Spans by start, then by kind as listed."""

    def rank(kind: Column) -> Column:
        out = F.lit(len(kinds))
        for k, name in enumerate(kinds):
            out = F.when(kind == name, k).otherwise(out)
        return out

    return F.array_sort(
        F.transform(
            spans,
            lambda x: F.struct(
                x["start"].alias("start"), rank(x["kind"]).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")
            ),
        )
    )


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digests(scanned: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id") -> DataFrame:
    """Counts and a hash of the base kinds' spans, and all spans written out."""

    def count(kind: str) -> Column:
        return F.size(F.filter("sorted", lambda x: x["kind"] == kind)).cast("bigint")

    base = F.filter("sorted", lambda x: x["kind"].isin(*BASE))
    return scanned.select(id_col, ordered(F.col("spans"), [r.kind for r in rules]).alias("sorted")).select(
        id_col,
        *(count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(F.col("sorted")).alias("spans"),
    )
