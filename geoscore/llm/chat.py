"""Chat formatting by incremental black-box rendering.

A template is any function from turns to text. It is asked for every prefix of a
conversation; what one more turn adds is that turn's span, and a template whose next
output doesn't begin with the one before rewrites history and is reported. Where a turn's
own text lies in its span is found by probes: two renderings that differ in one character
of that text differ at its place alone.

``brackets`` is the built-in template. It marks turns by role and escapes ``\\``, ``[`` and
``<`` in roles and texts, so no text can hold a control string, and ``read_back`` recovers
every turn.

Defined results: a null role or text is empty; rows of a conversation are ordered by turn,
then role, then text, and repeated rows are repeated turns; null ids form one
conversation; extra columns are ignored; an empty table gives an empty one. Time grows
with the square of the turns in a conversation, which each prefix rendering costs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoscore.llm.common import rows_of

Turn = tuple[str, str]
Template = Callable[[Sequence[Turn]], str]

START = "<s>"
SPECIAL = re.compile(r"([\\\[<])")
ESCAPED = re.compile(r"\\(.)", re.S)
#: An unescaped mark: nothing, or an even number of backslashes, stands before it.
PIECE = r"((?:[^\\\[<]|\\.)*)"
TURNS = re.compile(
    rf"\[INST\] {PIECE} \[/INST\]|\[TURN\] {PIECE}</s>|\[ROLE {PIECE}\[:\] {PIECE}\[/ROLE\]", re.S
)
#: Characters no template treats specially, to find a text's place.
PROBES = ("a", "b")


def escape(text: str) -> str:
    return SPECIAL.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def brackets(turns: Sequence[Turn]) -> str:
    """The built-in template."""
    out = [START]
    for role, text in turns:
        body = escape(text)
        if role == "user":
            out.append(f"[INST] {body} [/INST]")
        elif role == "assistant":
            out.append(f"[TURN] {body}</s>")
        else:
            out.append(f"[ROLE {escape(role)}[:] {body}[/ROLE]")
    return "".join(out)


def read_back(formatted: str) -> list[Turn]:
    """The turns of the built-in template's output."""
    turns, at = [], len(START)
    while at < len(formatted):
        match = TURNS.match(formatted, at)
        user, assistant, role, text = match.groups()
        if user is not None:
            turns.append(("user", unescape(user)))
        elif assistant is not None:
            turns.append(("assistant", unescape(assistant)))
        else:
            turns.append((unescape(role), unescape(text)))
        at = match.end()
    return turns


@dataclass
class Rendered:
    text: str
    #: Each turn's span and, within it, its own text.
    spans: list[tuple[int, int]]
    bodies: list[tuple[int, int]]
    #: Turns at which the template changed what it had given before.
    rewrites: list[int]


def render(turns: Sequence[Turn], template: Template = brackets) -> Rendered:
    """Renders prefix by prefix and locates every turn."""
    before = template(())
    spans, bodies, rewrites = [], [], []
    for k in range(len(turns)):
        now = template(turns[: k + 1])
        begin = len(before)
        if not now.startswith(before):
            rewrites.append(k)
            begin = len(commonprefix([before, now]))
            spans = [(min(a, begin), min(b, begin)) for a, b in spans]
        role = turns[k][0]
        one, two = (template([*turns[:k], (role, p)]) for p in PROBES)
        start = len(commonprefix([one, two]))
        tail = len(one) - start - 1
        spans.append((begin, len(now)))
        bodies.append((start, len(now) - tail))
        before = now
    return Rendered(before, spans, bodies, rewrites)


FORMATTED = (
    "n_turns bigint, formatted string, spans array<struct<start:int,end:int>>, "
    "loss array<struct<start:int,end:int>>, rewrites array<int>"
)


def format_conversations(
    turns: DataFrame,
    template: Template = brackets,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Per conversation its text, each turn's span, the loss mask and rewritten turns.

    The loss mask has the place of each assistant text, one entry each.
    """
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    grouped = turns.groupBy(F.col(id_col)).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    id_type = grouped.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches):
            out: list[list] = [[], [], [], [], []]
            for each in part.column(1).to_pylist():
                given = [(t["role"], t["text"]) for t in each]
                r = render(given, template)
                loss = [b for (role, _), b in zip(given, r.bodies) if role == "assistant"]
                marks = [[{"start": a, "end": b} for a, b in s] for s in (r.spans, loss)]
                for column, value in zip(out, (len(given), r.text, *marks, r.rewrites)):
                    column.append(value)
            types = (pa.int64(), pa.string(), span, span, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(c, t) for c, t in zip(out, types))],
                names=[part.schema.names[0], "n_turns", "formatted", "spans", "loss", "rewrites"],
            )

    return grouped.mapInArrow(run, f"`{id_col}` {id_type}, {FORMATTED}")


def digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Read back from the built-in template's output: turns, and text under the loss mask."""
    id_type = formatted.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches):
            out: list[list] = [[], [], [], [], []]
            for text, loss in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                turns = read_back(text)
                all_turns = "".join(f"{role}\n{body}\n" for role, body in turns)
                under = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
                row = (
                    len(turns),
                    hashlib.sha256(all_turns.encode()).hexdigest(),
                    len(under),
                    hashlib.sha256(under.encode()).hexdigest(),
                    len(text),
                )
                for column, value in zip(out, row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *map(pa.array, out)],
                names=[part.schema.names[0], "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    schema = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return formatted.select(id_col, "formatted", "loss").mapInArrow(run, f"`{id_col}` {id_type}, {schema}")
