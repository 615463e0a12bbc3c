"""Chat formatting with a grammar round trip.

Template, a turn after a turn: ``### <Role>: <text>`` newline ``</turn>`` newline. The control
strings are ``### `` and ``</turn>``; in a text they are literal if one or more backslashes
stand right before them, of which the parser removes one. A turn is first rendered as it
is; where the parser does not give back the same turn, its conflicting content is
escaped, until it does.

The general result has a row a turn with its rendered text and, for assistant turns, the
span under the loss mask; a conversation's output is its rows' texts in order. Rows go by
turn (nulls first), then role and text, so repeated rows are repeated turns. Null role or
text is empty; null conv_ids are one conversation; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import map_texts

#: How the usual roles are written; others are percent-encoded behind "~".
ROLES = {"user": "User", "assistant": "Assistant", "system": "System"}
NAMES = {v: k for k, v in ROLES.items()}
OPEN, CLOSE = "### ", "</turn>"
_LITERAL = re.compile(r"(\\*)(### |</turn>)")
_ESCAPED = re.compile(r"\\(\\*(?:### |</turn>))")
_HEAD = re.compile(r"### ([A-Z][a-z]+|~[^:\s]*): ")
_CONTROL = re.compile(r"(?<!\\)(?:### |</turn>)")


def escape(text: str) -> str:
    return _LITERAL.sub(r"\\\1\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse(rendered: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, start, end) of the turns; start and end hold the text as rendered.
    None if the grammar does not fit."""
    turns, at = [], 0
    while at < len(rendered):
        head = _HEAD.match(rendered, at)
        if not head:
            return None
        stop = _CONTROL.search(rendered, head.end())
        if not stop or stop[0] != CLOSE or rendered[stop.start() - 1] != "\n" or stop.start() == head.end() or rendered[stop.end() : stop.end() + 1] != "\n":
            return None
        role = NAMES.get(head[1]) if head[1][0] != "~" else unquote(head[1][1:], errors="surrogatepass")
        if role is None:
            return None
        turns.append((role, unescape(rendered[head.end() : stop.start() - 1]), head.end(), stop.start() - 1))
        at = stop.end() + 1
    return turns


def render(role: str | None, text: str | None) -> tuple[str, int, int, bool]:
    """A turn that parses back to (role, text): rendered, start and end of the text, and
    whether it had to be escaped."""
    role, text = role or "", text or ""
    name = ROLES.get(role) or "~" + quote(role, safe="", errors="surrogatepass")
    for body in (text, escape(text)):
        rendered = f"{OPEN}{name}: {body}\n{CLOSE}\n"
        turns = parse(rendered)
        if turns and len(turns) == 1 and turns[0][:2] == (role, text):
            return rendered, turns[0][2], turns[0][3], body is not text
    raise AssertionError("an escaped turn always parses back")


def format_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, position, rendered, loss_start, loss_end, escaped): a row for each row of
    ``rows`` (conv_id, turn, role, text); the span is null where no loss applies."""

    def work(packed: list) -> list:
        made = [render(x["role"], x["text"]) for x in packed]
        loss = [x["role"] == "assistant" for x in packed]
        return [
            pa.array([m[0] for m in made], pa.string()),
            pa.array([m[1] if on else None for m, on in zip(made, loss, strict=True)], pa.int32()),
            pa.array([m[2] if on else None for m, on in zip(made, loss, strict=True)], pa.int32()),
            pa.array([m[3] for m in made], pa.bool_()),
        ]

    order = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    packed = rows.select("conv_id", order.alias("order"), F.struct("role", "text").alias("packed"))
    return map_texts(packed, ["conv_id", "order"], "rendered string, loss_start int, loss_end int, escaped boolean", work, text="packed")


def read_back(turns: DataFrame) -> DataFrame:
    """What the formatted rows say, parsed again: a row a conversation.

    The digests of a conversation are running ones, fed in order from a sorted partition,
    so that memory does not grow with its length."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    arrow = "conv_id {0}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long".format(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fresh = None, True
        state: list = []

        def closed() -> pa.RecordBatch:
            n, seen, chars, loss, size = state
            cols = [now, pa.array([n]), pa.array([seen.hexdigest()]), pa.array([chars]), pa.array([loss.hexdigest()]), pa.array([size])]
            return pa.RecordBatch.from_arrays(cols, names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            ids = batch.column("conv_id")
            made = []
            for k, (key, text, a, b) in enumerate(zip(ids.to_pylist(), batch.column("rendered").to_pylist(), batch.column("loss_start").to_pylist(), batch.column("loss_end").to_pylist(), strict=True)):
                if fresh or key != now[0].as_py():
                    if not fresh:
                        made.append(closed())
                    now, fresh, state = ids.slice(k, 1), False, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said, _, _ in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                if a is not None:
                    said = unescape(text[a:b])
                    state[2] += len(said)
                    state[3].update(said.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            if made:
                yield pa.Table.from_batches(made).combine_chunks().to_batches()[0]
        if not fresh:
            yield closed()

    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "order")
    return dealt.select("conv_id", "rendered", "loss_start", "loss_end").mapInArrow(run, arrow)


def numbered(turns: DataFrame) -> DataFrame:
    """``format_turns`` with the turn's position in its conversation instead of its order."""
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("order")) - 1
    return turns.withColumn("position", at).drop("order")
