"""Chat formatting: conversations rendered by a compiled template, with a loss mask.

Rows of a conversation come to one task, sorted by turn, and are rendered and read back one turn
at a time: a conversation of any length needs memory for one turn and one part. Texts
are escaped so that no control string of the template can occur in them: the reader
finds each turn again, and its text exactly.

A null text or role counts as empty, a null turn comes first; equal turns are ordered by role and text, and repeated
rows are turns of their own. Rows with a null conversation id form one conversation. A very long text is one turn, held at once. Only conv_id, turn, role and text
are read, so other columns' names cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune
from .templates import compile_template

TEMPLATE = (
    "{% for m in messages %}"
    "{% if m.role == 'user' %}<s>[INST] {{ m.text | escape }} [/INST]"
    "{% elif m.role == 'assistant' %} {% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
    "{% elif m.role == 'system' %}<<SYS>>{{ m.text | escape }}<</SYS>>"
    "{% else %}<turn:{{ m.role | escape }}>{{ m.text | escape }}</turn>{% endif %}{% endfor %}"
)
#: Every control string begins with < or [, and the role of other turns ends with >.
CODES = {"\\": "\\\\", "<": "\\l", "[": "\\b", ">": "\\g"}
BACK = {v: k for k, v in CODES.items()}
SPECIAL, CODED = re.compile(r"[\\<\[>]"), re.compile(r"\\[\\lbg]")
PLAIN = r"[^<\[>]*"
TURN = re.compile(rf"<s>\[INST\] (?P<user>{PLAIN}) \[/INST\]| (?P<assistant>{PLAIN})</s>|<<SYS>>(?P<system>{PLAIN})<</SYS>>|<turn:(?P<role>{PLAIN})>(?P<text>{PLAIN})</turn>")
PART_CHARS = 1 << 20


def escape(text: str) -> str:
    return SPECIAL.sub(lambda m: CODES[m[0]], text)


def unescape(text: str) -> str:
    return CODED.sub(lambda m: BACK[m[0]], text)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """The (role, text) turns of formatted text; an error if it isn't whole turns."""
    at = 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        at = m.end()
        kind = next(k for k in ("user", "assistant", "system", "role") if m[k] is not None)
        yield (unescape(m["role"]), unescape(m["text"])) if kind == "role" else (kind, unescape(m[kind]))


def _conversations(batches):
    """(id, turns) of consecutive rows with one id, across batches, as iterators of dictionaries."""
    rows = ((c, {"role": r or "", "text": t or ""}) for b in batches for c, r, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
    held = next(rows, None)

    def turns(key):
        nonlocal held
        while held is not None and held[0] == key:
            yield held[1]
            held = next(rows, None)

    while held is not None:
        yield held[0], turns(held[0])


LOSS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _render(source):
    def run(batches):
        render = compile_template(source, {"escape": escape})
        rows, size = [], 0
        for key, turns in _conversations(batches):
            for part, (text, spans) in enumerate(_parts(render, turns)):
                rows.append((key, part, text, [{"start": a, "end": b} for a, b in spans]))
                size += len(text)
                if size >= PART_CHARS:
                    yield _rows(rows)
                    rows, size = [], 0
        yield _rows(rows)

    return run


def _rows(rows):
    kinds = (pa.int64(), pa.int64(), pa.string(), LOSS)
    cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(cols, ["conv_id", "part", "formatted", "loss"])


def _parts(render, turns) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Formatted text of whole turns, and the spans under the loss mask, in parts of about PART_CHARS."""
    text, spans, size = [], [], 0
    for turn in turns:
        for piece, marked in render({"messages": (turn,)}):
            if marked:
                spans.append((size, size + len(piece)))
            text.append(piece)
            size += len(piece)
        if size >= PART_CHARS:
            yield "".join(text), spans
            text, spans, size = [], [], 0
    if text:
        yield "".join(text), spans


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, part, formatted, loss): parts of a conversation in order hold its whole formatted
    text; loss has the spans (code points of the part) that a model is trained on."""
    tune(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "role", "text", "turn")
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return dealt.mapInArrow(_render(template), "conv_id long, part long, formatted string, loss array<struct<start:int,end:int>>")


FIGURES = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}


def _digest(batches):
    """Parts of a conversation follow each other: one partition, in order."""
    state, done = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] == 0:
                done += [_figures(state)] if state else []
                state = {"id": row["conv_id"], "turns": 0, "hash": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0}
            text = row["formatted"]
            for role, said in read_turns(text):
                state["turns"] += 1
                state["hash"].update(f"{role}\n{said}\n".encode())
            for span in row["loss"]:
                under = unescape(text[span["start"] : span["end"]])
                state["chars"] += len(under)
                state["loss"].update(under.encode())
            state["size"] += len(text)
        yield _table(done)
        done = []
    yield _table([_figures(state)] if state else [])


def _figures(s) -> tuple:
    return s["id"], s["turns"], s["hash"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["size"]


def _table(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(FIGURES.values())], list(FIGURES))


def digest(formatted: DataFrame) -> DataFrame:
    """What can be read back from the result of format_conversations, whose partitions must be untouched."""
    return formatted.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
