"""Chat formatting with loss masks, located by incremental black-box rendering.

A template is any function from a list of ``(role, text)`` messages to a string; nothing
about its inside is assumed.  Each prefix of a conversation is rendered; a turn's span is
what its prefix adds to the one before.  If a prefix does not begin with the one before,
the template rewrites history: the conversation is reported and gets no spans.  Inside a
turn's span the text is found by rendering the prefix twice more with the last text
replaced by two probes that differ in their first and last character: what both share at
either end is the template's.

The cost is quadratic in the turns of one conversation, as black-box rendering must be.
A formatted conversation is one string, so a conversation is one row of the result and is
gathered in one task; conversations are spread by ``conv_id``.

Defined results: turns go by ``turn``, then role, then text (nulls first); repeated rows are
repeated turns; null role or text counts as empty; rows with a null ``conv_id`` make one
conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts

Template = Callable[[list[tuple[str, str]]], str]

START, END = "<|im_start|>", "<|im_end|>"
_OPEN = re.compile(r"<(\\*)\|")
_CLOSED = re.compile(r"<\\(\\*)\|")
PROBES = ("a-probe-a", "b.probe.b")


def escape(text: str) -> str:
    """No ``<|`` is left: each gets a backslash (one more where there are some)."""
    return _OPEN.sub(r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _CLOSED.sub(r"<\1|", text) if "<" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def chat_template(messages: list[tuple[str, str]]) -> str:
    """Turns between start and end marks, control strings in texts escaped."""
    return "".join(f"{START}{escape_role(r)}\n{escape(t)}{END}\n" for r, t in messages)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The messages of a string that ``chat_template`` made."""
    out, at, stop = [], 0, END + "\n"
    while at < len(formatted):
        line = formatted.find("\n", at)
        end = formatted.find(stop, line + 1) if line >= 0 else -1
        if end < 0 or not formatted.startswith(START, at):
            raise ValueError(f"no turn at {at}")
        out.append((unescape_role(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(stop)
    return out


def common_start(a: str, b: str, least: int = 0) -> int:
    """How many characters two strings share at their start, of which ``least`` are known; by halving slices."""
    low, high = least, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def common_end(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[len(a) - middle : len(a) - low] == b[len(b) - middle : len(b) - low]:
            low = middle
        else:
            high = middle - 1
    return low


def locate(messages: list[tuple[str, str]], template: Template) -> tuple[str, list[tuple[int, int, int, int]], bool]:
    """Rendered text; ``(start, end, text_start, text_end)`` of each turn; whether history was rewritten."""
    before = template([])
    spans = []
    for k in range(1, len(messages) + 1):
        now = template(messages[:k])
        if not now.startswith(before):
            return template(messages), [], True
        a, b = (template([*messages[: k - 1], (messages[k - 1][0], p)]) for p in PROBES)
        shared = len(before) if a.startswith(before) and b.startswith(before) else 0
        head, tail = common_start(a, b, shared), common_end(a, b)
        spans.append((len(before), len(now), head, len(now) - tail))
        before = now
    return before, spans, False


SCHEMA = "conv_id {kind}, n_turns int, formatted string, rewrites boolean, spans array<struct<role:string,start:int,end:int,text_start:int,text_end:int,loss:boolean>>"


def format_conversations(conversations: DataFrame, template: Template = chat_template, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``conv_id, n_turns, formatted, rewrites, spans`` of every conversation."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    grouped = conversations.select("conv_id", "turn", "role", "text").groupBy("conv_id").agg(turns)
    span = pa.list_(pa.struct([("role", pa.string()), *[(n, pa.int32()) for n in ("start", "end", "text_start", "text_end")], ("loss", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            sizes, texts, flags, spans = [], [], [], []
            for turns in batch.column(1).to_pylist():
                messages = [(t["role"] or "", t["text"] or "") for t in turns]
                text, found, rewrites = locate(messages, template)
                sizes.append(len(messages))
                texts.append(text)
                flags.append(rewrites)
                spans.append([{"role": r, "start": s[0], "end": s[1], "text_start": s[2], "text_end": s[3], "loss": r in loss_roles} for (r, _), s in zip(messages, found)])
            cols = [batch.column(0), pa.array(sizes, pa.int32()), pa.array(texts, pa.string()), pa.array(flags, pa.bool_()), pa.array(spans, span)]
            yield pa.RecordBatch.from_arrays(cols, ["conv_id", "n_turns", "formatted", "rewrites", "spans"])

    return grouped.mapInArrow(run, SCHEMA.format(kind=kind))


def digest(formatted: DataFrame) -> DataFrame:
    """What can be read back from the formatted strings and their masks."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            rows = []
            for conv, text, spans in zip(*(batch.column(c).to_pylist() for c in range(3))):
                turns = parse(text)
                whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "replace"))
                loss = "".join(unescape(text[s["text_start"] : s["text_end"]]) for s in spans if s["loss"])
                rows.append((conv, len(turns), whole.hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "replace")).hexdigest(), len(text)))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            types = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "formatted", "spans").mapInArrow(run, schema)
