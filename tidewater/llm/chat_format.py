"""Chat formatting with loss masks found by watching a template from outside.

A template is any function from a list of turns to a string. Successive prefixes
of a conversation are rendered and consecutive outputs compared: what an output
adds to the one before is the new turn's span, and one that does not begin with
the one before comes from a template that rewrites history. Inside a span, the
text's place is found by rendering the turn with a marker in the text's stead.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]  # role, text
Template = Callable[[list[Turn]], str]

#: Control strings of the default template. All are escaped inside roles and texts.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[TEXT]", "[/ROLE]")
_ESCAPED = re.compile(r"(?<!\\)(\\*+)(" + "|".join(map(re.escape, CONTROL)) + ")")
_ANY = re.compile(r"(?<!\\)(\\++)(" + "|".join(map(re.escape, CONTROL)) + ")")
#: Stands for a text while the template is probed; a private character that no control string holds.
MARKER = "\ue000"


def escape(text: str) -> str:
    """One more backslash before each control string, however many stand there."""
    return _ESCAPED.sub(r"\\\1\2", text)


def unescape(text: str) -> str:
    """What escape() was given."""
    return _ANY.sub(lambda m: m[1][1:] + m[2], text)


def bracket_template(turns: list[Turn]) -> str:
    """The default: user and assistant turns in brackets, other roles by name. A space parts each text from the control strings."""
    out = []
    for role, text in turns:
        if role == "user":
            out.append(f"<s> [INST] {escape(text)} [/INST]\n")
        elif role == "assistant":
            out.append(f"{escape(text)} </s>\n")
        else:
            out.append(f"[ROLE] {escape(role)} [TEXT] {escape(text)} [/ROLE]\n")
    return "".join(out)


_TURN = re.compile(r"<s> \[INST\] (?P<user>.*?) (?<!\\)\[/INST\]\n|\[ROLE\] (?P<role>.*?) (?<!\\)\[TEXT\] (?P<text>.*?) (?<!\\)\[/ROLE\]\n|(?P<assistant>.*?) (?<!\\)</s>\n", re.DOTALL)


def read_back(formatted: str) -> list[Turn]:
    """The turns that the default template was given."""
    out: list[Turn] = []
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"not a turn at {at}")
        at = m.end()
        if m["user"] is not None:
            out.append(("user", unescape(m["user"])))
        elif m["role"] is not None:
            out.append((unescape(m["role"]), unescape(m["text"])))
        else:
            out.append(("assistant", unescape(m["assistant"])))
    return out


@dataclass
class Rendered:
    text: str
    spans: list[tuple[int, int]]  # of each turn in the text
    loss: list[tuple[int, int]]  # of each assistant text in the text
    rewrites: bool


def render(turns: list[Turn], template: Template = bracket_template, loss_role: str = "assistant") -> Rendered:
    """Render all turns and locate each by comparing outputs of successive prefixes.

    If an output does not begin with the one before it, the template rewrites
    history: ``rewrites`` is set, and no spans or loss are claimed for the conversation.
    """
    before, spans, loss = template([]), [], []
    for at, (role, text) in enumerate(turns):
        now = template(turns[: at + 1])
        if not now.startswith(before):
            return Rendered(template(turns), [], [], True)
        spans.append((len(before), len(now)))
        if role == loss_role:
            marker = MARKER
            while marker in now:
                marker += MARKER
            probe = template([*turns[:at], (role, marker)])
            head = probe.find(marker, len(before))
            if head < 0 or not probe.startswith(before):
                return Rendered(template(turns), [], [], True)
            tail = len(probe) - head - len(marker)
            loss.append((head, len(now) - tail))
        before = now
    return Rendered(before, spans, loss, False)


def format_conversations(rows: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template: Template = bracket_template) -> DataFrame:
    """A row per conversation: key, n_turns, formatted, turn_spans, loss_spans, rewrites_history.

    Turns go by ``turn``, nulls first; ties by role and text, so the order is
    defined. Null roles and texts are empty strings. Rows with a null key form one
    conversation. Repeated rows are turns of their own. Other columns are not
    read; an empty table gives no rows. Spans are code points, end exclusive.
    A conversation is the unit and its turns are gathered in one row; texts of any
    length are rendered whole.
    """
    whole = rows.select(F.col(conversation).alias("c"), F.struct(F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("x")).alias("turn"))
    whole = whole.groupBy("c").agg(F.sort_array(F.collect_list("turn")).alias("turns")).select("c", F.col("turns.r").alias("roles"), F.col("turns.x").alias("texts"))
    kind = dict(rows.dtypes)[conversation]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            got = [render(list(zip(r, x, strict=True)), template) for r, x in zip(batch.column("roles").to_pylist(), batch.column("texts").to_pylist(), strict=True)]
            named = [[[{"start": a, "end": b} for a, b in spans] for spans in x] for x in ([g.spans for g in got], [g.loss for g in got])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("c"), pa.array([len(r) for r in batch.column("roles")], pa.int64()), pa.array([g.text for g in got], pa.string()), pa.array(named[0], pair), pa.array(named[1], pair), pa.array([g.rewrites for g in got])],
                [conversation, "n_turns", "formatted", "turn_spans", "loss_spans", "rewrites_history"],
            )

    span = "array<struct<start:long,end:long>>"
    return whole.mapInArrow(run, f"`{conversation}` {kind}, n_turns long, formatted string, turn_spans {span}, loss_spans {span}, rewrites_history boolean")


def digests(formatted: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """What the formatted strings and spans hold, read back: digests of turns and of the text under the loss."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for c, text, spans in zip(*(batch.column(x).to_pylist() for x in (conversation, "formatted", "loss_spans")), strict=True):
                turns = read_back(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                own = "".join(f"{r}\n{x}\n" for r, x in turns)
                out.append((c, len(turns), hashlib.sha256(own.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = (batch.column(conversation).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], [conversation, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = dict(formatted.dtypes)[conversation]
    return formatted.mapInArrow(run, f"`{conversation}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
