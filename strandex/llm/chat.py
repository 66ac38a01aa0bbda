"""Chat formatting in budgeted windows.

A conversation's turns, in order, become windows of at most BUDGET tokens that begin and end at turns.
Running sums of the turns' tokens choose each window's span. Every window starts with the leading
system turn; then come the last turns of the window before, up to HISTORY tokens, as context; then new
turns. Loss falls on new assistant texts only, so each is a target once. A turn that alone exceeds the
budget has a window of its own with the system turn, marked over_budget; turns are never cut.

Template of a turn: "### ROLE:\\nTEXT\\n</turn>\\n". Inside roles and texts the escape character
(a backslash), "###" and "</turn>" get a backslash before them, and a role's line feed is "\\n"; what is
escaped can be read back exactly.

Turns are escaped and their tokens counted before the shuffle by conversation; a conversation is then read as
a sorted stream, of which only the window at hand is held.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from .tokens import encoder, public_paths

BUDGET, HISTORY = 1024, 256
END = "\n</turn>\n"

_CONTROL = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(\\|###|</turn>)")
_ESCAPED_ROLE = re.compile(r"\\(\\|###|</turn>|n)")


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def header(role: str) -> str:
    return f"### {escape(role)}:\n".replace("\n", "\\n", role.count("\n"))


def parse(text: str) -> list[tuple[str, str]]:
    """The (role, text) of each turn of a formatted text."""
    out, at = [], 0
    while at < len(text):
        line = text.index("\n", at)
        end = text.index(END, line + 1)
        role = _ESCAPED_ROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], text[at + 4 : line - 1])
        out.append((role, unescape(text[line + 1 : end])))
        at = end + len(END)
    return out


def _measured(turns: DataFrame, paths: tuple[str, str, str]) -> DataFrame:
    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoder(*paths)
        heads = [header(r or "") for r in b["role"].to_pylist()]
        bodies = [escape(t or "") for t in b["text"].to_pylist()]
        tokens = [len(encode(h + t + END)) for h, t in zip(heads, bodies, strict=True)]
        return pa.RecordBatch.from_arrays([b["conv"], b["turn"], b["role"], pa.array(heads), pa.array(bodies), pa.array(tokens, pa.int64())], ["conv", "turn", "role", "head", "body", "tokens"])

    kind = turns.schema["conv"].dataType.simpleString()
    return c.mapped(turns, f, f"conv {kind}, turn long, role string, head string, body string, tokens long")


class _Windows:
    """Windows of one conversation, from its turns in order."""

    def __init__(self, conv, budget: int, history: int):
        self.conv, self.budget, self.history = conv, budget, history
        self.system: tuple | None = None
        self.context: list[tuple] = []
        self.new: list[tuple] = []
        self.past: deque[tuple] = deque()
        self.past_tokens = self.used = self.count = self.done = 0

    def _begin(self, tokens: int) -> None:
        """The context of a window whose first new turn has so many tokens."""
        lead = [self.system] if self.system and self.done else []
        room = self.budget - sum(t[3] for t in lead) - tokens
        past = [t for t in self.past if t is not self.system]
        while past and sum(t[3] for t in past) > room:
            past.pop(0)
        self.context = lead + past
        self.used = sum(t[3] for t in self.context)

    def add(self, turn: tuple) -> Iterator[tuple]:
        """turn: (role, head, body, tokens)."""
        if self.new and self.used + turn[3] > self.budget:
            yield self.close()
        if not self.done and not self.new and turn[0] == "system":
            self.system = turn
        if not self.new:
            self._begin(turn[3])
        self.new.append(turn)
        self.used += turn[3]
        self.past.append(turn)
        self.past_tokens += turn[3]
        while self.past and self.past_tokens > self.history:
            self.past_tokens -= self.past.popleft()[3]

    def close(self) -> tuple:
        parts, at, starts, ends = [], 0, [], []
        for i, (role, head, body, _) in enumerate(self.context + self.new):
            if role == "assistant" and i >= len(self.context):
                starts.append(at + len(head))
                ends.append(at + len(head) + len(body))
            parts += [head, body, END]
            at += len(head) + len(body) + len(END)
        row = (self.conv, self.count, self.done, len(self.context), len(self.new), self.used, self.used > self.budget, "".join(parts), starts, ends)
        self.count += 1
        self.done += len(self.new)
        self.new = []
        return row


_SCHEMA = "window long, first_turn long, context_turns long, new_turns long, tokens long, over_budget boolean, text string, loss_start array<long>, loss_end array<long>"


def chat_windows(turns: DataFrame, paths: tuple[str, str, str] | None = None, budget: int = BUDGET, history: int = HISTORY, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, window, first_turn, context_turns, new_turns, tokens, over_budget, text, loss_start, loss_end).

    The first context_turns turns of a window's text repeat earlier ones; loss spans are code points of
    the text. A conversation's windows follow one another in one partition. Null roles and texts count as
    empty, rows without a conversation id are one conversation, and turns with equal numbers go by role
    and text, null first. An empty table gives no windows.
    """
    rows = turns.select(F.col(id_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    kind = rows.schema["conv"].dataType
    kind_name = kind.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32()}.get(kind_name, pa.string())

    def batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = [arrow, *[pa.int64()] * 5, pa.bool_(), pa.string(), *[pa.list_(pa.int64())] * 2]
        names = ["conv", *(x.split()[0] for x in _SCHEMA.split(", "))]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Windows | None = None
        for b in batches:
            out: list[tuple] = []
            for conv, *turn in zip(*(b[x].to_pylist() for x in ("conv", "role", "head", "body", "tokens")), strict=True):
                if now is None or conv != now.conv:
                    if now:
                        out.append(now.close())
                    now = _Windows(conv, budget, history)
                out += now.add(tuple(turn))
            if out:
                yield batch(out)
        if now:
            yield batch([now.close()])

    c.tune(turns.sparkSession)
    measured = _measured(rows, paths or public_paths())
    return measured.repartition("conv").sortWithinPartitions("conv", "turn", "role", "body").mapInArrow(run, f"conv {kind_name}, {_SCHEMA}")


def read_back(windows: DataFrame) -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), from the formatted texts alone.

    Takes the windows as chat_windows() leaves them: each conversation's in order in one partition.
    """

    def digest(s: list) -> tuple:
        return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: list | None = None
        for b in batches:
            out = []
            for conv, skip, text, starts, ends in zip(*(b[x].to_pylist() for x in ("conv", "context_turns", "text", "loss_start", "loss_end")), strict=True):
                if s is None or s[0] != conv:
                    if s:
                        out.append(digest(s))
                    s = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in parse(text)[skip:]:
                    s[1] += 1
                    s[2].update(f"{role}\n{body}\n".encode())
                for x, y in zip(starts, ends, strict=True):
                    target = unescape(text[x:y])
                    s[3] += len(target)
                    s[4].update(target.encode())
                s[5] += len(text)
            if out:
                yield batch(out, b.schema)
        if s:
            yield batch([digest(s)], b.schema)

    def batch(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        kinds = [schema.field("conv").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = windows.schema["conv"].dataType.simpleString()
    return windows.mapInArrow(run, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
