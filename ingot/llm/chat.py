"""Operator 9: chat formatting in budgeted windows.

A conversation's turns are cut into spans whose tokens, by prefix sums, fit the
budget. Each window holds the system turn, up to HISTORY_TURNS turns of history before
the span (HISTORY_TOKENS at most), and the span. Only the texts of assistant turns of the span are under the loss
mask: what a window repeats as history is masked. So each assistant text is learned once.

Template: ``### role: text</turn>`` and a line end. A backslash goes before each backslash, ``#`` and ``<`` of
a text (and ``:`` and line ends of a role), so no text can hold a mark of the template, and taking them out again gives
the text back. A token is a run of characters other than white space.

Rows are brought together and sorted by (conv_id, turn, role, text), and streamed: a task holds one window,
not a conversation, which may be a third of the table.

Edge cases: null texts and roles are empty; rows of one turn are ordered by role and text, and repeated rows are
turns of their own; a turn over the budget is a window of its own, whole; a null conv_id is one conversation; an
empty table gives an empty result. Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ingot.llm.common import prepare, ships

ships(__name__)

BUDGET = 512  # tokens of a window
HISTORY_TURNS = 4
HISTORY_TOKENS = BUDGET // 4
EXTRA = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]  # fixed by the contract

_TURN = re.compile(r"### ((?:[^\\:\n]|\\.)*): ((?:[^\\<]|\\.)*)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str, marks: str) -> str:
    return re.sub(f"([{re.escape(marks)}])", r"\\\1", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turn_text(role: str, text: str) -> tuple[str, str, str]:
    """What stands before, in and after a turn's place for its text."""
    return f"### {escape(role, chr(92) + '#<:' + chr(10))}: ", escape(text, "\\#<"), "</turn>\n"


def tokens(formatted: str) -> int:
    return len(formatted.split())


class _Window:
    """Turns of one conversation, as they come, cut into windows."""

    def __init__(self, conv, budget, history_turns, history_tokens):
        self.conv, self.budget = conv, budget
        self.history_tokens = history_tokens
        self.number = 0
        self.system = None
        self.past = deque(maxlen=history_turns)  # turns before the span, newest last
        self.span, self.size = [], 0  # new turns, and the prefix sum of their tokens

    def _repeated(self):
        out, left = [], self.history_tokens
        for t in reversed(self.past):
            if t[1] > left:
                break
            out.insert(0, t)
            left -= t[1]
        first = [self.system] if self.number and self.system else []
        return first + out

    def add(self, role, text):
        turn = (turn_text(role, text), 0, role)
        turn = (turn[0], tokens("".join(turn[0])), role)
        before = sum(t[1] for t in self._repeated()) if not self.span else self.before
        if self.span and before + self.size + turn[1] > self.budget:
            yield self.close()
            before = sum(t[1] for t in self._repeated())
        if not self.span:
            while self.past and before + turn[1] > self.budget:  # a long turn goes before history
                self.past.popleft()
                before = sum(t[1] for t in self._repeated())
            self.before = before
        if self.number == 0 and not self.span and role == "system":
            self.system = turn
        self.span.append(turn)
        self.size += turn[1]

    def close(self):
        old = self._repeated()
        text, at, loss = [], 0, []
        for k, (parts, _, role) in enumerate(old + self.span):
            start = at + len(parts[0])
            if k >= len(old) and role == "assistant":
                loss.append((start, start + len(parts[1])))
            at = start + len(parts[1]) + len(parts[2])
            text += parts
        row = (self.conv, self.number, "".join(text), loss, len(old), len(self.span))
        self.past.extend(t for t in self.span if t is not self.system)
        self.number += 1
        self.span, self.size = [], 0
        return row


_WINDOW = "window long, text string, loss array<struct<start:int,end:int>>, n_old int, n_new int"
_PA = [pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.int32(), pa.int32()]
FLUSH = 200  # windows of an output batch


def window_batches(budget: int, history_turns: int, history_tokens: int):
    """For mapInArrow over sorted (conv_id, role, text): windows."""

    def run(batches):
        kind, now, out = None, None, []

        def batch():
            cols = [pa.array([r[0] for r in out], kind)]
            cols += [pa.array([r[k + 1] for r in out], t) for k, t in enumerate(_PA)]
            return pa.RecordBatch.from_arrays(cols, names=["conv_id", "window", "text", "loss", "n_old", "n_new"])

        for b in batches:
            kind = b.column(0).type
            for conv, role, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        out.append(now.close())
                    now = _Window(conv, budget, history_turns, history_tokens)
                out.extend(now.add(role, text))
                if len(out) >= FLUSH:
                    yield batch()
                    out = []
        if now is not None:
            out.append(now.close())
            yield batch()

    return run


def format_conversations(
    rows: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS
) -> DataFrame:
    """conv_id, window, text, loss (spans of code points), n_old (repeated turns), n_new: one row per window."""
    prepare(rows.sparkSession)
    empty = F.lit("")
    rows = rows.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()
    return rows.select("conv_id", "role", "text").mapInArrow(
        window_batches(budget, history_turns, history_tokens), f"conv_id {kind}, {_WINDOW}"
    )


def turns_of(window: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted window; raises if it isn't one."""
    out, at = [], 0
    while at < len(window):
        m = _TURN.match(window, at)
        if not m:
            raise ValueError("not a formatted window")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def back_batches(batches):
    """For mapInArrow over sorted (conv_id, text, loss, n_old): the figures of each conversation."""
    kind, rows, now = None, [], None

    def done():
        conv, n, turns, chars, learned, total = now
        return conv, n, turns.hexdigest(), chars, learned.hexdigest(), total

    def batch():
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    for b in batches:
        kind = b.column(0).type
        for conv, text, loss, n_old in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            if now is None or now[0] != conv:
                if now is not None:
                    rows.append(done())
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in turns_of(text)[n_old:]:
                now[1] += 1
                now[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            for span in loss:
                said = unescape(text[span["start"] : span["end"]])
                now[3] += len(said)
                now[4].update(said.encode("utf-8", "surrogatepass"))
            now[5] += len(text)
        if len(rows) >= FLUSH:
            yield batch()
            rows = []
    if now is not None:
        rows.append(done())
        yield batch()


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the windows alone."""
    kind = windows.schema["conv_id"].dataType.simpleString()
    rows = windows.select("conv_id", "window", "text", "loss", "n_old")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return rows.select("conv_id", "text", "loss", "n_old").mapInArrow(
        back_batches, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def formatted(rows: DataFrame) -> DataFrame:
    """Format all conversations and the contract's further one, and read them back."""
    spark = rows.sparkSession
    columns = ["conv_id", "turn", "role", "text"]
    extra = spark.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(rows.select(columns).union(extra)))
