"""Chat formatting: a finite-state machine over roles, a declarative template, and segments with loss flags.

A template says how each role's turn opens, how turns close, which strings in a text it must escape, and which roles are
trained on. Formatting emits one row per segment (opening, text, closing) with its loss flag. Texts are escaped by a
backslash before each control string and each backslash, so that reading back gives every turn exactly.

Conversations are dealt by conv_id and sorted by (turn, role, text) inside partitions; one pass over the sorted rows
carries the machine's state, so that no conversation is held in memory, however long it is; reading back holds one turn.

Defined cases: a null text or role counts as empty; a null turn sorts first; a null conv_id is a conversation of its own.
Roles that the template doesn't name get an opening that holds the escaped name. Conversations that break the turn order
are formatted as well and marked by valid = false on their rows from the first breach on. Repeated rows are repeated
turns. Other columns are dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Template:
    """openings by role; close ends every turn; trained: roles whose texts count for the loss."""

    openings: dict[str, str] = field(default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "})
    other: tuple[str, str] = ("### @", ": ")
    close: str = " </turn>\n"
    controls: tuple[str, ...] = ("###", "</turn>")
    trained: tuple[str, ...] = ("assistant",)
    #: state -> role -> next state; what is missing is a breach
    turns: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "briefed", "user": "asked"},
            "briefed": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )

    def escape(self, text: str) -> str:
        text = text.replace("\\", "\\\\")
        for c in self.controls:
            text = text.replace(c, "\\" + c)
        return text

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text

    def opening(self, role: str) -> str:
        if role in self.openings:
            return self.openings[role]
        before, after = self.other
        return before + self.escape(role).replace(":", "\\:") + after

    def role_of(self, opening: str) -> str:
        for role, o in self.openings.items():
            if o == opening:
                return role
        before, after = self.other
        return self.unescape(opening[len(before) : len(opening) - len(after)])


SEGMENTS = "conv_id long, seq long, part string, text string, loss boolean, valid boolean"


def segments(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per segment: conv_id, seq (running within the conversation), part, text, loss, valid."""
    t = template or Template()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, seq, state = (), 0, "start"
        for batch in batches:
            out = []
            for conv, role, text in zip(batch.conv_id, batch.role, batch.text, strict=True):
                key = (None if pd.isna(conv) else int(conv),)
                if key != now:
                    now, seq, state = key, 0, "start"
                state = t.turns.get(state, {}).get(role, "breach")
                ok, loss = state != "breach", role in t.trained
                out += [
                    (key[0], seq, "open", t.opening(role), False, ok),
                    (key[0], seq + 1, "text", t.escape(text), loss, ok),
                    (key[0], seq + 2, "close", t.close, False, ok),
                ]
                seq += 3
            got = pd.DataFrame(out, columns=["conv_id", "seq", "part", "text", "loss", "valid"])
            got["conv_id"] = got["conv_id"].astype("Int64")
            yield got

    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInPandas(run, SEGMENTS)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


class Reader:
    """Takes the formatted text of a conversation piece by piece, and gives each turn as soon as its end has come."""

    def __init__(self, template: Template) -> None:
        t = self.template = template
        named = "|".join(re.escape(o) for o in t.openings.values())
        before, after = map(re.escape, t.other)
        self.opening = re.compile(rf"{named}|{before}(?:[^\\:]|\\.)*{after}", re.S)
        self.body = re.compile(r"(?:[^\\" + re.escape(t.close[0]) + r"]+|\\.|(?!" + re.escape(t.close) + r").)*+", re.S)
        self.pending: list[str] = []

    def take(self, text: str) -> Iterator[tuple[str, str]]:
        self.pending.append(text)
        if not text.endswith(self.template.close):
            return
        formatted, at = "".join(self.pending), 0
        while at < len(formatted):
            head = self.opening.match(formatted, at)
            body = head and self.body.match(formatted, head.end())
            if not body or not formatted.startswith(self.template.close, body.end()):
                break
            yield self.template.role_of(head[0]), self.template.unescape(body[0])
            at = body.end() + len(self.template.close)
        self.pending = [formatted[at:]] if at < len(formatted) else []


def read_back(parts: DataFrame, template: Template | None = None, in_order: bool = False) -> DataFrame:
    """What the formatted text says, one row per conversation: turns and digests.

    Turns are parsed out of the joined text of the segments, whatever part they say they are; the loss is what stands
    under the segments' mask. valid is false for a breach of turn order and for text that doesn't parse to its end.
    in_order: parts are as segments() returns them, each conversation's in one partition and in order; else they are dealt
    and sorted first."""
    t = template or Template()

    class Reading:
        def __init__(self) -> None:
            self.turns, self.trained, self.reader = hashlib.sha256(), hashlib.sha256(), Reader(t)
            self.n = self.loss = self.chars = 0
            self.valid = True

        def take(self, text: str, loss: bool, valid: bool) -> None:
            self.chars += len(text)
            self.valid &= valid
            if loss:
                own = t.unescape(text)
                self.loss += len(own)
                self.trained.update(own.encode())
            for role, own in self.reader.take(text):
                self.n += 1
                self.turns.update(f"{role}\n{own}\n".encode())

        def row(self, conv: int | None) -> tuple:
            return (conv, self.n, self.turns.hexdigest(), self.loss, self.trained.hexdigest(), self.chars, self.valid and not self.reader.pending)

    columns = [c.split()[0] for c in READ.split(", ")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        got = pd.DataFrame(rows, columns=columns)
        got["conv_id"] = got["conv_id"].astype("Int64")
        return got

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, reading = (), None
        for batch in batches:
            done = []
            for conv, text, loss, valid in zip(batch.conv_id, batch.text, batch.loss, batch.valid, strict=True):
                key = (None if pd.isna(conv) else int(conv),)
                if key != now:
                    if reading:
                        done.append(reading.row(now[0]))
                    now, reading = key, Reading()
                reading.take(text, loss, valid)
            if done:
                yield frame(done)
        if reading:
            yield frame([reading.row(now[0])])

    dealt = parts if in_order else parts.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return dealt.select("conv_id", "text", "loss", "valid").mapInPandas(run, READ)


def parse(formatted: str, template: Template | None = None) -> list[tuple[str, str]]:
    """The turns of one formatted conversation, from its text alone: the inverse of joining its segments."""
    return list(Reader(template or Template()).take(formatted))
