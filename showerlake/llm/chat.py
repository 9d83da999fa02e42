"""Chat formatting: a finite-state machine over roles, and segments with loss flags from a declarative template.

Rows are dealt by conversation and sorted by turn; they are then streamed, so a
conversation of any length needs the memory of one turn. Ties of a turn number are
taken by role and text; repeated rows are turns of their own. A null role is the empty
role, a null text is empty, a null turn comes first. A conversation that breaks the turn
order is formatted like any other and says so in `valid` and `error`. An empty table gives no
rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """What stands before and after the text of each role. {role} in `other` is the escaped role name."""

    marks: dict = field(default_factory=lambda: {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("[ANS] ", " [/ANS]</s>")})
    other: tuple = ("[ROLE {role}] ", " [/ROLE]")
    control: tuple = ("<s>", "</s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[ANS]", "[/ANS]", "[ROLE", "[/ROLE]")
    loss_roles: tuple = ("assistant",)
    #: state -> role -> next state; a role without an arrow breaks the order. "end" states may end a conversation.
    arrows: dict = field(default_factory=lambda: {"start": {"system": "opened", "user": "asked"}, "opened": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}})
    ends: tuple = ("answered", "asked")

    def escape(self, text: str) -> str:
        """Reversible: the escape character is doubled, and stands after the first character of each control string."""
        text = text.replace(ESCAPE, ESCAPE * 2)
        return re.sub("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.control), lambda m: m[0] + ESCAPE, text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", lambda m: m[1] if m[1] == ESCAPE else m[1], text, flags=re.S)

    def turn(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The segments of a turn: (text, whether loss is taken on it)."""
        before, after = self.marks.get(role) or (self.other[0].replace("{role}", self.escape(role).replace("]", ESCAPE + "]")), self.other[1])
        return [(before, False), (self.escape(text), role in self.loss_roles), (after, False)]

    def reader(self) -> re.Pattern:
        """Matches one formatted turn; escaped texts hold no control string, so the first closing mark is the turn's."""
        known = [f"(?P<r{i}>{re.escape(a)})(?P<t{i}>.*?){re.escape(b)}" for i, (a, b) in enumerate(self.marks.values())]
        return re.compile("|".join([*known, r"\[ROLE (?P<name>(?:\\.|[^\\\]])*)\] (?P<t>.*?)" + re.escape(self.other[1])]), re.S)


def _segments(batches: Iterator[pd.DataFrame], template: Template) -> Iterator[pd.DataFrame]:
    conv, state, at, error = object(), "start", 0, ""
    for pdf in batches:
        out = []
        for conv_id, role, text in zip(pdf["conv_id"], pdf["role"], pdf["text"], strict=True):
            conv_id = None if pd.isna(conv_id) else int(conv_id)
            if conv_id != conv:
                conv, state, at, error = conv_id, "start", 0, ""
            follows = template.arrows.get(state, {}).get(role)
            if follows is None and not error:
                error = f"turn {at}: {role or 'no role'} after {state}"
            state = follows or state
            out += [(conv_id, at, k, s, loss, error) for k, (s, loss) in enumerate(template.turn(role, text))]
            at += 1
        yield pd.DataFrame(out, columns=["conv_id", "turn_no", "segment_no", "text", "loss", "error"]).astype({"conv_id": "Int64"})


SEGMENTS = "conv_id long, turn_no long, segment_no int, text string, loss boolean, error string"


def chat_segments(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """The formatted conversations, as segments in order within each conversation: conv_id, turn_no, segment_no, text,
    loss, error (the first break of the turn order so far, else empty). Joined in order, the texts are the training text."""
    template = template or Template()
    rows = conversations.select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return dealt.select("conv_id", "role", "text").mapInPandas(lambda batches: _segments(batches, template), SEGMENTS)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, error string"


def _digests(batches: Iterator[pd.DataFrame], template: Template) -> Iterator[pd.DataFrame]:
    """Reads turns back from the formatted text alone: a turn is taken off the buffer as soon as it is whole."""
    reader, roles = template.reader(), list(template.marks)
    conv, open_ = None, False
    state: dict = {}

    def fresh() -> dict:
        return {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "buffer": "", "error": ""}

    def row() -> tuple:
        if state["buffer"]:
            raise ValueError(f"conversation {conv} can't be read back from {state['buffer'][:80]!r}")
        return conv, state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"], not state["error"], state["error"]

    for pdf in batches:
        out = []
        for conv_id, text, loss, error in zip(pdf["conv_id"], pdf["text"], pdf["loss"], pdf["error"], strict=True):
            conv_id = None if pd.isna(conv_id) else int(conv_id)
            if not open_ or conv_id != conv:
                out += [row()] if open_ else []
                conv, open_, state = conv_id, True, fresh()
            state["error"] = state["error"] or error
            state["chars"] += len(text)
            state["buffer"] += text
            if loss:
                plain = template.unescape(text)
                state["loss"].update(plain.encode())
                state["loss_chars"] += len(plain)
                continue
            if m := reader.fullmatch(state["buffer"]):
                i = next((i for i in range(len(roles)) if m[f"r{i}"] is not None), None)
                role, said = (roles[i], m[f"t{i}"]) if i is not None else (template.unescape(m["name"]), m["t"])
                state["turns"].update(f"{role}\n{template.unescape(said)}\n".encode())
                state["n"] += 1
                state["buffer"] = ""
        yield pd.DataFrame(out, columns=[c.split()[0] for c in DIGESTS.split(", ")]).astype({"conv_id": "Int64"})
    if open_:
        yield pd.DataFrame([row()], columns=[c.split()[0] for c in DIGESTS.split(", ")]).astype({"conv_id": "Int64"})


def chat_digests(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """What the formatted text of each conversation says when read back. `segments` must come straight from
    chat_segments: the segments of a conversation lie together, in order, in one partition."""
    template = template or Template()
    return segments.select("conv_id", "text", "loss", "error").mapInPandas(lambda batches: _digests(batches, template), DIGESTS)
