"""Chat formatting through a template that is known by its output alone.

The template is a function of a list of (role, text) turns. Successive prefixes of a conversation are rendered; where a
prefix's output goes on from the one before, what is new is the turn's span. Where it does not, the template has
rewritten history, and how many characters of it is told. Where an assistant's text lies in its span is found by
rendering the same turns once more with a mark in its place. The rows of a conversation pass in order through one task.
A template says by its attribute ``local`` that what it renders of a turn depends on neither the turns before it nor their number;
of a conversation in such a template a task holds no more than ``WINDOW`` turns. One that doesn't say so gets whole prefixes,
however long they are, because what it does after so many turns can't be known from fewer.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turns = list[tuple[str, str]]
Render = Callable[[Turns], str]

WINDOW, KEEP, ASSISTANT = 64, 4, "assistant"
MARK = "\ue000"  # a private-use character
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[REPLY]", "[ROLE]", "[NAME]", "[/ROLE]")
OPENING = re.compile("(?=" + "|".join(map(re.escape, CONTROLS)) + ")(.)")
TURN = re.compile(r"(?:<s>)?(?:\[INST\] (?P<user>.*) \[/INST\]|\[REPLY\] (?P<assistant>.*) </s>|\[ROLE\] (?P<role>.*) \[NAME\] (?P<other>.*) \[/ROLE\])", re.S)
FORMATTED = "conv_id long, place long, start long, piece string, rewritten long, loss_start long, loss_length long"
REPORT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escaped(text: str) -> str:
    """Backslashes doubled, and one put after the first character of each control string, so that none is left."""
    return OPENING.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescaped(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def instruction_template(turns: Turns) -> str:
    """The template of the registered query; what it escapes can be read back from its output."""
    out = ["<s>"]
    for role, text in turns:
        if role == "user":
            out.append(f"[INST] {escaped(text)} [/INST]")
        elif role == ASSISTANT:
            out.append(f"[REPLY] {escaped(text)} </s>")
        else:
            out.append(f"[ROLE] {escaped(role)} [NAME] {escaped(text)} [/ROLE]")
    return "".join(out)


instruction_template.local = True


def read_turn(piece: str) -> tuple[str, str]:
    """Role and text of one turn's span, as ``instruction_template`` writes it."""
    found = TURN.fullmatch(piece)
    if not found:
        raise ValueError("not a turn of this template")
    role = "user" if found["user"] is not None else ASSISTANT if found["assistant"] is not None else unescaped(found["role"])
    return role, unescaped(next(x for x in (found["user"], found["assistant"], found["other"]) if x is not None))


@dataclass
class Conversation:
    """Renders turn by turn; ``window`` holds the turns of the prefixes, ``output`` what the last of them gave.

    Made without ``whole``, it takes the template for local: after ``WINDOW`` turns prefixes begin anew ``KEEP`` turns back, unless
    the template renders these turns otherwise there.
    """

    render: Render
    learned: tuple[str, ...] = (ASSISTANT,)
    window: Turns = field(default_factory=list)
    spans: list[str] = field(default_factory=list)
    output: str = ""
    before: int = 0  # characters of output that the window's output leaves out
    whole: bool = False

    def add(self, role: str, text: str) -> tuple[int, str, int, int | None, int | None]:
        """Where the turn's span begins, the span, how many characters of history it replaces, and start and length of learned text in it."""
        if len(self.window) >= WINDOW and not self.whole:
            self._begin_anew()
        output = self.render([*self.window, (role, text)])
        same = len(self.output) if output.startswith(self.output) else len(commonprefix([self.output, output]))
        piece, start, rewritten = output[same:], self.before + same, len(self.output) - same
        loss = self._learned(role, text, piece, same) if role in self.learned and not rewritten else (None, None)
        self.window.append((role, text))
        self.spans.append(piece)
        self.output = output
        if rewritten:
            self.whole = True
        return start, piece, rewritten, *loss

    def _learned(self, role: str, text: str, piece: str, same: int) -> tuple[int | None, int | None]:
        """None where the template does not put the whole text, escaped or not, in one place."""
        mark = MARK
        while mark in text or mark in piece:
            mark += MARK
        probe = self.render([*self.window, (role, mark)])
        if not probe.startswith(self.output) or probe.count(mark, same) != 1:
            return None, None
        lead, tail = probe[same:].split(mark)
        if not piece.startswith(lead) or not piece.endswith(tail) or len(piece) < len(lead) + len(tail):
            return None, None
        return len(lead), len(piece) - len(lead) - len(tail)

    def _begin_anew(self) -> None:
        kept = self.window[-KEEP:]
        outputs = [self.render(kept[:i]) for i in range(1, KEEP + 1)]
        again = [b[len(a) :] if b.startswith(a) else None for a, b in zip(outputs, outputs[1:], strict=False)]
        if again != self.spans[-KEEP + 1 :]:
            self.whole = True
            return
        self.before += len(self.output) - len(outputs[-1])
        self.window, self.spans, self.output = kept, self.spans[-KEEP:], outputs[-1]


def format_conversations(conversations: DataFrame, render: Render = instruction_template, learned: tuple[str, ...] = (ASSISTANT,)) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` -> a row for each turn: conv_id, place (from 0), start, piece, rewritten, loss_start,
    loss_length.

    The output up to a turn is the output before, cut at start, then piece. rewritten: how many characters were cut, so that
    a template which only appends has 0 everywhere. loss_start and loss_length: where in piece a learned role's text is, in code
    points; null for other roles, where history is rewritten and where the template changes the text other than by escapes.
    Turns are in the order of turn, then role and text (nulls first); repeated rows are turns of their own. Null texts and roles
    are empty. Rows of a null conv_id are one conversation. Rows stay in order within their partition. A text or conversation of any
    length is rendered by one task; for templates whose attribute ``local`` is true, in time that grows with its length and holding a
    few turns, for others from whole prefixes, in time that grows with its square and holding all its turns. An empty table gives
    an empty result.
    """
    named = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = not getattr(render, "local", False)
    dealt = named.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, place = object(), None, 0
        for batch in batches:
            rows = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv != last:
                    last, state, place = conv, Conversation(render, learned, whole=whole), 0
                rows.append((conv, place, *state.add(role, text)))
                place += 1
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.string() if i == 3 else pa.int64() for i in range(7)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["conv_id", "place", "start", "piece", "rewritten", "loss_start", "loss_length"])

    return dealt.mapInArrow(run, FORMATTED)


class _Reading:
    """What is read back from one conversation's output so far."""

    def __init__(self, conv: int | None):
        self.conv, self.turns, self.loss = conv, hashlib.sha256(), hashlib.sha256()
        self.n = self.learned = self.chars = 0

    def add(self, start: int, piece: str, loss_start: int | None, loss_length: int | None) -> None:
        role, text = read_turn(piece)
        self.n += 1
        self.chars = start + len(piece)
        self.turns.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
        if loss_start is not None:
            under = unescaped(piece[loss_start : loss_start + loss_length])
            self.learned += len(under)
            self.loss.update(under.encode("utf-8", "replace"))

    def row(self) -> tuple:
        return self.conv, self.n, self.turns.hexdigest(), self.learned, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """What the rows of ``format_conversations`` with its own template say, conversation by conversation; no shuffle: they are in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, done = None, []

        def out() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) or [()] * 6
            names = [x.split()[0] for x in REPORT.split(", ")]
            made = [pa.array(c, pa.string() if i in (2, 4) else pa.int64()) for i, c in enumerate(cols)]
            done.clear()
            return pa.RecordBatch.from_arrays(made, names)

        for batch in batches:
            for conv, place, *rest in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "start", "piece", "loss_start", "loss_length")), strict=True):
                if place == 0:
                    done += [state.row()] if state else []
                    state = _Reading(conv)
                state.add(*rest)
            yield out()
        done += [state.row()] if state else []
        yield out()

    return formatted.mapInArrow(run, REPORT)
