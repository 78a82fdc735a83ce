"""The part of a document that a line belongs to, as a finite automaton whose runs can be cut and joined.

A line is given as a letter (bits that column expressions compute).  What it does depends only on its letter and on a
state: the section's part, the kind of the block in progress, whether footnotes wait behind that block, and how far the
title has come.  So a stretch of lines is a function from the state it is entered in to the state it is left in, and such
functions compose: stretches are read apart, in any order, and joined.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyspark.cloudpickle

PARTS = ("start", "authors", "abstract", "abstract-inline", "body", "refs")
KINDS = ("", "title", "authors", "abstract", "heading", "paragraph", "caption", "equation", "table", "reference")
NONE, TITLE, AUTHORS, ABSTRACT, HEADING, PARAGRAPH, CAPTION, EQUATION, TABLE, REFERENCE = range(len(KINDS))
START, IN_AUTHORS, IN_ABSTRACT, IN_INLINE, IN_BODY, IN_REFS = range(len(PARTS))
STATES = len(PARTS) * len(KINDS) * 2 * 4
#: What a line does: goes on with the block in progress, begins one, begins a footnote, goes on with one.
GOES_ON, BEGINS, NOTE_BEGINS, NOTE_GOES_ON = range(4)

#: The bits of a letter in order; levels take two.
BITS = (
    "footnote note_goes_on on_first_page title_head title_goes_on placed_title in_placed_title level level_ level_in_refs level_in_refs_ level_in_front level_in_front_ names_abstract names_refs "
    "heading_goes_on new new_after_set front inline_abstract reference closed blank_before caption equation same_placing tabular open_caption heads_table"
).split()
BIT = {name: 1 << k for k, name in enumerate(BITS)}
SHIFT = {name: k for k, name in enumerate(BITS)}


def state_of(part: int, kind: int, waiting: int, titled: int) -> int:
    return ((part * len(KINDS) + kind) * 2 + waiting) * 4 + titled


def step(letter: int, state: int) -> tuple[int, int, int]:
    """The next state, what the line does, and its level if it begins a heading."""
    rest, titled = divmod(state, 4)
    rest, waiting = divmod(rest, 2)
    part, kind = divmod(rest, len(KINDS))
    has = lambda name: bool(letter & BIT[name])
    if has("footnote"):
        return state_of(part, kind, 1, titled), NOTE_GOES_ON if waiting and has("note_goes_on") else NOTE_BEGINS, 0

    def go_on(part: int = part) -> tuple[int, int, int]:
        return state_of(part, kind, waiting, titled), GOES_ON, 0

    def begin(new_kind: int, part: int = part, level: int = 0) -> tuple[int, int, int]:
        return state_of(part, new_kind, 0, titled), BEGINS, level

    in_title = has("in_placed_title")
    if has("on_first_page") and not has("placed_title") and titled < 3:
        in_title = has("title_head") if titled == 0 else has("title_goes_on")
        titled = titled + 1 if in_title else 3
    if in_title:
        return go_on(IN_AUTHORS) if kind == TITLE else begin(TITLE, IN_AUTHORS)
    level = letter >> SHIFT["level_in_refs" if part == IN_REFS else "level_in_front" if part == IN_AUTHORS else "level"] & 3
    if level:
        if kind == HEADING and has("heading_goes_on"):
            return go_on()
        return begin(HEADING, IN_ABSTRACT if has("names_abstract") else IN_REFS if has("names_refs") else IN_BODY, level)
    new = kind in (NONE, TITLE, HEADING) or has("new_after_set" if kind in (TABLE, EQUATION, CAPTION, AUTHORS) else "new")
    if part == IN_AUTHORS:
        if has("front"):
            return go_on() if kind == AUTHORS else begin(AUTHORS)
        part = IN_BODY
    if part == IN_REFS:
        entry = has("reference") and (kind != REFERENCE or has("closed"))
        return go_on(part) if not entry and kind == REFERENCE and not (has("blank_before") and has("reference")) else begin(REFERENCE, part)
    if has("caption"):
        return begin(CAPTION, part)
    if has("equation"):
        return go_on(part) if kind == EQUATION and not new and has("same_placing") else begin(EQUATION, part)
    if has("tabular"):
        return go_on(part) if kind == TABLE or (kind == CAPTION and not new and has("open_caption")) else begin(TABLE, part)
    if has("heads_table") and not (kind == PARAGRAPH and not new):
        return begin(TABLE, part)
    if not new and kind not in (EQUATION, TABLE):
        return go_on(part)
    if has("inline_abstract") and part != IN_ABSTRACT:
        return begin(ABSTRACT, IN_INLINE)
    return begin(ABSTRACT if part == IN_ABSTRACT else PARAGRAPH, part)


@lru_cache(maxsize=1 << 16)
def cached_step(letter: int, state: int) -> tuple[int, int, int]:
    return step(letter, state)


@lru_cache(maxsize=1 << 12)
def transitions(letter: int) -> tuple[np.ndarray, np.ndarray]:
    """Next states and actions of a letter, by state."""
    rows = [step(letter, s) for s in range(STATES)]
    return np.array([r[0] for r in rows], np.int32), np.array([r[1] for r in rows], np.int8)


@dataclass
class Position:
    """Where a reader stands in a document: the state, how many blocks and footnotes have begun (``n``), the numbers of the
    block and the footnote in progress, and the lines of the heading that it stands below."""

    state: int = 0
    n: int = 0
    block: int = 0
    note: int = 0
    section: list[str] = field(default_factory=list)

    def take(self, letter: int, text: str) -> tuple[int, str | None, int, list[str] | None]:
        """The number of the line's block; and if it begins that, its kind, level and section."""
        self.state, action, level = cached_step(letter, self.state)
        if action >= NOTE_BEGINS:
            if action == NOTE_GOES_ON:
                return self.note, None, 0, None
            self.n += 1
            self.note = self.n
            return self.n, "footnote", 0, self.section
        kind = self.state // 8 % len(KINDS)
        if action == GOES_ON:
            if kind == HEADING:
                self.section = [*self.section, text]
            return self.block, None, 0, None
        self.n += 1
        self.block, above = self.n, self.section
        if kind == HEADING:
            self.section = [text]
        return self.n, KINDS[kind], level, above


class Stretch:
    """What a stretch of lines does to every state it may be entered in: the state it is left in, how many blocks and
    footnotes begin in it, which of these are in progress in the end (0: the one from before), and the lines of the last
    heading (with those from before, where that one goes on)."""

    def __init__(self):
        self.state = np.arange(STATES, dtype=np.int32)
        self.n, self.block, self.note = (np.zeros(STATES, np.int32) for _ in range(3))
        self.head = np.full(STATES, -1, np.int32)
        self.heads: list[tuple[bool, list[str]]] = []

    def take(self, letter: int, text: str) -> None:
        following, actions = transitions(letter)
        action, self.state = actions[self.state], following[self.state]
        begins, notes = action == BEGINS, action == NOTE_BEGINS
        self.n += begins | notes
        self.block, self.note = np.where(begins, self.n, self.block), np.where(notes, self.n, self.note)
        heading = self.state // 8 % len(KINDS) == HEADING
        if (begins & heading).any():
            self.heads.append((False, [text]))
            self.head[begins & heading] = len(self.heads) - 1
        going = heading & (action == GOES_ON)
        for k in np.unique(self.head[going]).tolist():
            if k < 0:
                self.heads.append((True, [text]))
                self.head[going & (self.head == k)] = len(self.heads) - 1
            elif (going == (self.head == k))[self.head == k].all():
                self.heads[k][1].append(text)
            else:
                self.heads.append((self.heads[k][0], [*self.heads[k][1], text]))
                self.head[going & (self.head == k)] = len(self.heads) - 1

    def packed(self) -> tuple[bytes, list[bool], list[list[str]]]:
        used, self.head = np.unique(self.head, return_inverse=True)
        chosen = [(True, []) if k < 0 else self.heads[k] for k in used.tolist()]
        return np.stack([self.state, self.n, self.block, self.note, self.head.reshape(-1).astype(np.int32)]).astype("<i4").tobytes(), [x for x, _ in chosen], [x for _, x in chosen]


def after(at: Position, table: bytes, goes_on: list[bool], heads: list[list[str]]) -> Position:
    """The position behind a stretch that is entered at ``at``."""
    state, n, block, note, head = np.frombuffer(table, "<i4").reshape(5, STATES)[:, at.state].tolist()
    section = [*at.section, *heads[head]] if goes_on[head] else heads[head]
    return Position(state, at.n + n, at.n + block if block else at.block, at.n + note if note else at.note, section)


# ---- over sorted partitions; the columns come first in the order that each function names


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def summarise(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """``doc_id, stretch, letter, text``, sorted, to a row for each stretch."""
    key, current = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*key, *current.packed()), schema.types)], schema=schema)

    for doc, stretch, letter, text in _rows(batches):
        if key != (doc, stretch):
            if current is not None:
                yield row()
            key, current = (doc, stretch), Stretch()
        current.take(letter, text)
    if current is not None:
        yield row()


def carry(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """``doc_id, stretch, table, goes_on, heads``, sorted, to the position that each stretch is entered at."""
    last, at, first = None, Position(), True
    for doc, stretch, table, goes_on, heads in _rows(batches):
        if first or doc != last:
            last, at, first = doc, Position(), False
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((doc, stretch, at.state, at.n, at.block, at.note, at.section), schema.types)], schema=schema)
        at = after(at, table, goes_on, heads)


def number(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """``doc_id, stretch, line_no, page, letter, text, state, n, block, note, section`` (the last five: where the stretch is
    entered), sorted, to ``doc_id, line_no, text, block_no, type, page, level, section_parts``; a block's first line has its
    type, and its last row with ``section_parts`` those that hold."""
    key, at, first = None, Position(), True
    for batch in batches:
        out: list[list] = [[] for _ in range(8)]
        for doc, stretch, line, page, letter, text, state, n, block, note, section in zip(*(column.to_pylist() for column in batch.columns)):
            if first or key != (doc, stretch):
                key, first = (doc, stretch), False
                at = Position(state, n, block, note, section)
            number, kind, level, above = at.take(letter, text)
            made = [(doc, line, text, number, kind, page, level, above)]
            if kind is None and number == at.block < at.n and at.state // 8 % len(KINDS) == HEADING:
                # Footnotes that wait behind a heading stand below all of it, also below lines that come after them.
                made += [(doc, line, None, k, None, page, 0, at.section) for k in range(at.block + 1, at.n + 1)]
            for row in made:
                for column, x in zip(out, row):
                    column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, schema.types)], schema=schema)


pyspark.cloudpickle.register_pickle_by_value(sys.modules[__name__])
