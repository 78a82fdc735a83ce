"""Greedy cutting of a sequence into chunks by running weight, over sequences of any length.

A chunk is closed before a heading once it holds half of the target, before an item that would take it above five
quarters, and where references begin.  The only thing that is carried is the weight held so far (and whether the last item
was a reference), so a stretch of the sequence is a function of it.  From prefix sums, binary search gives for every item
of a stretch where the chunk that it opens ends, and pointer doubling where the chunks that follow leave the stretch; what
a weight held before the stretch decides is where the first chunk opens, a step function with few steps.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.cloudpickle


@dataclass
class Running:
    """What is carried: the weight held, the number of the chunk in progress (0 before the first item), whether the last
    item was a reference.  Weights count quarters of words, so the bounds are whole numbers."""

    half: int
    most: int
    held: int = 0
    chunk: int = 0
    referred: bool = False

    def take(self, words: int, head: bool, reference: bool) -> int:
        """The number of the item's chunk."""
        weight = 4 * words
        if not self.chunk or (head and self.held >= self.half) or self.held + weight > self.most or (reference and not self.referred):
            self.held, self.chunk = 0, self.chunk + 1
        self.held, self.referred = self.held + weight, reference
        return self.chunk


def bounds(target: int) -> tuple[int, int]:
    return 2 * target, 5 * target


class Stretch:
    """A stretch of items. ``opens``: where the chunk after the one that an item opens is opened (the length: not here)."""

    def __init__(self, words: np.ndarray, head: np.ndarray, reference: np.ndarray, target: int):
        self.half, self.most = bounds(target)
        n = self.n = len(words)
        self.before = np.concatenate([[0], np.cumsum(4 * words.astype(np.int64))])
        self.head, self.hard = head, reference & ~np.concatenate([[True], reference[:-1]])
        self.first_refers, self.refers = bool(reference[0]), bool(reference[-1])
        at, start = np.arange(n), self.before[:-1]
        full = np.maximum(np.searchsorted(self.before[1:], start + self.most, "right"), at + 1)
        heads, hards = np.append(np.flatnonzero(head), n), np.append(np.flatnonzero(self.hard), n)
        headed = np.maximum(np.searchsorted(self.before[heads[:-1]], start + self.half, "left"), np.searchsorted(heads[:-1], at, "right"))
        self.opens = np.minimum(np.minimum(full, heads[headed]), hards[np.searchsorted(hards[:-1], at, "right")])

    def steps(self) -> tuple[list[int], list[int], list[int]]:
        """The step function of the weight held before: with at least ``need`` a chunk opens at a place by which the stretch is
        left with ``held`` and ``chunks`` more; needs fall, and the first that is met holds."""
        need = np.maximum(np.minimum(self.most - self.before[1:] + 1, np.where(self.head, self.half - self.before[:-1], np.iinfo(np.int64).max)), 0)
        need[self.hard] = 0
        least = np.minimum.accumulate(need)
        record = np.flatnonzero(np.concatenate([[True], least[1:] < least[:-1]]))
        # Every item points to the opening after its own, the last one to itself; pointers and counts are doubled.
        inside = self.opens < self.n
        to, count = np.where(inside, self.opens, np.arange(self.n)), inside.astype(np.int64)
        while True:
            count, further = count + count[to], to[to]
            if np.array_equal(further, to):
                break
            to = further
        return need[record].tolist(), (self.before[-1] - self.before[to[record]]).tolist(), (1 + count[record]).tolist()

    def from_first(self) -> tuple[int, int]:
        """Held and chunks if the first item opens one."""
        at, chunks = 0, 1
        while self.opens[at] < self.n:
            at, chunks = int(self.opens[at]), chunks + 1
        return int(self.before[-1] - self.before[at]), chunks


SUMMARY = "total bigint, first_refers boolean, refers boolean, first_held bigint, first_chunks bigint, need array<bigint>, held array<bigint>, chunks array<bigint>"
ENTERED = "held0 bigint, chunk0 bigint, referred0 boolean"


def after(at: Running, row: tuple) -> Running:
    """What is carried behind a stretch, from its summary."""
    total, first_refers, refers, first_held, first_chunks, need, held, chunks = row
    if not at.chunk or (first_refers and not at.referred):
        return Running(at.half, at.most, first_held, at.chunk + first_chunks, refers)
    for k, least in enumerate(need):
        if at.held >= least:
            return Running(at.half, at.most, held[k], at.chunk + chunks[k], refers)
    return Running(at.half, at.most, at.held + total, at.chunk, refers)


def summarise(batches: Iterator[pa.RecordBatch], schema: pa.Schema, target: int) -> Iterator[pa.RecordBatch]:
    """``doc_id, stretch, words, head, reference``, sorted, to ``doc_id, stretch`` and ``SUMMARY``."""
    key, rows = None, []

    def row() -> pa.RecordBatch:
        words, head, reference = (np.array(x) for x in zip(*rows))
        made = Stretch(words, head, reference, target)
        values = (*key, int(made.before[-1]), made.first_refers, made.refers, *made.from_first(), *made.steps())
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, schema.types)], schema=schema)

    for batch in batches:
        for doc, stretch, words, head, reference in zip(*(column.to_pylist() for column in batch.columns)):
            if rows and key != (doc, stretch):
                yield row()
                rows = []
            key = (doc, stretch)
            rows.append((words, head, reference))
    if rows:
        yield row()


def carry(batches: Iterator[pa.RecordBatch], schema: pa.Schema, target: int) -> Iterator[pa.RecordBatch]:
    """``doc_id, stretch`` and ``SUMMARY``, sorted, to ``doc_id, stretch`` and ``ENTERED``."""
    last, at, first = None, Running(*bounds(target)), True
    for batch in batches:
        out = []
        for doc, stretch, *summary in zip(*(column.to_pylist() for column in batch.columns)):
            if first or doc != last:
                last, at, first = doc, Running(*bounds(target)), False
            out.append((doc, stretch, at.held, at.chunk, at.referred))
            at = after(at, summary)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), schema.types)] if out else [pa.array([], t) for t in schema.types], schema=schema)


def number(batches: Iterator[pa.RecordBatch], schema: pa.Schema, target: int) -> Iterator[pa.RecordBatch]:
    """``doc_id, stretch, words, head, reference`` and ``ENTERED``, then columns that are passed on, sorted, to these and
    ``words, chunk_no``."""
    key, at, first = None, Running(*bounds(target)), True
    for batch in batches:
        chunks = []
        for doc, stretch, words, head, reference, held, chunk, referred in zip(*(column.to_pylist() for column in batch.columns[:8])):
            if first or key != (doc, stretch):
                key, first = (doc, stretch), False
                at = Running(*bounds(target), held, chunk, referred)
            chunks.append(at.take(words, head, reference))
        yield pa.RecordBatch.from_arrays([*batch.columns[8:], batch.column(2), pa.array(chunks, pa.int32())], names=schema.names)


pyspark.cloudpickle.register_pickle_by_value(sys.modules[__name__])
