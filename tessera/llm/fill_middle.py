"""Fill-in-the-middle rearrangement of whole texts, cut between units such as lines.

Where a unit starts is asked of two adjacent characters, so a text can be counted in pieces: chunks that overlap by one
character count the starts that they own, independently of each other and as arrays; prefix sums over the counts tell
which chunk owns the start that a cut asks for, and only that chunk is scanned again to find its place.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyspark.cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The signs before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Whether a unit starts between two adjacent characters, given as arrays of code points.
Predicate = Callable[[np.ndarray, np.ndarray], np.ndarray]


def line_starts(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Lines, each with the line feed that ends it."""
    return before == 10


def word_starts(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Words, each with the ASCII white space before it."""
    blank = lambda x: (x == 32) | ((x >= 9) & (x <= 13))
    return blank(after) & ~blank(before)


def character_starts(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return np.ones(len(after), bool)


class Units:
    """The units of a text: how many there are (``n``), and the place where any of them starts."""

    def __init__(self, text: str, starts: Predicate = line_starts, chunk: int = 1 << 16):
        self.text, self.starts, self.chunk = text, starts, chunk
        self.seen: tuple[int, np.ndarray] | None = None
        counts = [np.count_nonzero(self._scan(k)) for k in range(-(-len(text) // chunk))]
        self.before = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        self.n = int(self.before[-1])

    def _scan(self, k: int) -> np.ndarray:
        """Which characters of chunk ``k`` start a unit; the chunk is read from one character before its own on."""
        if self.seen is None or self.seen[0] != k:
            lo = k * self.chunk
            signs = np.frombuffer(self.text[max(lo - 1, 0) : lo + self.chunk].encode("utf-32-le"), "<u4")
            found = self.starts(signs[:-1], signs[1:])
            self.seen = k, np.concatenate([[True], found]) if k == 0 else found
        return self.seen[1]

    def place(self, rank: int) -> int:
        """Where the unit of number ``rank``, from 0, starts; the text's length for ``n``."""
        if rank >= self.n:
            return len(self.text)
        k = int(np.searchsorted(self.before, rank, "right")) - 1
        return k * self.chunk + int(np.flatnonzero(self._scan(k))[rank - self.before[k]])


def draws(seed: str, key: str) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 that depend on seed and key alone."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def rearrange(text: str, key: str, seed: str, rate: int, spm: int, starts: Predicate, chunk: int) -> tuple[int, str, int | None, int | None, str]:
    units = Units(text, starts, chunk)
    one, other, chosen, kind = draws(seed, key)
    if not text or any(mark in text for mark in MARKS) or chosen % 100 >= rate:
        return units.n, "plain", None, None, text
    cuts = sorted((one % (units.n + 1), other % (units.n + 1)))
    lo, hi = map(units.place, cuts)
    prefix, middle, suffix = text[:lo], text[lo:hi], text[hi:]
    p, s, m = MARKS
    if kind % 100 < spm:
        return units.n, "spm", lo, hi - lo, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return units.n, "psm", lo, hi - lo, f"{p}{prefix}{s}{suffix}{m}{middle}"


def fill_middle(docs: DataFrame, seed: str = "7", rate: int = 100, spm: int = 50, starts: Predicate = line_starts, id_col: str = "doc_id", text_col: str = "text",
                chunk: int = 1 << 16) -> DataFrame:
    """A row for each row of ``docs``: the id, ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` (code points; null
    where the form is plain) and ``output``.

    ``rate`` of 100 rows are rearranged, ``spm`` of 100 of these with the suffix first (spm), the others with the prefix
    first (psm); both, and the two cuts, depend on ``seed`` and the id alone, so repeated ids are cut by the same draws
    and reruns agree; a null id draws like an empty one.  Texts that are null (taken as empty) or empty, or that contain
    a mark, stay plain.  An empty table gives an empty one; other columns aren't looked at.  There is no shuffle, and
    beyond a text and its output a task holds one chunk.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, keys = 0, batch.column(2)
            while lo < batch.num_rows:
                rows, length = [], 0
                while lo + len(rows) < batch.num_rows and length < 1 << 22:
                    k = lo + len(rows)
                    rows.append(rearrange(batch.column(1)[k].as_py() or "", keys[k].as_py() or "", seed, rate, spm, starts, chunk))
                    length += len(rows[-1][-1])
                columns = [pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(rows)), *columns], [id_col, "n", "form", "prefix_chars", "middle_chars", "output"])
                lo += len(rows)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col), F.col(id_col).cast("string").alias("key")).mapInArrow(
        run, f"`{id_col}` {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_middle`` made ``output`` from, exactly: rearranged texts have each mark once."""
    parts = F.split(output, "|".join(map(re.escape, MARKS)), -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


pyspark.cloudpickle.register_pickle_by_value(sys.modules[__name__])
