"""Terms of a glossary of any size in texts: no task or driver holds the glossary.

Strings of a text that stand between the right signs and whose letters are as many as some term's are candidates; a bitmap of
fixed size spares most that are no term's.  They meet the terms in a join by letters, go back to their text in order, and
there the first in rank at each place is the match, as in ``automaton``.
"""

from __future__ import annotations

import sys
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.automaton import Signs, fits
from tessera.operators.terms import written_forms
from tessera.sources.shared import held, in_arrow

#: Words of 64 bits in the largest bitmap, and rows that a task sends on at once.
MOST_WORDS, ROWS = 1 << 18, 1 << 14


def _forms(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(form, len(form), term, term.lower(), -len(term)) for term in batch.column(0).to_pylist() if term for form in written_forms(term) if form]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], field.type) for k, field in enumerate(schema)], schema=schema)


def candidates(text: str, signs: Signs, lengths: list[int], marks: np.ndarray) -> Iterator[tuple[int, int, str]]:
    """Start, end and letters of each string that may be a term."""
    of = [signs[c] for c in text]
    places = [k for k, (low, _) in enumerate(of) if low]
    letters = "".join([of[k][0] for k in places])
    ends = [i for i, k in enumerate(places) if k + 1 == len(of) or not of[k + 1][1]]
    for i, k in enumerate(places):
        if k and of[k - 1][1]:
            continue
        for j in ends[bisect_left(ends, i + lengths[0] - 1) : bisect_right(ends, i + lengths[-1] - 1)]:
            n = j - i + 1
            if lengths[bisect_left(lengths, n)] == n:
                form = letters[i : j + 1]
                bit = zlib.crc32(form.encode("utf-8", "surrogatepass")) % (64 * len(marks))
                if int(marks[bit // 64]) >> (bit % 64) & 1:
                    yield k, places[j] + 1, form


def _propose(batches: Iterator[pa.RecordBatch], schema: pa.Schema, shared) -> Iterator[pa.RecordBatch]:
    """Ids, a hash and last the text, to ids, the hash, ``start, stop, form, written``."""
    lengths, marks = shared.value
    signs = Signs()
    for batch in batches:
        columns = batch.columns[:-1]

        def rows(found: list[tuple]) -> pa.RecordBatch:
            picked = pa.array([r[0] for r in found], pa.int64())
            return pa.RecordBatch.from_arrays([*[c.take(picked) for c in columns], *[pa.array([r[k] for r in found], t) for k, t in ((1, pa.int32()), (2, pa.int32()), (3, pa.string()), (4, pa.string()))]], schema=schema)

        found: list[tuple] = []
        for row, value in enumerate(batch.column(batch.num_columns - 1)):
            text = value.as_py() or ""
            for start, stop, form in candidates(text, signs, lengths, marks):
                found.append((row, start, stop, form, text[start:stop]))
                if len(found) == ROWS:
                    yield rows(found)
                    found = []
        yield rows(found)


def _choose(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sorted rows of ids, a hash, ``start, rank, key, stop, term, written``, to ids, ``key, n, first_pos``.  Rows of equal
    texts with equal ids are in it as often as there are such texts, and count so."""
    n_ids = len(schema) - 3
    text = last = None
    seen: dict[str, list[int]] = {}
    pos, upto, found = 0, 0, []

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], field.type) for k, field in enumerate(schema)], schema=schema)

    for batch in batches:
        for *own, start, rank, key, stop, term, written in zip(*[c.to_pylist() for c in batch.columns]):
            if own != text:
                found += [(*text[:n_ids], k, n, first) for k, (n, first) in seen.items()] if text else []
                text, last, seen, pos, upto = own, None, {}, 0, 0
            if (start, rank, key, stop, term) == last:
                seen[key][0] += 1
            elif start >= upto and fits(term, written):
                seen.setdefault(key, [0, pos])[0] += 1
                last, upto, pos = (start, rank, key, stop, term), stop, pos + 1
        yield rows()
        found = []
    found = [(*text[:n_ids], k, n, first) for k, (n, first) in seen.items()] if text else []
    yield rows()


def _marks(forms: DataFrame, n: int) -> np.ndarray:
    """A bitmap with a bit for each form, of 16 bits a form or more up to ``64 * MOST_WORDS`` bits."""
    words = min(MOST_WORDS, 1 << max(8, (n // 4).bit_length()))
    bit = F.crc32(F.col("form").cast("binary")) % (64 * words)
    found = forms.groupBy(F.floor(bit / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (bit % 64).cast("int"))).alias("bits")).toPandas()
    marks = np.zeros(words, np.int64)
    marks[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return marks.view(np.uint64)


def by_join(texts: DataFrame, glossary: DataFrame, *ids: str, text_col: str = "text") -> DataFrame:
    """``glossary.find_terms`` for the terms in ``en`` of a glossary of any size."""
    forms = held(in_arrow(glossary.select("en").distinct(), _forms, "form string, size int, term string, key string, rank int"))
    lengths = sorted(r.size for r in forms.select("size").distinct().collect())
    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*ids).schema)
    out = f"{named}, key string, n bigint, first_pos int"
    if not lengths:
        return texts.sparkSession.createDataFrame([], out)
    shared = texts.sparkSession.sparkContext.broadcast((lengths, _marks(forms, forms.count())))
    found = in_arrow(texts.select(*ids, F.xxhash64(text_col).alias("text_hash"), F.col(text_col)), _propose, f"{named}, text_hash bigint, start int, stop int, form string, written string", shared)
    own = [*ids, "text_hash"]
    order = [*own, "start", "rank", "key", "stop", "term"]
    met = found.join(forms.drop("size"), "form").select(*order, "written").repartition(*own).sortWithinPartitions(*order)
    return in_arrow(met, _choose, out).groupBy(*ids, "key").agg(F.sum("n").alias("n"), F.min("first_pos").alias("first_pos"))


pyspark.cloudpickle.register_pickle_by_value(sys.modules[__name__])
