"""Byte-level BPE encoding and decoding by a monoid tree reduction.

A text is cut into halves until a piece has at most ``leaf`` code points.  Pieces are encoded one by one and two
neighbours are joined by encoding a window around the cut again.  The window grows until the tokens outside of it are
proven to be those of the joined text:

* *Text windows* end at synchronising points: places where the split pattern starts a match whatever stands around
  them (a white-space character after a character that is none, or a change between letters, digits and other signs
  away from an apostrophe).  Encoding is additive there.
* *Token windows* serve a run of one character class that is longer than any text window, which is one match of the
  pattern.  A token sequence of one match is its encoding when every two neighbouring tokens are the encoding of their
  joined bytes; if the first and the last token of the window come out as they were, no pair outside has changed.

Decoding joins the bytes of halves up the same kind of tree.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.cloudpickle
from pyspark.sql import DataFrame

_LETTER = r"A-Za-zÀ-ÖØ-öø-ſЀ-яぁ-ゖァ-ヺ一-龥가-힣"
_OTHER = r"!-/:-@\[-`{-~"
_SYNC = re.compile(
    rf"(?<=[{_LETTER}0-9{_OTHER}])(?=[ \t\n\r])|(?<=[{_LETTER}])(?=[0-9{_OTHER}])"
    rf"|(?<=[0-9])(?=[{_LETTER}{_OTHER}])|(?<=[!-&(-/:-@\[-`{{-~])(?=[{_LETTER}0-9])"
)
_RUNS = tuple(re.compile(f"[{x}]*") for x in (_LETTER, "0-9", _OTHER))


class TreeCodec:
    """Encoder and decoder of one rank file. ``leaf``: code points that are encoded at once; ``reach``: code points on
    one side of a cut after which a text window gives way to a token window."""

    def __init__(self, ranks: bytes, pattern: str, leaf: int = 1024, reach: int = 4096):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.bytes_of = dict(zip(table.values(), table))
        self.leaf, self.reach = max(1, leaf), reach

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf:
            return self.encoding.encode_ordinary(text[lo:hi])
        cut = (lo + hi) // 2
        return self._join(text, lo, cut, hi, self._encode(text, lo, cut), self._encode(text, cut, hi))

    def _join(self, text: str, lo: int, cut: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        start, end, reach = None, None, 16
        while start is None or end is None:
            if start is None:
                at = None
                for at in _SYNC.finditer(text, max(lo + 1, cut - reach), min(cut + 1, hi)):
                    pass
                start = min(at.start(), cut) if at else lo if cut - reach <= lo else None
            if end is None:
                at = _SYNC.search(text, cut, min(hi, cut + reach))
                end = at.start() if at else hi if cut + reach >= hi else None
            reach *= 2
            if reach > self.reach and (start is None or end is None):
                joined = self._join_tokens(text, lo, cut, hi, left, right)
                if joined is not None:
                    return joined
        if start == end == cut:
            return left + right
        drop, keep = len(text[start:cut].encode()), len(text[cut:end].encode())
        n, m = len(left), 0
        while drop > 0:
            n -= 1
            drop -= len(self.bytes_of[left[n]])
        while keep > 0:
            keep -= len(self.bytes_of[right[m]])
            m += 1
        assert drop == keep == 0, "a synchronising point is inside a token"
        return left[:n] + self.encoding.encode_ordinary(text[start:end]) + right[m:]

    def _join_tokens(self, text: str, lo: int, cut: int, hi: int, left: list[int], right: list[int]) -> list[int] | None:
        """The joined tokens if both sides of the cut lie in one run of a class, else None."""
        first, last = max(lo, cut - self.reach), min(hi, cut + self.reach)
        if not any(run.fullmatch(text, first, last) for run in _RUNS):
            return None
        room = (len(text[first:cut].encode()) - 16, len(text[cut:last].encode()) - 16)
        k = 8
        while k < min(len(left), len(right)):
            a, b = left[-k:], right[:k]
            x, y = b"".join(self.bytes_of[t] for t in a), b"".join(self.bytes_of[t] for t in b)
            if len(x) > room[0] or len(y) > room[1]:
                return None
            made = self.encoding._encode_single_piece(x + y)
            if made[0] == a[0] and made[-1] == b[-1]:
                return left[:-k] + made + right[k:]
            k *= 2
        return None

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 8192:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def byte_bpe(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text",
             with_ids: bool = True, leaf: int = 1024) -> DataFrame:
    """One row for each row of ``docs``: the id, ``n_tokens``, ``ids`` (if ``with_ids``), ``ids_sha256`` of the ids as
    little-endian unsigned 32-bit integers and ``decoded_sha256`` of the bytes that decoding the ids gives.

    A null text is an empty one and has no tokens; repeated rows give repeated results, a null id stays null, an empty
    table gives an empty one; no other column of ``docs`` is looked at.  ``ranks`` is the content of a rank file of
    fixed size and is broadcast.  There is no shuffle: any lost task is run again from its input split.
    """
    held = docs.sparkSession.sparkContext.broadcast(ranks)
    kind = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or TreeCodec(held.value, pattern, leaf)
            columns: tuple[list, list, list, list] = ([], [], [], [])
            for text in batch.column(1).to_pylist():
                ids = codec.encode(text or "")
                packed = np.array(ids, "<u4")
                for column, x in zip(columns, (len(ids), packed, hashlib.sha256(packed.tobytes()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest())):
                    column.append(x)
            out = [batch.column(0), pa.array(columns[0], pa.int64())]
            if with_ids:
                out.append(pa.array([x.astype("<i4") for x in columns[1]], kind))
            out += [pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())]
            yield pa.RecordBatch.from_arrays(out, names)

    names = [id_col, "n_tokens", *["ids"] * with_ids, "ids_sha256", "decoded_sha256"]
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_tokens bigint{', ids array<int>' if with_ids else ''}, ids_sha256 string, decoded_sha256 string"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


pyspark.cloudpickle.register_pickle_by_value(sys.modules[__name__])
