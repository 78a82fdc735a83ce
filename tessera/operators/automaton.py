"""Thousands of terms in one pass over a text: an Aho-Corasick automaton over letters without blanks and hyphens.

The automaton proposes; a proposal counts if it stands between the right signs and the term's own pattern fits the text as
written.  Of the terms that fit at a place the first in rank is the match, and matches don't overlap.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyspark.cloudpickle

from tessera.operators.terms import ranked_keys, term_pattern, written_forms


class Signs(dict):
    """Of a character: its lower case if that is one character, "" for a blank or hyphen, and whether it may stand inside a
    word or a hyphened one."""

    def __missing__(self, c: str) -> tuple[str, bool]:
        kind = unicodedata.category(c)
        word = c in "-‌‍" or kind[0] in "LM" or kind in ("Nd", "Nl", "Pc")
        low = c.lower()
        self[c] = ("" if c == "-" or c.isspace() else low if len(low) == 1 else c, word)
        return self[c]


def _compiled(term: str) -> re.Pattern:
    pattern = term_pattern(term)
    return re.compile(pattern.removeprefix("(?-i:").removesuffix(")") if pattern.startswith("(?-i:") else f"(?i:{pattern})")


def fits(term: str, written: str) -> bool:
    """Whether a term's pattern fits a string whose letters are those of one of its forms."""
    if term.isascii() and written.isascii() and not re.search(r"[\s-]", term + written):
        return written == term or not (term.upper() == term and term.lower() != term)
    return _compiled(term).fullmatch(written) is not None


class TermAutomaton:
    def __init__(self, terms: list[str]):
        import ahocorasick

        self.keys, self.signs, self.fits = [], Signs(), {}
        forms: dict[str, list[int]] = {}
        for rank, term in enumerate(ranked_keys(terms)):
            self.keys.append((term.lower(), _compiled(term)))
            for form in written_forms(term):
                forms.setdefault(form, []).append(rank)
        self.machine = ahocorasick.Automaton()
        for form, ranks in forms.items():
            if form:
                self.machine.add_word(form, (len(form), ranks))
        self.machine.make_automaton()
        self.any = bool(len(self.machine))

    def _fits(self, rank: int, text: str) -> bool:
        known = self.fits.get((rank, text))
        if known is None:
            if len(self.fits) > 1 << 18:
                self.fits.clear()
            known = self.fits[rank, text] = self.keys[rank][1].fullmatch(text) is not None
        return known

    def matches(self, text: str) -> list[tuple[int, int, str]]:
        """Start, end and key of each match, from left to right."""
        if not self.any or not text:
            return []
        signs = [self.signs[c] for c in text]
        places = [k for k, (low, _) in enumerate(signs) if low]
        proposed = []
        for last, (length, ranks) in self.machine.iter("".join([low for low, _ in signs if low])):
            start, end = places[last - length + 1], places[last] + 1
            if (start and signs[start - 1][1]) or (end < len(text) and signs[end][1]):
                continue
            proposed += [(start, rank, end) for rank in ranks if self._fits(rank, text[start:end])]
        found, upto = [], 0
        for start, rank, end in sorted(proposed):
            if start >= upto:
                found.append((start, end, self.keys[rank][0]))
                upto = end
        return found


def count_terms(batches: Iterator[pa.RecordBatch], schema: pa.Schema, shared) -> Iterator[pa.RecordBatch]:
    """Ids and last the text, to ids, ``key, n, first_pos``."""
    automaton = None
    for batch in batches:
        automaton = automaton or TermAutomaton(shared.value)
        rows, keys, counts, firsts = [], [], [], []
        for row, text in enumerate(batch.column(batch.num_columns - 1)):
            seen: dict[str, list[int]] = {}
            for pos, (_, _, key) in enumerate(automaton.matches(text.as_py() or "")):
                seen.setdefault(key, [0, pos])[0] += 1
            for key, (n, pos) in seen.items():
                rows.append(row)
                keys.append(key)
                counts.append(n)
                firsts.append(pos)
        picked = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([*[batch.column(k).take(picked) for k in range(batch.num_columns - 1)], pa.array(keys, pa.string()), pa.array(counts, pa.int64()), pa.array(firsts, pa.int32())], schema=schema)


pyspark.cloudpickle.register_pickle_by_value(sys.modules[__name__])
