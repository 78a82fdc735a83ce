"""Secrets in texts: fixed patterns, and values in credential contexts that would be costly to guess.

The guess cost of a value is the least sum, over all ways to cut it into words, dates, repeats, keyboard walks and
brute-force characters, of the decimal logarithms of the guesses that each part takes.
"""

from __future__ import annotations

import base64
import math
import re
import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyspark.cloudpickle
from pyspark.sql import DataFrame

# The patterns of the base spans and the least lengths of their matches.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "guess")

#: Contexts in which a value is priced; a sign or "is" stands between the name and the value, with
#: any run of blanks and tabs around a sign (possessive, so that no run is scanned again).
CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:password|passwd|passphrase|passcode|pwd|secret|token|credentials?|bearer|api[_-]?key|private[_-]?key|access[_-]?key|auth[_-]?key)"""
    r"""["'`]?(?:[\x20\t]*+(?:=>|->|:=|[:=])[\x20\t]*+|\x20is:?\x20)["'`]?([^\s"'`,;<>(){}]{4,})""", re.I | re.A)
_HINTS = ("passw", "passp", "passc", "pwd", "secret", "token", "credential", "bearer", "key")

#: Words that people put into passwords, commonest first; those of the dictionary that is given come after them.
WORDS = (
    "password 123456 qwerty admin welcome letmein monkey dragon master login princess solo starwars sunshine shadow "
    "football baseball superman batman iloveyou trustno passw0rd hello freedom whatever secret love root user test "
    "guest default changeme example token temp server system database oracle mysql postgres apple google summer winter "
    "spring autumn january february march april may june july august september october november december monday friday "
    "sunday michael jordan jessica ashley daniel charlie thomas robert hunter killer pepper ginger cookie flower orange "
    "purple yellow silver golden computer internet access service manager office company home work house money world"
).split()
_LEET = str.maketrans("@4301$57!", "aaeoissti")
#: Keys in their rows; each row is shifted to the right against the one above, so a key touches two of the next row.
_KEYS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_PLACES = {key: (row, column) for row, keys in enumerate(_KEYS) for column, key in enumerate(keys)}
_SIDES = {(0, 1): 0, (0, -1): 1, (1, 0): 2, (1, -1): 3, (-1, 0): 4, (-1, 1): 5}
_STEPS = {(a, b): side for a, (r, c) in _PLACES.items() for b, (q, d) in _PLACES.items() if (side := _SIDES.get((q - r, d - c))) is not None}
_ORDER = {(a, b): side for x, y in zip("abcdefghijklmnopqrstuvwxyz", "bcdefghijklmnopqrstuvwxyz") for side, (a, b) in enumerate(((x, y), (y, x)))}
#: A walk's guesses: a first key and direction, then a choice for each further key, straight on or with a turn.
WALKS = ((_STEPS, math.log10(47 * 6), 0.1, math.log10(6)), (_ORDER, math.log10(26 * 2), 0.1, math.inf))
_MONTH, _DAY, _MARK = "(?:0?[1-9]|1[0-2])", "(?:0?[1-9]|[12]\\d|3[01])", "[-/._]?"


def _dates(year: str) -> re.Pattern:
    """A date with a year first or last, and then month and day in either order; the same sign, or none, twice."""
    orders = ((year, _MONTH, _DAY), (_DAY, _MONTH, year), (_MONTH, _DAY, year))
    return re.compile("|".join(f"{x}(?P<s{k}>{_MARK}){y}(?P=s{k}){z}" for k, (x, y, z) in enumerate(orders)), re.A)


#: How many years a year may be, and dates with such years: with all four digits or with the last two.
_YEAR = re.compile(r"(?:19|20)\d\d", re.A)
_DATES = ((100, _dates(r"\d\d")), (120, _dates(_YEAR.pattern)))


def _char_cost(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 100)


def _lowered(value: str) -> str:
    low = value.lower()
    return low if len(low) == len(value) else "".join(c.lower() if c.isascii() else c for c in value)


def date_cost(part: str) -> float | None:
    """Of a whole string that is a date or a year: a year of 120 or, of two digits, of 100, a day of 372, and signs between
    them.  Months and days go in either order."""
    if _YEAR.fullmatch(part):
        return math.log10(120)
    for years, pattern in _DATES:
        if found := pattern.fullmatch(part):
            return math.log10(years * 372) + (0.6 if any(found.groupdict().values()) else 0)
    return None


def _repeats(value: str, i: int, known: dict[int, tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The sizes of units that stand at least twice from ``i`` on and aren't repeats themselves, and where the stretch with
    that period ends.  ``known`` remembers stretches; calls go from left to right."""
    n, size = len(value), 1
    while i + 2 * size <= n:
        start, end = known.get(size, (0, 0))
        if not (start <= i and i + 2 * size <= end):
            at = value.find(value[i : i + min(size, 64)], i + size)
            if at < 0:
                return
            if at > i + size:
                size = at - i
                continue
            if not value.startswith(value[i : i + size], i + size):
                size += 1
                continue
            end = i + 2 * size
            while end < n and value[end] == value[end - size]:
                end += 1
            known[size] = (i, end)
        unit = value[i : i + size]
        if (unit + unit).find(unit, 1) < size:
            size += 1
            continue
        yield size, end
        size = max(size, end - i - size) + 1  # shorter ones would have this period too: repeats, or not standing twice


class Guesser:
    """Prices values by the least sum of the decimal logarithms of guesses over all their segmentations.

    Parts are single characters, words (in any case and with signs for letters), dates, walks over neighbouring keys or
    along the alphabet, and repeats of a part of any cost and length.  Costs above ``most`` are given as ``most``: what
    lies beyond it in a value isn't looked at, so long values take time in proportion to what is guessable in them."""

    def __init__(self, dictionary: Sequence[str] = (), most: float = 40.0):
        ranked = dict.fromkeys([*WORDS, *dictionary])
        self.ranks = {word: math.log10(k + 2) for k, word in enumerate(ranked)}
        self.longest = max(map(len, self.ranks))
        self.most = most

    def word_cost(self, part: str) -> float | None:
        low = _lowered(part)
        cost = self.ranks.get(low)
        if cost is None:
            cost = self.ranks.get(low.translate(_LEET))
            if cost is None:
                return None
            cost += 0.6
        caps = sum(c.isupper() for c in part)
        return cost + (0 if not caps else 0.3 if caps == len(part) or part[0].isupper() and caps == 1 else 0.3 * min(caps, len(part) - caps) + 0.3)

    def cost(self, value: str) -> float:
        return self._cost(value, {})

    def _cost(self, value: str, units: dict[str, float]) -> float:
        n, low = len(value), _lowered(value)
        best = [0.0] + [self.most] * n
        walks = [[math.inf] * (n + 1) for _ in WALKS]  # the least cost of what ends with a walk of three keys or more
        known: dict[int, tuple[int, int]] = {}
        begun: dict[tuple[int, int], int] = {}  # for a unit's size and where it stands: where a repeat that holds it begins

        def reach(j: int, cost: float) -> None:
            if cost < best[j]:
                best[j] = cost

        for i in range(n):
            for walk, (steps, start, straight, turn) in zip(walks, WALKS):
                if i >= 2 and (side := steps.get((low[i - 1], low[i]))) is not None and (last := steps.get((low[i - 2], low[i - 1]))) is not None:
                    walk[i + 1] = min(walk[i], best[i - 2] + start) + (straight if side == last else turn)
                    reach(i + 1, walk[i + 1])
            if best[i] >= self.most:
                continue
            reach(i + 1, best[i] + _char_cost(value[i]))
            for size in range(3, min(self.longest, n - i) + 1):
                if (cost := self.word_cost(value[i : i + size])) is not None:
                    reach(i + size, best[i] + cost)
            if value[i].isdigit():
                for size in range(4, 11):
                    if i + size <= n and (cost := date_cost(value[i : i + size])) is not None:
                        reach(i + size, best[i] + cost)
            for size, end in _repeats(value, i, known):
                first = begun.get((size, i), i)
                if first < i and best[i] >= best[first] + math.log10(((i - first) // size + 2) / 2):
                    continue  # to go on with that repeat is as good
                unit = value[i : i + size]
                if unit not in units:
                    units[unit] = _char_cost(unit) if size == 1 else self._cost(unit, units)
                for times in range(2, (end - i) // size + 1):
                    reach(i + size * times, best[i] + units[unit] + math.log10(times))
                    begun.setdefault((size, i + size * (times - 1)), i)
        return min(best[n], self.most)


def spans(text: str, min_cost: float, guesser: Guesser) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, cost) by start and then kind; positions in code points."""
    found: list[tuple[int, int, int, float | None]] = []
    low = text.lower()
    if any(hint in low for hint in _HINTS):
        values: dict[tuple[int, int], float] = {}
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= ASSIGN_LEAST:
                found.append((m.start(), m.end(), 0, None))
                values[m.span(2)] = 0.0
        for m in CONTEXT.finditer(text):
            values.setdefault((m.start(1), m.start(1) + len(m[1].rstrip(".!?:"))), 0.0)
        for start, end in values:
            cost = guesser.cost(text[start:end])
            if cost >= min_cost:
                found.append((start, end, 3, cost))
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1, None) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2, None) for m in HEX.finditer(text)]
    return [(KINDS[kind], start, end, cost) for start, end, kind, cost in sorted(found, key=lambda x: (x[0], x[2], x[1]))]


def vocabulary(ranks: bytes) -> list[str]:
    """The words of a rank file, commonest first: entries of three or more ASCII letters that begin with a blank."""
    found = (base64.b64decode(line.split()[0]) for line in ranks.splitlines() if line)
    return list(dict.fromkeys(word[1:].decode().lower() for word in found if re.fullmatch(rb" [A-Za-z]{3,}", word)))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_cost: float = 8.0, dictionary: Sequence[str] = (), most_cost: float = 40.0) -> DataFrame:
    """``id, spans`` for each row, spans being an array of (kind, start, stop, cost) by start and then kind.

    Kinds ``assign``, ``access`` and ``hex`` are the fixed patterns, found from left to right without overlaps in each
    kind.  Kind ``guess`` is a value in a credential context (those of ``assign`` among them) whose guess cost is at
    least ``min_cost``; costs above ``most_cost`` are given as ``most_cost``.  ``dictionary``: words, commonest first, of
    fixed size, sent along with the task.  A null or empty text has no spans; each row is looked at alone, so repeated
    rows give repeated results; ids may be null; other columns aren't looked at; an empty table gives an empty one.
    Whole texts are scanned in one pass without a shuffle.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("cost", pa.float64())]))
    sent = docs.sparkSession.sparkContext.broadcast(list(dictionary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guesser = Guesser(sent.value, most_cost)
        for batch in batches:
            rows = [[dict(zip(("kind", "start", "stop", "cost"), x)) for x in spans(text or "", min_cost, guesser)] for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], [id_col, "spans"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, spans array<struct<kind: string, start: int, stop: int, cost: double>>")


pyspark.cloudpickle.register_pickle_by_value(sys.modules[__name__])
