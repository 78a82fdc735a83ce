"""How a term may be written: patterns and forms."""

from __future__ import annotations

import re
import sys

import pyspark.cloudpickle


def _plurals(word: str) -> tuple[str, list[str]]:
    """A word without what its plural changes, and the endings of the two."""
    if not (word.isalpha() and word.islower() and len(word) > 2):
        return word, [""]
    if re.search("[^aeiou]y$", word):
        return word[:-1], ["y", "ies"]
    if re.search("(?:s|x|ch|sh)$", word):
        return word, ["", "es"]
    return word, ["", "s", "es"]


def term_pattern(term: str) -> str:
    """A regular expression for a term: any blanks or hyphens between words, a hyphen optional, plurals of a last word in
    lower case; a term in capitals alone keeps its case."""
    pieces = re.split(r"(\s+|-)", term)
    stem, endings = _plurals(pieces[-1])
    body = "".join(r"[\s\-]+" if p.isspace() else r"[\s\-]?" if p == "-" else re.escape(p) for p in (*pieces[:-1], stem))
    tail = "" if endings == [""] else f"(?:{'|'.join(endings[::-1])})" if endings[0] else f"(?:{'|'.join(endings[1:])})?"
    whole = body + tail
    return f"(?-i:{whole})" if term.upper() == term and term.lower() != term else whole


def written_forms(term: str) -> list[str]:
    """A term's singular and plural in lower case without blanks and hyphens."""
    stem, endings = _plurals(re.split(r"[\s-]+", term)[-1])
    head = term[: len(term) - len(re.split(r"[\s-]+", term)[-1])]
    return sorted({re.sub(r"[\s-]+", "", head + stem + x).lower() for x in endings})


def ranked_keys(terms: list[str]) -> list[str]:
    """Longest first, then by code point; the first alternative that fits a place is the match.  Terms of blanks and hyphens
    alone match nothing and are left out."""
    return sorted((t for t in terms if any(written_forms(t))), key=lambda t: (-len(t), t.lower()))


pyspark.cloudpickle.register_pickle_by_value(sys.modules[__name__])
