"""Text normalisation as column functions. Nulls stay null unless a function says otherwise."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Unicode has it.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
NO_SPACE = r"[^\s\x1c-\x1f\x85\p{Z}]"
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85" or unicodedata.category(c)[0] == "Z")
#: The blanks that are neither controls nor ends of lines.
SPACES = "".join(c for c in BLANKS if unicodedata.category(c) == "Zs")
WORD = r"[\p{L}\p{N}_]"
#: Holds for any sign that normal form C may change, reorder or join with the one before, and for some others; letters with
#: their marks in one sign aren't among them.
UNSETTLED = (
    r"[[^\x{0}-\x{2ff}]&&[\p{M}\p{Cn}\x{374}\x{37e}\x{387}\x{958}-\x{95f}\x{9dc}-\x{9df}\x{a33}-\x{a36}\x{a59}-\x{a5e}\x{b5c}\x{b5d}\x{f43}-\x{f69}\x{1160}-\x{11ff}\x{1f71}-\x{2001}"
    r"\x{2126}-\x{212b}\x{2329}\x{232a}\x{2adc}\x{f900}-\x{fadf}\x{fb1d}-\x{fb4f}\x{1d15e}-\x{1d1c0}\x{2f800}-\x{2fa1f}]]"
)

# Fixed values.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
DASHES_AND_BLANKS = (" ‐‑−­​", " ---")
#: Holds for any text with a sign of the two above, and for some others; ranges are cheaper to test than lists.
ODD = r"[\x{a0}\x{ad}\x{200b}-\x{2212}\x{fb00}-\x{fb06}]"
TONES = {
    "oá": "óa", "oà": "òa", "oả": "ỏa", "oã": "õa", "oạ": "ọa", "oé": "óe", "oè": "òe", "oẻ": "ỏe", "oẽ": "õe", "oẹ": "ọe",
    "uý": "úy", "uỳ": "ùy", "uỷ": "ủy", "uỹ": "ũy", "uỵ": "ụy",
}
KEEP_HYPHEN_BEFORE = (
    "tuning tuned training trained based art the of scale level time free specific aware driven order grained wise like "
    "term off up step shot supervised layer head end to world domain agnostic dependent independent invariant known "
    "defined dimensional"
).split()


def has_any(text: Column, parts: Iterable[str]) -> Column:
    """Whether any of ``parts`` occurs, by literal search."""
    return reduce(Column.__or__, [text.contains(part) for part in parts])


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


@F.arrow_udf(StringType())
def _composed(text: pa.Array) -> pa.Array:
    # Few texts at a time are Python's strings.
    few = [text.slice(at, 64) for at in range(0, len(text), 64)]
    return pa.concat_arrays([x if x.null_count == len(x) else pa.array([t and unicodedata.normalize("NFC", t) for t in x.to_pylist()], text.type) for x in few]) if few else text


def nfc(text: Column) -> Column:
    """Unicode normal form C; Spark has no expression for it.  Texts without a sign that the form may change or join are in
    it already and don't leave the JVM."""
    return F.coalesce(_composed(F.when(~is_ascii(text) & text.rlike(UNSETTLED), text)), text)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def plain_signs(text: Column) -> Column:
    """Ligatures and odd dashes and blanks made plain, runs of blanks made one; line breaks stay.  Few texts have any of
    those signs, and only they are rewritten."""
    plain = text
    for sign, letters in LIGATURES.items():
        plain = F.replace(plain, F.lit(sign), F.lit(letters))
    blanks = lambda t: F.regexp_replace(t, "[ \t]{2,}+|\t", " ")
    # Literal searches and lengths are much cheaper than patterns.
    odd = ~is_ascii(text) & text.rlike(ODD)
    return F.when(odd, blanks(F.translate(plain, *DASHES_AND_BLANKS))).when(has_any(text, ("  ", "\t")), blanks(text)).otherwise(text)


def squeeze(text: Column) -> Column:
    """``plain_signs`` with the ends stripped."""
    return strip(plain_signs(text))


def clean_text(text: Column, composed: bool = False) -> Column:
    """``squeeze`` of the composed form; ``composed``: the text is in normal form C, so no Python is needed."""
    return squeeze(text if composed else nfc(text))


def term_key(text: Column, composed: bool = False) -> Column:
    """For comparing Vietnamese: lower case, one placement of tones, one dash, one blank for any white space."""
    key = F.lower(text if composed else nfc(text))
    for new, old in TONES.items():
        key = F.replace(key, F.lit(new), F.lit(old))
    return F.regexp_replace(F.translate(key, "‐‑–", "---"), f"{SPACE}+", " ")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{WORD}+"))


def strip_heading_marks(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s*#{1,6}\s+", "")


def digit_mask(text: Column) -> Column:
    """Lines that differ in numbers alone have one mask."""
    return strip(F.regexp_replace(F.lower(text), r"\p{Nd}+", "#"))


def number_key(text: Column) -> Column:
    """Digits of the mantissa, then the exponent: separators, signs, points and a per cent sign don't tell numbers apart."""
    parts = F.split(F.regexp_replace(F.lower(text), "%+$", ""), "e", 2)
    exponent = F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"^\++", "")
    return F.concat(F.regexp_replace(parts[0], r"\P{Nd}", ""), F.when(F.get(parts, F.lit(1)) != "", F.concat(F.lit("e"), exponent)).otherwise(""))


def escape_html(text: Column, quotes: bool = True) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *([('"', "&quot;"), ("'", "&#x27;")] if quotes else [])):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def glue_lines(lines: Column) -> Column:
    """Lines as one text: a word broken at a line end is joined, with its hyphen if the next line goes on with a word that
    such compounds have; other lines are joined by a blank.  Empty lines before the first other one leave nothing, and a
    line that is null makes the text null.

    Each line is seen with the next one alone, so the time grows with the text and not with its square."""

    def ended(line: Column, after: Column) -> Column:
        broken = line.endswith("-") & F.right(line, F.lit(2)).rlike(r"[A-Za-z]-\z") & after.rlike(r"^\p{Ll}")
        compound = F.regexp_extract(after, "^[a-z]+", 0).isin(*KEEP_HYPHEN_BEFORE)
        return F.when(after.isNull(), line).when(broken, F.when(compound, line).otherwise(F.left(line, F.char_length(line) - 1))).otherwise(F.concat(line, F.lit(" ")))

    def glued(held: Column) -> Column:
        return F.array_join(F.zip_with(held, F.slice(held, 2, F.size(held)), ended), "")

    def whole(held: Column) -> Column:
        first = F.array_position(F.transform(held, lambda x: x != ""), F.lit(True))
        told = F.when(F.get(held, F.lit(0)) != "", glued(held)).when(first > 0, glued(F.slice(held, first.cast("int"), F.size(held)))).otherwise("")
        return F.when(~F.exists(held, lambda x: x.isNull()), told)

    # As an item of an array the lines are made once, however often they are read.
    return F.transform(F.array(lines), whole)[0]


def join_lines(lines: Column) -> Column:
    """Lines of a paragraph as ``glue_lines`` joins them, with the ends stripped."""
    return strip(glue_lines(lines))


def paragraphs(text: Column) -> Column:
    """The parts between blank lines, each on one line."""
    parts = F.transform(F.split(text, r"\n\s*\n", -1), lambda p: strip(F.regexp_replace(p, f"{SPACE}+", " ")))
    return F.filter(parts, lambda p: p != "")
