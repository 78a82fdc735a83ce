"""What a line is, as column expressions over a line's columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import NO_SPACE, SPACE, strip

# Section names and the patterns of headings, captions and references.
SECTIONS = (
    "abstract|introduction|background|related works?|prior work|preliminaries|methods?|methodology|approach|"
    "proposed method|models?|materials and methods|experiments?|experimental (?:setup|results|evaluation)|setup|results?|"
    "evaluation|results and discussion|discussion|analysis|conclusions?|conclusion and future work|limitations?|"
    "future work|broader impacts?|ethics statement|acknowledge?ments?|references|bibliography|literature cited|"
    "appendix(?: [a-z])?|appendices|supplementary materials?|data availability|author contributions|funding|"
    "declarations?|competing interests"
)
KNOWN = rf"(?iu)^(?:(?:\d+(?:\.\d+)*|[IVX]+|[A-Z])[.)]?\s+)?(?:{SECTIONS})\s*[.:]?$"
NUMBERED = r"^((?:\d+(?:\.\d+){0,3})|[IVX]{1,5}|[A-H])[.)]?\s+([A-Z][^\n]{1,100})$"
NUMBERING = r"^(?:\d+(?:\.\d+)*|[IVX]+|[A-H])[.)]?\s+"
DEPTH = r"^(\d+(?:\.\d+)*)"
CAPTION = (
    r"(?iu)^(Figure|Fig\.|Table|Tab\.|Algorithm|Listing|Scheme|Chart|Supplementary Figure)\s*(S?\d+[a-z]?|[IVX]+)\s*[.:|—-]"
)
REFERENCE = r"^(\[\d+\]|\d{1,3}\.\s+[A-Z]|[A-Z][A-Za-z'’\-]+,\s+(?:[A-Z]\.|[A-Z][a-z]+))"
INLINE_ABSTRACT = r"(?iu)^abstract\s*[—–:.\-]\s*\S"
TERMINAL = r"[.!?:;]$"
MATH = r"[=<>+*/^_∑∏∫√≤≥≈≠∈∀∃∂∇λθσμαβγδεπφψωΣΠ|{}→←×·]"
#: Holds for any text that has a sign of MATH; ranges are cheaper to test than lists.
MATH_GUARD = r"[=<>+*/^_|{}×·\x{3a0}-\x{3c9}\x{2190}-\x{2265}]"
NUMERIC = r"[(\[]?[-+±]?\d[\d.,%]*[)\]]?%?|[±×–-]"
EQUATION_NUMBER = r"\(\d{1,3}[a-z]?\)\s*$"
PAGE_NUMBER = r"(?iu)^(page\s*)?\d{1,4}(\s*(of|/)\s*\d{1,4})?$"


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{NO_SPACE}++"))


def is_known_section(text: Column) -> Column:
    return text.rlike(KNOWN)


def is_caption(text: Column) -> Column:
    return text.rlike(CAPTION)


def starts_reference(text: Column) -> Column:
    return text.rlike(REFERENCE)


def is_inline_abstract(text: Column) -> Column:
    return text.rlike(INLINE_ABSTRACT)


def is_terminal(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+$", "").rlike(TERMINAL)


def is_equation(text: Column) -> Column:
    """Few long words and many signs of formulas, or a formula's number at the end.  Most lines have no such sign, and
    nothing is counted in them."""
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    long_words, words, signs = count("[A-Za-z]{4,}"), count(r"(?U)\b[A-Za-z]{2,}\b"), count(MATH)
    equals = text.contains("=")
    numbered = text.rlike(EQUATION_NUMBER) & (equals | (signs >= 2)) & (long_words <= 6)
    plain = (words < 8) & ((equals & (signs >= 3) & (long_words <= 3)) | ((signs >= 5) & (long_words <= 2)))
    return F.when((F.char_length(text) <= 200) & text.rlike(MATH_GUARD), numbered | plain).otherwise(False)


def is_table_line(text: Column) -> Column:
    """Three cells set apart by wide gaps, or mostly numbers."""
    cells = F.size(F.filter(F.split(text, r"\s{2,}", -1), lambda c: strip(c) != ""))
    words, numbers = token_count(text), F.regexp_count(text, F.lit(f"(?<!{NO_SPACE})(?:{NUMERIC})(?!{NO_SPACE})"))
    wide = text.rlike(r"\s\s") & (cells >= 3) & ((numbers >= 1) | (words <= 12))
    return F.when(text.rlike(r"\s\s|\d|[±×–-]"), (words > 0) & (wide | ((words >= 3) & (numbers / F.greatest(words, F.lit(1)) >= 0.5)))).otherwise(False)


def depth(text: Column) -> Column:
    """The depth of a heading's number, 0 without one."""
    number = F.regexp_extract(text, DEPTH, 1)
    return F.when(number != "", F.size(F.split(number, r"\."))).otherwise(0)


def is_styled(body: Column) -> Column:
    """Larger than the body text, or bold and not much smaller; for lines with a place on the page."""
    size = F.coalesce("size", F.lit(0.0))
    return F.col("y0").isNotNull() & F.coalesce((F.col("bold") & (body.isNull() | (size >= body - 0.6))) | (size >= body + 0.9), F.lit(False))


def heading_level(body: Column | None = None, in_refs: Column | None = None, in_front: Column | None = None) -> Column:
    """1 to 3 for a heading, 0 for other lines.  ``body``: the size of body text; ``in_refs``, ``in_front``: whether the
    line stands in the references or before the abstract."""
    body = F.lit(None).cast("double") if body is None else body
    in_refs, in_front = (F.lit(False) if x is None else x for x in (in_refs, in_front))
    text, placed = strip(F.col("text")), F.col("y0").isNotNull()
    words, size = token_count(text), F.coalesce("size", F.lit(0.0))
    own, number = depth(text), F.regexp_extract(text, NUMBERED, 1)
    digits = number.rlike(r"^\d")
    marked = F.when(text.rlike(r"^\d+(?:\.\d+)*\.?\s"), own).otherwise(F.col("md_heading"))
    sentence = text.contains("  ") | text.rlike("[,;]$") | (text.endswith(".") & ~text.rlike(r"^\d+\.$"))
    refused = (
        (placed & ~is_styled(body)) | (~digits & (~placed | in_front)) | (~placed & (F.char_length(text) > 70))
        | (digits & (F.regexp_extract(number, r"^\d+", 0).try_cast("bigint") > 30))
    )
    large = placed & F.coalesce(size >= body * 1.15, F.lit(False)) & (words <= 12)
    bold = placed & F.col("bold") & (words <= 8) & ~is_table_line(text) & text.rlike(r"^\p{Lu}")
    return (
        F.when(F.col("md_heading") > 0, F.least(F.lit(3), marked))
        .when(F.col("footnote") | (F.char_length(text) > 110) | (words > 14), 0)
        .when(is_known_section(text), F.when(own > 0, F.least(F.lit(3), own)).otherwise(1))
        .when(in_refs | sentence, 0)
        .when((number != "") & (words <= 12), F.when(F.coalesce(refused, F.lit(False)), 0).when(digits, F.least(F.lit(3), F.size(F.split(number, r"\.")))).otherwise(1))
        .when(large, 1).when(bold, 2).otherwise(0)
    )
