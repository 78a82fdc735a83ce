"""Checks of translations against their sources: what got lost, style, and terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as T
from tessera.operators import glossary as G
from tessera.operators.lists import first_few
from tessera.sources.shared import joined

# What must stay as it is, and rules of style.
NUMBER = r"(?U)(?<![\w.])[-+]?\d+(?:[.,]\d+)*(?:[eE][-+]?\d+)?%?"
CITATION = r"\[\d+(?:\s*[,–\-]\s*\d+)*\]"
AUTHOR_YEAR = r"(?U)\b([A-Z][A-Za-z'\-]+)(?: et al\.?| and [A-Z][A-Za-z'\-]+)?(?:,\s*|\s+\()(\d{4}[a-z]?)\b"
NO_AUTHORS = ("In", "The", "Table", "Figure", "Section")
VERBATIM = {"formula": r"\$[^$\n]{1,200}\$", "code": r"`[^`\n]{1,200}`", "url": r"https?://[^\s)\]>]+"}
ENGLISH = r"(?iU)(?<!\w)(?:the|and|of|to|is|are|with|that|this|which|we|our|from)(?!\w)"
STYLE = {
    "calque": r"(?iU)(?<!\w)một cách(?!\w)",
    "passive": r"(?iU)(?<!\w)được(?!\w)[^.;:!?\n]{1,60}?(?<!\w)bởi(?!\w)",
    "pronoun": r"(?U)(?:^|[.!?]\s+)Nó(?!\w)",
    "article": r"(?iU)(?<!\w)(?:cái|chiếc) (?:mô hình|phương pháp|thuật toán)",
}
NOMINAL = r"(?iU)(?<!\w)(?:việc|sự)(?!\w)"
WE, WE_ALL = r"(?iU)(?<!\w)we(?!\w)", r"(?iU)(?<!\w)chúng ta(?!\w)"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def missing_numbers(source: Column, target: Column) -> Column:
    """Numbers of the source, sorted, that the target has neither as such nor with the same digits; single digits, which
    may become words, don't count."""
    there = F.transform(_all(target, NUMBER), T.number_key)
    lost = F.filter(_all(source, NUMBER), lambda x: (F.char_length(T.number_key(x)) >= 2) & ~F.array_contains(there, T.number_key(x)) & ~F.contains(target, x))
    return F.array_sort(F.array_distinct(lost))


def lost_citations(source: Column, target: Column) -> Column:
    squeezed = lambda x: F.regexp_replace(x, r"(?U)\s+", "")
    return F.array_distinct(F.filter(_all(source, CITATION), lambda x: ~F.contains(squeezed(target), squeezed(x))))


def lost_author_years(source: Column, target: Column) -> Column:
    pairs = F.arrays_zip(_all(source, AUTHOR_YEAR, 1).alias("name"), _all(source, AUTHOR_YEAR, 2).alias("year"))
    lost = F.filter(pairs, lambda p: ~p["name"].isin(*NO_AUTHORS) & ~(F.contains(target, p["name"]) & F.contains(target, p["year"])))
    return F.array_distinct(F.transform(lost, lambda p: F.concat_ws(" ", p["name"], p["year"])))


def lost_verbatim(source: Column, target: Column, kind: str) -> Column:
    return F.array_distinct(F.filter(_all(source, VERBATIM[kind]), lambda x: ~F.contains(target, x)))


def nominal_count(target: Column) -> Column:
    return F.regexp_count(target, F.lit(NOMINAL))


def is_nominal(target: Column) -> Column:
    n = nominal_count(target)
    return (n >= 3) & (n * 30 > T.word_count(target))


def english_count(target: Column) -> Column:
    return F.regexp_count(F.regexp_replace(target, r"\([^)]*\)", ""), F.lit(ENGLISH))


def is_untranslated(target: Column) -> Column:
    n = english_count(target)
    return (n >= 3) & (n > 0.08 * T.word_count(target))


def wrong_we(source: Column, target: Column) -> Column:
    return source.rlike(WE) & target.rlike(WE_ALL)


def align(blocks: DataFrame, translations: DataFrame) -> DataFrame:
    """Blocks that need translation with the translation they have: ``source`` and ``target``.  Blocks without one, and those
    with an empty or null one, are left out; of repeated ones the greatest is taken; null ids are equal."""
    done = translations.where("text <> ''").groupBy("doc_id", F.col("block_id").alias("id")).agg(F.max("text").alias("target"))
    return joined(blocks.where(~F.col("keep")).withColumnRenamed("text", "source"), done, ["doc_id", "id"], "inner")


def _issue(level: str, code: str, detail: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), detail.alias("detail"))


def pair_issues(pairs: DataFrame, *ids: str) -> DataFrame:
    """``*ids, level, code, detail`` for what pairs of ``source`` and ``target`` show by themselves.  A pair with a null side shows
    nothing that needs both; each row is looked at alone, so repeated rows give repeated issues, and null ids stay."""
    source, target = F.col("source"), F.col("target")
    some = lambda level, code, lost: F.when(F.size(lost) > 0, _issue(level, code, F.array_join(lost, ", ")))
    when = lambda test, code, detail="": F.when(test, _issue("info", code, F.lit(detail)))
    checks = [
        some("warn", "number", missing_numbers(source, target)), some("warn", "citation", lost_citations(source, target)), some("warn", "citation", lost_author_years(source, target)),
        *[some("warn", "verbatim", lost_verbatim(source, target, kind)) for kind in VERBATIM],
        *[F.when(target.rlike(rule), _issue("info", code, F.left(F.regexp_replace(F.regexp_extract(target, rule, 0), "^[ .!?]+|[ .!?]+$", ""), F.lit(50)))) for code, rule in STYLE.items()],
        when(is_nominal(target), "nominal"), when(wrong_we(source, target), "we"), when(is_untranslated(target), "untranslated"),
    ]
    found = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return pairs.select(*ids, F.explode(found).alias("i")).select(*ids, "i.level", "i.code", "i.detail")


def term_uses(pairs: DataFrame, glossary: DataFrame, all_terms: bool = False) -> DataFrame:
    """A row for each aligned block and term of its source: the entry, ``hits`` (variants in the target by index) and
    ``english`` (whether the target has the term itself)."""
    uses = G.find_listed(pairs.withColumnRenamed("source", "text"), glossary, "doc_id", "id").join(glossary, "key")
    if not all_terms:
        uses = uses.where(~G.is_generic())
    english = G.has_term(F.col("en"), F.col("target"))
    found = joined(uses.withColumnRenamed("source", "layer"), pairs.select("doc_id", "id", "block_no", "type", "target"), ["doc_id", "id"], "inner")
    keyed = found.withColumn("target_key", T.term_key(F.col("target")))
    return keyed.withColumn("hits", G.variant_hits(F.col("vi"), F.col("target_key"))).withColumn("english", english).drop("target_key")


def term_issues(uses: DataFrame, glossary: DataFrame) -> DataFrame:
    """Terms that a translation lacks or keeps in English, first uses without the English term, and terms with several
    variants in one document.  Where the glossary has entries of the paper's own, first uses of others aren't told."""
    any_paper = not glossary.where(F.col("source") == G.PAPER).isEmpty()
    paper, none = F.col("layer") == G.PAPER, F.size("hits") == 0
    absent = uses.where(none & ~F.col("english")).select(
        "doc_id", "id", F.when(paper | F.col("en").rlike(r"\S\s+\S"), "warn").otherwise("info").alias("level"), F.lit("term").alias("code"), "en", F.array_join("vi", " | ").alias("detail"))
    kept = uses.where(none & F.col("english") & paper & ~G.only_in_names(F.col("en"), F.col("target"))).select("doc_id", "id", F.lit("warn").alias("level"), F.lit("kept-english").alias("code"), "en", F.col("vi")[0].alias("detail"))
    ranked = uses.where(~F.col("type").isin("title", "heading")).withColumn("use", F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("block_no")))
    told = (paper | F.lit(not any_paper)) & (T.term_key(F.col("vi")[0], True) != T.term_key(F.col("en"), True)) & ~F.contains(F.lower("target"), F.lower("en")) & ~none
    first = ranked.where((F.col("use") == 1) & told).select(
        "doc_id", "id", F.lit("info").alias("level"), F.lit("first-use").alias("code"), "en", F.concat(F.expr("vi[hits[0]]"), F.lit(" ("), "en", F.lit(")")).alias("detail"))
    return absent.unionByName(kept).unionByName(first).unionByName(inconsistent(uses))


def inconsistent(uses: DataFrame) -> DataFrame:
    """Terms for which a document uses more than one variant, with the first six blocks of each, by block number and id.
    No more than six blocks of a variant are ever gathered."""
    keys = ["doc_id", "key", "en", "vi", "variant"]
    each = uses.select("doc_id", "key", "en", "vi", "block_no", "id", F.explode("hits").alias("variant"))
    by_variant = first_few(each, keys, ["block_no"], F.col("id"), 6, "blocks")
    shown = F.concat(F.element_at("vi", F.col("variant") + 1), F.lit(" ("), F.array_join("blocks", ", "), F.lit(")"))
    grouped = by_variant.withColumn("shown", shown).groupBy("doc_id", "key", "en").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("variant", "shown"))).alias("v"))
    return grouped.where("n > 1").select("doc_id", F.lit(None).cast("string").alias("id"), F.lit("warn").alias("level"), F.lit("inconsistent").alias("code"), "en", F.array_join("v.shown", " vs ").alias("detail"))


def check(blocks: DataFrame, translations: DataFrame, glossary: DataFrame, conflicts: DataFrame | None = None, all_terms: bool = False) -> DataFrame:
    """All issues: ``doc_id, block, term, level, code, detail``."""
    pairs = align(blocks, translations)
    plain = pair_issues(pairs, "doc_id", "id").withColumn("en", F.lit(None).cast("string"))
    found = plain.unionByName(term_issues(term_uses(pairs, glossary, all_terms), glossary))
    if conflicts is not None:
        found = found.unionByName(conflicts.select("doc_id", F.col("block_id").alias("id"), F.lit("warn").alias("level"), F.lit("duplicate").alias("code"), F.lit(None).cast("string").alias("en"), F.concat_ws(" > ", "earlier_file", "file").alias("detail")))
    return found.select("doc_id", F.col("id").alias("block"), F.col("en").alias("term"), "level", "code", "detail")


def ordered(issues: DataFrame) -> DataFrame:
    """Warnings first, then by code and by block id as text."""
    return issues.orderBy("doc_id", F.when(F.col("level") == "warn", 0).otherwise(1), "code", F.coalesce("block", F.lit("")), "detail")


def summary(blocks: DataFrame, translations: DataFrame, issues: DataFrame) -> DataFrame:
    """A row for each document: blocks to translate, translated ones, warnings and suggestions."""
    todo = blocks.where(~F.col("keep")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("to_translate"))
    done = align(blocks, translations).groupBy("doc_id").agg(F.count(F.lit(1)).alias("translated"))
    levels = issues.groupBy("doc_id").agg(F.count_if(F.col("level") == "warn").alias("warnings"), F.count_if(F.col("level") == "info").alias("infos"))
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return todo.join(done, "doc_id", "left").join(levels, "doc_id", "left").select("doc_id", "to_translate", zero("translated"), zero("warnings"), zero("infos"))


def exit_codes(issues: DataFrame, strict: bool = True) -> DataFrame:
    """``doc_id, code``: what a check of each document with issues ends with: 1 if it is ``strict`` and there is a warning, else
    0.  Documents without issues, which have no row, end with 0; a null id is a document; no issues give no row."""
    warned = F.bool_or(F.col("level") == "warn")
    return issues.groupBy("doc_id").agg(F.when(F.lit(strict) & F.coalesce(warned, F.lit(False)), 1).otherwise(0).alias("code"))
