"""Queries over texts that are derived from the tables, row by row, where the tables themselves have no such texts: lines of
all shapes, texts with citations and numbers, translations, glossaries, marked files.

Each derivation is a column expression with a twin in SQL; the queries' SQL computes from the latter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import blocks, classify, glossary, layout, progress, quality, render
from tessera.sources import documents as D


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _s(x: Column) -> Column:
    return x.cast("string")


# ---- lines of all shapes

NAMES = ("Abstract", "Introduction", "2 Methods", "References", "Conclusion", "IV. Results", "3.1 Setup", "Appendix B")


def shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text``: documents whose lines, by their place, are made headings, captions, formulas and so on."""
    doc = F.col("doc_id")

    def line(t: Column, k: Column) -> Column:
        short = lambda n: F.left(t, F.lit(n))
        at = (doc + k) % 11
        return (
            F.when((k == 0) & (doc % 3 > 0), F.concat(F.lit("A Title of "), short(14))).when((k == 1) & (doc % 3 == 2), F.concat(F.lit("and its rest "), short(9))).when((k == 2) & (doc % 3 > 0), F.concat(F.lit("Ines "), short(12)))
            .when(at == 0, F.concat(_s(doc % 40 + 1), F.lit("."), _s(k % 9 + 1), F.lit(" About "), short(25))).when(at == 1, F.concat(F.lit("Figure "), _s(k + 1), F.lit(": "), short(50)))
            .when((at == 2) & (doc % 2 == 0), F.element_at(F.array(*map(F.lit, NAMES)), ((doc + k * 3) % len(NAMES) + 1).cast("int"))).when(at == 3, F.concat(F.lit("["), _s(k + 1), F.lit("] "), short(60)))
            .when(at == 4, F.concat(F.lit("x = a * b + c / "), _s(doc % 50), F.lit(" ("), _s(k % 90), F.lit(")"))).when(at.isin(5, 6) & (doc % 4 < 2), F.concat(_s(k), F.lit(".5 "), _s(doc % 50), F.lit(" 17 ± 0.3")))
            .when((at == 7) & (doc % 5 == 0), F.concat(F.lit("Abstract: "), t)).when(at == 8, short(12)).when(at == 9, F.concat(F.lit("* "), short(30))).otherwise(t)
        )

    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), line), "\n").alias("text"))


SHAPED = f"""shaped AS (
    SELECT doc_id, array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda t, i:
        CASE WHEN i = 1 AND doc_id % 3 > 0 THEN 'A Title of ' || left(t, 14) WHEN i = 2 AND doc_id % 3 = 2 THEN 'and its rest ' || left(t, 9) WHEN i = 3 AND doc_id % 3 > 0 THEN 'Ines ' || left(t, 12)
             WHEN (doc_id + i - 1) % 11 = 0 THEN (doc_id % 40 + 1) || '.' || ((i - 1) % 9 + 1) || ' About ' || left(t, 25) WHEN (doc_id + i - 1) % 11 = 1 THEN 'Figure ' || i || ': ' || left(t, 50)
             WHEN (doc_id + i - 1) % 11 = 2 AND doc_id % 2 = 0 THEN list_extract({list(NAMES)}, CAST((doc_id + (i - 1) * 3) % {len(NAMES)} + 1 AS BIGINT))
             WHEN (doc_id + i - 1) % 11 = 3 THEN '[' || i || '] ' || left(t, 60) WHEN (doc_id + i - 1) % 11 = 4 THEN 'x = a * b + c / ' || (doc_id % 50) || ' (' || ((i - 1) % 90) || ')'
             WHEN (doc_id + i - 1) % 11 IN (5, 6) AND doc_id % 4 < 2 THEN (i - 1) || '.5 ' || (doc_id % 50) || ' 17 ± 0.3' WHEN (doc_id + i - 1) % 11 = 7 AND doc_id % 5 = 0 THEN 'Abstract: ' || t
             WHEN (doc_id + i - 1) % 11 = 8 THEN left(t, 12) WHEN (doc_id + i - 1) % 11 = 9 THEN '* ' || left(t, 30) ELSE t END), chr(10)) AS text
    FROM documents)"""


def shaped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.lines(shaped(spark, sf_dir))


def headings(spark, sf_dir):
    """The headings among shaped lines, and their levels."""
    level = classify.heading_level().cast("bigint")
    return shaped_lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), level.alias("level")).where("level > 0")


def state_fill(spark, sf_dir):
    """The part of the document that each shaped line stands in, by section names."""
    return blocks.states(shaped_lines(spark, sf_dir)).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "state")


def shape_features(spark, sf_dir):
    """What shaped lines look like, counted by document."""
    text = F.col("text")
    tests = {"equation": classify.is_equation(text), "table": classify.is_table_line(text), "terminal": classify.is_terminal(text), "caption": classify.is_caption(text), "reference": classify.starts_reference(text),
             "known": classify.is_known_section(text), "abstract": classify.is_inline_abstract(text)}
    return shaped_lines(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), *[F.count_if(test).alias(f"n_{name}") for name, test in tests.items()])


def shown(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.col("block_no").cast("bigint").alias("block_no"), "id", "type", F.col("page").cast("bigint").alias("page"), F.col("level").cast("bigint").alias("level"), "keep", "section", "text")


def paper_blocks(spark, sf_dir):
    """Typed blocks of the shaped documents."""
    return shown(blocks.build_blocks(layout.drop_furniture(shaped_lines(spark, sf_dir))))


# ---- pairs of a text and its translation


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text``: documents with numbers, citations, code, formulas, addresses and phrases by their id behind them."""
    d, name = F.col("doc_id"), F.concat(F.upper(F.left("lang", F.lit(1))), F.substring("lang", 2, 9))
    phrases = F.element_at(F.array(*map(F.lit, PHRASES)), (d % len(PHRASES) + 1).cast("int"))
    parts = (" [", _s(d % 9), "] and [", _s(d % 4), ", ", _s(d % 5 + 1), "] ", name, " (", _s(d % 12 + 1990), ") and ", name, " et al., ", _s(d % 3 + 2001), "b; `c", _s(d % 6), "` $x_", _s(d % 5), "$ https://example.org/", _s(d % 4),
             " at ", _s(d % 40 + 10), ",5% or ", _s(d % 6 + 1), "e-4", phrases)
    return table(spark, sf_dir, "documents").where("text is not null and lang is not null").select("doc_id", F.concat("text", *[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("text"))


PHRASES = (" một cách tốt", " we see. Nó đi", " được đo bởi ai", " cái mô hình", " we say chúng ta", " việc này, sự kia và việc ấy", " of the and to is are", "")
_MARKED = f"""marked AS (
    SELECT doc_id, text || ' [' || (doc_id % 9) || '] and [' || (doc_id % 4) || ', ' || (doc_id % 5 + 1) || '] ' || name || ' (' || (doc_id % 12 + 1990) || ') and ' || name || ' et al., ' || (doc_id % 3 + 2001) || 'b; `c' || (doc_id % 6)
           || '` $x_' || (doc_id % 5) || '$ https://example.org/' || (doc_id % 4) || ' at ' || (doc_id % 40 + 10) || ',5% or ' || (doc_id % 6 + 1) || 'e-4' || list_extract({list(PHRASES)}, CAST(doc_id % {len(PHRASES)} + 1 AS BIGINT)) AS text
    FROM (SELECT *, upper(left(lang, 1)) || substr(lang, 2, 9) AS name FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL)),
    pairs AS (SELECT a.doc_id, a.text AS source, b.text AS target FROM marked a JOIN marked b ON b.doc_id = a.doc_id + 1)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each marked document as ``source`` and the next as its ``target``."""
    texts = marked(spark, sf_dir)
    return texts.withColumnRenamed("text", "source").join(texts.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("target")), "doc_id")


def _joined(lost: Column) -> Column:
    return F.array_join(F.array_sort(lost), " ")


def missing_numbers(spark, sf_dir):
    return pairs(spark, sf_dir).select("doc_id", _joined(quality.missing_numbers(F.col("source"), F.col("target"))).alias("lost"))


def lost_citations(spark, sf_dir):
    s, t = F.col("source"), F.col("target")
    return pairs(spark, sf_dir).select("doc_id", _joined(quality.lost_citations(s, t)).alias("brackets"), _joined(quality.lost_author_years(s, t)).alias("authors"))


def verbatim_loss(spark, sf_dir):
    s, t = F.col("source"), F.col("target")
    return pairs(spark, sf_dir).select("doc_id", *[_joined(quality.lost_verbatim(s, t, kind)).alias(kind) for kind in quality.VERBATIM])


def style_hits(spark, sf_dir):
    t = F.col("target")
    return pairs(spark, sf_dir).select("doc_id", *[t.rlike(rule).alias(code) for code, rule in quality.STYLE.items()], quality.nominal_count(t).cast("bigint").alias("nominal"), quality.wrong_we(F.col("source"), t).alias("we"), quality.is_untranslated(t).alias("untranslated"))


def issue_report(spark, sf_dir):
    """How many issues of each code all pairs have."""
    return quality.pair_issues(pairs(spark, sf_dir), "doc_id").groupBy("level", "code").agg(F.count(F.lit(1)).alias("n"))


_NUMBER = r"(?:^|[^\p{L}\p{N}_.])([-+]?[0-9]+(?:[.,][0-9]+)*(?:[eE][-+]?[0-9]+)?%?)"
_WORD_END, _WORD_START = r"($|[^\p{L}\p{N}_])", r"(^|[^\p{L}\p{N}_])"


def _key(x: str) -> str:
    low = f"regexp_replace(lower({x}), '%+$', '')"
    return f"(regexp_replace(split_part({low}, 'e', 1), '[^0-9]', '', 'g') || CASE WHEN split_part({low}, 'e', 2) <> '' THEN 'e' || regexp_replace(split_part({low}, 'e', 2), '^[+]+', '') ELSE '' END)"


def _lost(found: str, test: str) -> str:
    return f"array_to_string(list_sort(list_distinct(list_filter({found}, lambda x: {test}))), ' ')"


_CITED = r"regexp_extract_all(source, '\[[0-9]+(?:\s*[,–-]\s*[0-9]+)*\]')"
_AUTHOR = quality.AUTHOR_YEAR.removeprefix("(?U)").replace("'", "''").replace(r"\d", "[0-9]")
_CHECKS = rf"""checked AS (
    SELECT doc_id, source, target,
           {_lost(f"regexp_extract_all(source, '{_NUMBER}', 1)", f"length({_key('x')}) >= 2 AND NOT contains(target, x) AND NOT list_contains(list_transform(regexp_extract_all(target, '{_NUMBER}', 1), lambda y: {_key('y')}), {_key('x')})")} AS lost,
           {_lost(_CITED, "NOT contains(regexp_replace(target, '[ \t\n\r]+', '', 'g'), regexp_replace(x, '[ \t\n\r]+', '', 'g'))")} AS brackets,
           {_lost(f"list_transform(list_zip(regexp_extract_all(source, '{_AUTHOR}', 1), regexp_extract_all(source, '{_AUTHOR}', 2)), lambda p: p[1] || ' ' || p[2])",
                  f"NOT list_contains({list(quality.NO_AUTHORS)}, split_part(x, ' ', 1)) AND NOT (contains(target, split_part(x, ' ', 1)) AND contains(target, split_part(x, ' ', 2)))")} AS authors,
           {_lost(r"regexp_extract_all(source, '\$[^$\n]{1,200}\$')", "NOT contains(target, x)")} AS formula, {_lost(r"regexp_extract_all(source, '`[^`\n]{1,200}`')", "NOT contains(target, x)")} AS code,
           {_lost(r"regexp_extract_all(source, 'https?://[^\s)\]>]+')", "NOT contains(target, x)")} AS url,
           regexp_matches(target, '(?i){_WORD_START}một cách{_WORD_END}') AS calque,
           regexp_matches(target, '(?i){_WORD_START}được[^\p{{L}}\p{{N}}_.;:!?\n](?:[^.;:!?\n]{{0,58}}[^\p{{L}}\p{{N}}_.;:!?\n])?bởi{_WORD_END}') AS passive,
           regexp_matches(target, '(?:^|[.!?]\s+)Nó{_WORD_END}') AS pronoun, regexp_matches(target, '(?i){_WORD_START}(?:cái|chiếc) (?:mô hình|phương pháp|thuật toán)') AS article,
           CAST(len(regexp_extract_all(regexp_replace(target, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g'), '(?i){_WORD_START}(?:việc|sự){_WORD_END}')) AS BIGINT) AS nominal,
           regexp_matches(source, '(?i){_WORD_START}we{_WORD_END}') AND regexp_matches(target, '(?i){_WORD_START}chúng ta{_WORD_END}') AS we,
           len(regexp_extract_all(target, '[\p{{L}}\p{{N}}_]+')) AS words,
           len(regexp_extract_all(regexp_replace(regexp_replace(target, '\([^)]*\)', '', 'g'), '([^\p{{L}}\p{{N}}_])', '\1\1', 'g'), '(?i){_WORD_START}(?:the|and|of|to|is|are|with|that|this|which|we|our|from){_WORD_END}')) AS english
    FROM pairs)"""

def strict_exits(spark, sf_dir):
    """What a strict check of each pair with issues ends with."""
    return quality.exit_codes(quality.pair_issues(pairs(spark, sf_dir), "doc_id")).select("doc_id", F.col("code").cast("bigint").alias("code"))


def text_keys(spark, sf_dir):
    """Marked texts as keys for comparing, without heading marks, and escaped."""
    text = F.col("text")
    return marked(spark, sf_dir).select("doc_id", T.term_key(text).alias("key"), T.strip_heading_marks(F.concat(F.lit("## "), text)).alias("bare"), T.escape_html(F.concat(F.lit("<a href='x'> & \""), text)).alias("escaped"))


# ---- glossaries


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glossary entries of words: those of benchmark items as the first layer, of conversations, capitalised, as the second,
    and some of them generic."""
    def words(name: str, key: str, prec: int) -> DataFrame:
        found = table(spark, sf_dir, name).where("text is not null").select(key, F.explode(F.regexp_extract_all("text", F.lit("[a-z]{5,}"), F.lit(0))).alias("word")).groupBy("word").agg(F.max(key).alias("row"))
        en = F.when(F.col("row") % 10 == 3, F.element_at(F.array(*map(F.lit, glossary.GENERIC)), (F.col("row") % len(glossary.GENERIC) + 1).cast("int"))).otherwise(F.col("word")) if prec == 0 else F.initcap("word")
        return found.select(en.alias("en"), F.array(F.left("word", F.lit(4)), F.concat("word", F.lit("x")), F.col("word")).alias("vi"), F.lit("general").alias("domain"), F.lit("").alias("note"),
                            F.lit("builtin" if prec == 0 else "paper").alias("source"), F.struct(F.col("row"), F.col("word")).alias("row"), F.lit(prec).alias("prec"))

    return words("benchmark", "item_id", 0).unionByName(words("conversations", "conv_id", 1))


_LAYERS = f"""found AS (
        SELECT 0 AS prec, word, max(item_id) AS row FROM (SELECT item_id, unnest(regexp_extract_all(text, '[a-z]{{5,}}')) AS word FROM benchmark) GROUP BY word
        UNION ALL SELECT 1, word, max(conv_id) FROM (SELECT conv_id, unnest(regexp_extract_all(text, '[a-z]{{5,}}')) AS word FROM conversations) GROUP BY word),
    layers AS (SELECT CASE WHEN prec = 1 THEN upper(left(word, 1)) || substr(word, 2) WHEN row % 10 = 3 THEN list_extract({list(glossary.GENERIC)}, CAST(row % {len(glossary.GENERIC)} + 1 AS BIGINT)) ELSE word END AS en,
                      [left(word, 4), word || 'x', word] AS vi, prec, row, word FROM found),
    merged AS (SELECT key, en, vi, CASE WHEN prec = 0 THEN 'builtin' ELSE 'paper' END AS source FROM (
        SELECT *, lower(en) AS key, row_number() OVER (PARTITION BY lower(en) ORDER BY prec DESC, row DESC, word DESC) AS n FROM layers) WHERE n = 1)"""


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glossary.merge_layers(layers(spark, sf_dir))


def glossary_merge(spark, sf_dir):
    return _merged(spark, sf_dir).select("key", "en", F.array_join("vi", "|").alias("vi"), "source")


def generic_filtered(spark, sf_dir):
    return _merged(spark, sf_dir).where(~glossary.is_generic()).select("key")


def term_search(spark, sf_dir):
    return glossary.show(_merged(spark, sf_dir), "tion").select("en")


def new_terms(spark, sf_dir):
    return glossary.new_terms(_merged(spark, sf_dir), layers(spark, sf_dir).where("source = 'paper'")).select("key", F.array_join("vi", "|").alias("vi"))


def mined_terms(spark, sf_dir):
    """How often documents have the words of benchmark items, thousands of terms at once."""
    terms = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{4,}"), F.lit(0))).alias("en")).distinct()
    return glossary.find_listed(table(spark, sf_dir, "documents"), terms, "doc_id").select("doc_id", "key", "n")


def term_lookup(spark, sf_dir):
    """The entries of the glossary that each benchmark item has."""
    return glossary.lookup(table(spark, sf_dir, "benchmark"), _merged(spark, sf_dir), "item_id").select("item_id", "key", "n")


def panel_entries(spark, sf_dir):
    """Entries for a page's panel of terms, by how often benchmark items have them."""
    merged = _merged(spark, sf_dir)
    found = glossary.find_listed(table(spark, sf_dir, "benchmark"), merged, "item_id")
    return progress.panel_terms(found, merged).select("key", "en", F.col("count").cast("bigint").alias("n"))


def glossary_export(spark, sf_dir):
    return glossary.export(_merged(spark, sf_dir))


def glossary_table(spark, sf_dir):
    return glossary.as_table(_merged(spark, sf_dir))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of users as sources and the answers as targets."""
    said = table(spark, sf_dir, "conversations")
    asked = said.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("source"))
    answer = said.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    kind = F.when(F.col("turn") % 5 == 4, "heading").otherwise("paragraph")
    return asked.join(answer, ["conv_id", "turn"]).select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("b"), "turn").alias("id"), F.col("turn").cast("int").alias("block_no"), kind.alias("type"), "source", "target")


def _uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.term_uses(turns(spark, sf_dir), _merged(spark, sf_dir))


def term_uses(spark, sf_dir):
    """Terms of questions, and which of their variants the answers have."""
    return _uses(spark, sf_dir).select("doc_id", "id", "key", "n", F.array_join(F.col("hits").cast("array<string>"), ",").alias("hits"), "english")


def inconsistent_terms(spark, sf_dir):
    return quality.inconsistent(_uses(spark, sf_dir)).select("doc_id", "en", "detail")


_TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{M}}\p{{N}}_-]+')"
#: A term of lower-case ASCII letters, and its plurals; of terms that a token may be, the longest.
_FORMS = "SELECT key, unnest(CASE WHEN regexp_matches(en, '^[a-z]+$') THEN CASE WHEN regexp_matches(en, '[^aeiou]y$') THEN [key, left(key, length(key) - 1) || 'ies'] WHEN regexp_matches(en, '(s|x|ch|sh)$') THEN [key, key || 'es'] ELSE [key, key || 's', key || 'es'] END ELSE [key] END) AS form, en FROM {}"
_USES = rf"""turns AS (SELECT a.conv_id AS doc_id, 'b' || a.turn AS id, a.turn AS block_no, a.text AS source, b.text AS target FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'),
    forms AS ({_FORMS.format('merged')}),
    tokens AS (SELECT doc_id, id, pos, token FROM (SELECT doc_id, id, unnest(range(len(t))) AS pos, unnest(t) AS token FROM (SELECT doc_id, id, {_TOKENS.format('source')} AS t FROM turns))),
    named AS (SELECT doc_id, id, key FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, id, pos ORDER BY length(en) DESC, key) AS n FROM tokens JOIN forms ON token = form) WHERE n = 1),
    counted AS (SELECT doc_id, id, key, count(*) AS n FROM named GROUP BY ALL),
    uses AS (SELECT doc_id, id, block_no, key, en, vi, n, target FROM counted JOIN merged USING (key) JOIN turns USING (doc_id, id) WHERE NOT (list_contains({list(glossary.GENERIC)}, key) AND source_layer <> 'paper')),
    hit AS (SELECT *, list_filter([0, 1, 2], lambda i: list_contains(regexp_extract_all(lower(target), '[\p{{L}}\p{{M}}\p{{N}}_]+'), vi[i + 1])) AS hits,
                   len(list_filter({_TOKENS.format('target')}, lambda w: starts_with(w, key))) > 0 AS english FROM uses)"""

# ---- files


def translation_conflicts(spark, sf_dir):
    """Turns as files of translations: three turns in a row tell of one block, the last role by name wins."""
    said = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.concat("role", F.lpad(_s(F.col("turn")), 4, "0")).alias("file"), F.concat(F.lit("b"), _s(F.floor(F.col("turn") / 3))).alias("block_id"), T.strip(F.left("text", F.lit(3))).alias("text"))
    merged, conflicts = D.merge_translations(said)
    return merged.join(conflicts.groupBy("doc_id", "block_id").agg(F.count(F.lit(1)).alias("n")), ["doc_id", "block_id"], "left").select("doc_id", "block_id", "text", "origin", F.coalesce("n", F.lit(0)).cast("bigint").alias("conflicts"))


def marked_text(spark, sf_dir):
    """Conversations as files of marked blocks, four markers in turn, with comments between."""
    entry = F.struct("turn", F.concat(F.lit("<!-- b"), _s(F.col("turn") % 4), F.lit(" | paragraph -->\n"), "text", F.lit("\n<!-- a\nnote -->\n")).alias("t"))
    files = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["t"]), "").alias("text"))
    return D.parse_marked(files.select("doc_id", F.lit("f.md").alias("file"), F.concat(F.lit("head\n"), "text").alias("text"))).select("doc_id", "block_id", "text")


def translation_json(spark, sf_dir):
    """Conversations as JSON in three shapes, by their id."""
    block = F.concat(F.lit("b"), _s(F.col("turn")))
    grouped = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(
        F.map_from_entries(F.collect_list(F.struct(block.alias("id"), F.col("text")))).alias("m"), F.collect_list(F.struct(block.alias("id"), F.col("text").alias("vi"))).alias("v"), F.collect_list(F.struct(block.alias("id"), "text")).alias("l"))
    text = F.when(F.col("doc_id") % 3 == 0, F.to_json("m")).when(F.col("doc_id") % 3 == 1, F.to_json(F.struct(F.col("v").alias("blocks")))).otherwise(F.to_json("l"))
    return D.parse_translation_json(grouped.select("doc_id", F.lit("f").alias("file"), text.alias("text"))).select("doc_id", "block_id", "text")


def html_table_shape(spark, sf_dir):
    """Orders as tables, a line for each item; some items have a cell more."""
    row = F.concat(_s(F.col("l_partkey")), F.lit("  "), _s(F.col("l_suppkey")), F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("\t"), _s(F.col("l_linenumber")))).otherwise(""))
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", row.alias("row")))), lambda x: x["row"]), "\n").alias("text"))
    return orders.select(F.col("l_orderkey").alias("order_id"), render.is_table(F.col("text")).alias("is_table"))


def dehyphenate(spark, sf_dir):
    """Documents whose long words were broken at line ends, joined again."""
    broken = F.regexp_replace(F.coalesce("text", F.lit("")), "([a-z]{3})([a-z]{5,})", "$1-\n$2")
    spaced = lambda x: F.btrim(x, F.lit(T.SPACES))
    # A function that takes a second argument would be given each line's number as well.
    lines = F.filter(F.transform(F.split(broken, "\n", -1), lambda x: spaced(x)), lambda x: x != "")
    return table(spark, sf_dir, "documents").select("doc_id", spaced(T.glue_lines(lines)).alias("text"))


def page_range_filter(spark, sf_dir):
    """Documents as pages, some ranges of them."""
    return table(spark, sf_dir, "documents").where(D.in_pages(F.col("doc_id"), "1-3,5,8-90,95-")).select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (paper_blocks, headings, state_fill, shape_features, dehyphenate, page_range_filter, missing_numbers, lost_citations, verbatim_loss, style_hits, issue_report, strict_exits, text_keys, glossary_merge, generic_filtered, term_search,
                            new_terms, mined_terms, term_lookup, panel_entries, glossary_export, glossary_table, term_uses, inconsistent_terms, translation_conflicts, marked_text, translation_json, html_table_shape)
}


def join_sql(lines: str) -> str:
    """``text.join_lines`` of a list that isn't empty."""
    keep = list(T.KEEP_HYPHEN_BEFORE)
    return rf"""trim(list_reduce({lines}, lambda x, y: CASE WHEN x = '' THEN y WHEN regexp_matches(x, '[A-Za-z]-$') AND regexp_matches(y, '^\p{{Ll}}')
        THEN CASE WHEN list_contains({keep}, regexp_extract(y, '^[a-z]+')) THEN x ELSE left(x, length(x) - 1) END || y ELSE x || ' ' || y END))"""


def _toned(text: str) -> str:
    for new, old in T.TONES.items():
        text = f"replace({text}, '{new}', '{old}')"
    return text


#: Terms of the merged glossary in benchmark items.
_FOUND = rf"""forms AS ({_FORMS.format('merged')}),
    tokens AS (SELECT item_id, unnest(range(len(t))) AS pos, unnest(t) AS token FROM (SELECT item_id, {_TOKENS.format('text')} AS t FROM benchmark)),
    named AS (SELECT item_id, key, source FROM (SELECT item_id, key, source, row_number() OVER (PARTITION BY item_id, pos ORDER BY length(en) DESC, key) AS n FROM tokens JOIN forms ON token = form JOIN merged USING (key, en)) WHERE n = 1)"""
_PAIRED = f"WITH {_MARKED}, {_CHECKS}"
_TERMS = f"WITH {_LAYERS.replace(' AS source FROM (', ' AS source_layer FROM (')}, {_USES}"

ORACLE_SQL: dict[str, str] = {
    "page_range_filter": "SELECT doc_id FROM documents WHERE doc_id IN (1, 2, 3, 5) OR doc_id BETWEEN 8 AND 90 OR doc_id >= 95",
    "dehyphenate": rf"""WITH broken AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([a-z]{{3}})([a-z]{{5,}})', '\1-' || chr(10) || '\2', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)
        SELECT doc_id, CASE WHEN len(l) = 0 THEN '' ELSE {join_sql('l')} END AS text FROM broken""",
    "missing_numbers": f"{_PAIRED} SELECT doc_id, lost FROM checked",
    "lost_citations": f"{_PAIRED} SELECT doc_id, brackets, authors FROM checked",
    "verbatim_loss": f"{_PAIRED} SELECT doc_id, formula, code, url FROM checked",
    "style_hits": f"{_PAIRED} SELECT doc_id, calque, passive, pronoun, article, nominal, we, english >= 3 AND english > 0.08 * words AS untranslated FROM checked",
    "strict_exits": f"""{_PAIRED} SELECT doc_id, CAST(CASE WHEN lost <> '' OR brackets <> '' OR authors <> '' OR formula <> '' OR code <> '' OR url <> '' THEN 1 ELSE 0 END AS BIGINT) AS code FROM checked
        WHERE lost <> '' OR brackets <> '' OR authors <> '' OR formula <> '' OR code <> '' OR url <> '' OR calque OR passive OR pronoun OR article OR (nominal >= 3 AND nominal * 30 > words) OR we OR (english >= 3 AND english > 0.08 * words)""",
    "text_keys": rf"""WITH {_MARKED} SELECT doc_id, regexp_replace(translate({_toned("lower(text)")}, '‐‑–', '---'), '[\s\p{{Z}}]+', ' ', 'g') AS key, text AS bare,
        '&lt;a href=&#x27;x&#x27;&gt; &amp; &quot;' || replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') AS escaped FROM marked""",
    "term_lookup": f"""WITH {_LAYERS}, {_FOUND} SELECT item_id, key, count(*) AS n FROM named WHERE NOT (list_contains({list(glossary.GENERIC)}, key) AND source <> 'paper') GROUP BY item_id, key""",
    "panel_entries": f"""WITH {_LAYERS}, {_FOUND}, counted AS (SELECT key, count(*) AS n FROM named GROUP BY key)
        SELECT key, en, coalesce(n, 0) AS n FROM merged LEFT JOIN counted USING (key) WHERE (n > 0 AND NOT (list_contains({list(glossary.GENERIC)}, key) AND source <> 'paper')) OR source = 'paper'""",
    "glossary_export": f"WITH {_LAYERS} SELECT en, array_to_string(vi, '|') AS vi, 'general' AS domain, '' AS note FROM merged",
    "glossary_table": f"WITH {_LAYERS} SELECT en, '| ' || en || ' | ' || vi[1] || ' | ' || array_to_string(vi[2:], ', ') || ' | general' || CASE WHEN source = 'paper' THEN ' (paper)' ELSE '' END || ' |' AS line FROM merged",
    "issue_report": f"""{_PAIRED}, told AS (
        SELECT unnest([CASE WHEN lost <> '' THEN 'warn number' END, CASE WHEN brackets <> '' THEN 'warn citation' END, CASE WHEN authors <> '' THEN 'warn citation' END, CASE WHEN formula <> '' THEN 'warn verbatim' END,
            CASE WHEN code <> '' THEN 'warn verbatim' END, CASE WHEN url <> '' THEN 'warn verbatim' END, CASE WHEN calque THEN 'info calque' END, CASE WHEN passive THEN 'info passive' END, CASE WHEN pronoun THEN 'info pronoun' END,
            CASE WHEN article THEN 'info article' END, CASE WHEN nominal >= 3 AND nominal * 30 > words THEN 'info nominal' END, CASE WHEN we THEN 'info we' END, CASE WHEN english >= 3 AND english > 0.08 * words THEN 'info untranslated' END]) AS issue FROM checked)
        SELECT split_part(issue, ' ', 1) AS level, split_part(issue, ' ', 2) AS code, count(*) AS n FROM told WHERE issue IS NOT NULL GROUP BY issue""",
    "glossary_merge": f"WITH {_LAYERS} SELECT key, en, array_to_string(vi, '|') AS vi, source FROM merged",
    "generic_filtered": f"WITH {_LAYERS} SELECT key FROM merged WHERE NOT (list_contains({list(glossary.GENERIC)}, key) AND source <> 'paper')",
    "term_search": f"WITH {_LAYERS} SELECT en FROM merged WHERE contains(lower(en), 'tion') OR len(list_filter(vi, lambda v: contains(lower(v), 'tion'))) > 0 ORDER BY lower(en) <> 'tion', length(en), en LIMIT 40",
    "new_terms": f"WITH {_LAYERS} SELECT key, vi[1] AS vi FROM merged WHERE key NOT IN (SELECT lower(en) FROM layers WHERE prec = 1)",
    "mined_terms": rf"""WITH terms AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{{4,}}')) AS en FROM benchmark), keyed AS (SELECT en, en AS key FROM terms), forms AS ({_FORMS.format('keyed')}),
        tokens AS (SELECT doc_id, unnest(range(len(t))) AS pos, unnest(t) AS token FROM (SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents)),
        named AS (SELECT doc_id, key FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY length(en) DESC, key) AS n FROM tokens JOIN forms ON token = form) WHERE n = 1)
        SELECT doc_id, key, count(*) AS n FROM named GROUP BY doc_id, key""",
    "term_uses": f"{_TERMS} SELECT doc_id, id, key, n, array_to_string(hits, ',') AS hits, english FROM hit",
    "inconsistent_terms": f"""{_TERMS}, each_variant AS (SELECT doc_id, key, en, vi, block_no, id, unnest(hits) AS variant FROM hit),
        listed AS (SELECT doc_id, key, en, variant, vi[variant + 1] || ' (' || array_to_string(list(id ORDER BY block_no)[1:6], ', ') || ')' AS shown FROM each_variant GROUP BY doc_id, key, en, vi, variant)
        SELECT doc_id, en, string_agg(shown, ' vs ' ORDER BY variant) AS detail FROM listed GROUP BY doc_id, key, en HAVING count(*) > 1""",
    "translation_conflicts": """WITH parts AS (SELECT conv_id AS doc_id, role || lpad(CAST(turn AS VARCHAR), 4, '0') AS file, 'b' || CAST(floor(turn / 3) AS BIGINT) AS block_id, trim(left(text, 3)) AS text FROM conversations),
        seen AS (SELECT *, lag(text) OVER (PARTITION BY doc_id, block_id ORDER BY file) AS earlier FROM parts WHERE text <> '')
        SELECT doc_id, block_id, arg_max(text, file) AS text, max(file) AS origin, count(*) FILTER (earlier <> text) AS conflicts FROM seen GROUP BY doc_id, block_id""",
    "marked_text": "SELECT conv_id AS doc_id, 'b' || (turn % 4) AS block_id, trim(arg_max(text, turn), ' ' || chr(10) || chr(9) || chr(13)) AS text FROM conversations GROUP BY conv_id, turn % 4",
    "translation_json": "SELECT conv_id AS doc_id, 'b' || turn AS block_id, trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS text FROM conversations",
    "html_table_shape": """WITH cells AS (SELECT l_orderkey AS order_id, 2 + CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END AS n FROM lineitem)
        SELECT order_id, count(*) >= 2 AND min(n) = max(n) AS is_table FROM cells GROUP BY order_id""",
}
