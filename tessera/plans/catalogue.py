"""The catalogue of queries over the document operators, with their SQL for DuckDB.

All queries read whole tables.  Where the corpus has no such texts (citations, headings, translations), ``tessera.plans.derived``
makes them from its rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import blocks, chunks, classify, glossary, layout, progress, quality, render, whole
from tessera.plans import block_sql, derived
from tessera.sources import documents as D
from tessera.sources.shared import held

TARGET = 300
TERMS = ["of", "tion", "the and", "is the", "the", "of the", "deren", "les"]
CHUNKS = "doc_id bigint, block_no int, id string, type string, keep boolean, section string, text string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all documents."""
    return D.lines(table(spark, sf_dir, "documents"))


def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as blocks: short ones as headings."""
    kind = F.when(F.char_length("text") < 25, "heading").otherwise("paragraph")
    return corpus_lines(spark, sf_dir).select("doc_id", F.col("line_no").alias("block_no"), F.concat(F.lit("b"), F.col("line_no").cast("string")).alias("id"), kind.alias("type"), F.lit(False).alias("keep"), F.lit("").alias("section"), "text")


def by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a source as the document and a document as its page."""
    docs = table(spark, sf_dir, "documents").withColumn("both", F.struct("source", "doc_id"))
    return D.lines(docs, "both", paged=False).withColumn("page", F.col("doc_id.doc_id")).withColumn("doc_id", F.col("doc_id.source"))


def clean_lines(spark, sf_dir):
    return corpus_lines(spark, sf_dir).select("doc_id", F.col("page").cast("bigint").alias("page"), F.col("line_no").cast("bigint").alias("line_no"), "blank_before", "text")


def word_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).cast("bigint").alias("words"))


def digit_masks(spark, sf_dir):
    return corpus_lines(spark, sf_dir).groupBy(T.digit_mask(F.col("text")).alias("mask")).agg(F.count(F.lit(1)).alias("n_lines"), F.count_distinct("doc_id").alias("n_docs"))


def furniture_keys(spark, sf_dir):
    found = layout.furniture(by_source(spark, sf_dir), 0.1)
    return found.select(F.col("doc_id").alias("source"), "key", "n_pages", "pages")


def furniture_removed(spark, sf_dir):
    return layout.drop_furniture(by_source(spark, sf_dir), 0.1).select(F.col("doc_id").alias("source"), F.col("page").alias("doc_id"), F.col("line_no").cast("bigint").alias("line_no"), "text")


def line_features(spark, sf_dir):
    text = F.col("text")
    n = lambda test, name: F.count_if(test).alias(name)
    return corpus_lines(spark, sf_dir).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"), n(classify.is_equation(text), "n_equation"), n(classify.is_table_line(text), "n_table"), n(classify.is_terminal(text), "n_terminal"),
        n(classify.is_caption(text), "n_caption"), n(classify.starts_reference(text), "n_reference"))


def line_len_p85(spark, sf_dir):
    return layout.typical_length(corpus_lines(spark, sf_dir)).select("doc_id", F.col("typical").cast("bigint").alias("typical"))


def chunk_plan(spark, sf_dir):
    return chunks.plan_chunks(line_blocks(spark, sf_dir), TARGET).select("doc_id", F.col("block_no").cast("bigint").alias("block_no"), F.col("chunk_no").cast("bigint").alias("chunk_no"), F.col("words").cast("bigint").alias("words"))


def chunk_summary(spark, sf_dir):
    planned = chunks.plan_chunks(line_blocks(spark, sf_dir), TARGET)
    return chunks.summarise(planned).select("doc_id", "id", F.size("blocks").cast("bigint").alias("n_blocks"), F.col("words").cast("bigint").alias("words"), "heading")


def term_counts(spark, sf_dir):
    found = glossary.find_terms(table(spark, sf_dir, "documents"), TERMS, "doc_id")
    return found.select("doc_id", "key", "n")


def align_turns(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("source"))
    answer = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    return asked.join(answer, ["conv_id", "turn"]).select("conv_id", "turn", T.word_count(F.col("source")).cast("bigint").alias("source_words"), T.word_count(F.col("target")).cast("bigint").alias("target_words"))


def untranslated(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", quality.english_count(text).cast("bigint").alias("english"), quality.is_untranslated(text).alias("untranslated"))


def source_chunks(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Documents as blocks of their source, planned, and the labelled ones as translated."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").cast("int").alias("block_no"), F.concat(F.lit("b"), F.col("doc_id").cast("string")).alias("id"),
                                                    F.lit("paragraph").alias("type"), F.lit(False).alias("keep"), F.lit("").alias("section"), "text")
    planned = chunks.plan_chunks(docs, 4 * TARGET)
    known = table(spark, sf_dir, "labels").select("doc_id").distinct()
    done = table(spark, sf_dir, "documents").join(known, "doc_id", "left_semi").select(F.col("source").alias("doc_id"), F.concat(F.lit("b"), F.col("doc_id").cast("string")).alias("block_id"), F.lit("x").alias("text"))
    return planned, done


def progress_by_chunk(spark, sf_dir):
    found = progress.by_chunk(*source_chunks(spark, sf_dir))
    return found.select(F.col("doc_id").alias("source"), F.col("chunk_no").cast("bigint").alias("chunk_no"), "words", "need", "have", "state", F.col("n_missing").cast("bigint").alias("n_missing"))


def next_chunk(spark, sf_dir):
    found = progress.next_chunk(progress.by_chunk(*source_chunks(spark, sf_dir)))
    return found.select(F.col("doc_id").alias("source"), F.col("chunk_no").cast("bigint").alias("chunk_no"))


def progress_totals(spark, sf_dir):
    return progress.totals(progress.by_chunk(*source_chunks(spark, sf_dir))).withColumnRenamed("doc_id", "source")


def missing_blocks(spark, sf_dir):
    """The first ten untranslated blocks of each chunk."""
    found = progress.by_chunk(*source_chunks(spark, sf_dir))
    return found.select(F.col("doc_id").alias("source"), F.col("chunk_no").cast("bigint").alias("chunk_no"), F.array_join("missing", ",").alias("missing"))


def status_report(spark, sf_dir):
    """Header and next line of each source's status."""
    return progress.status(progress.by_chunk(*source_chunks(spark, sf_dir))).select(F.col("doc_id").alias("source"), "header", "next")


def sent_back(spark, sf_dir) -> DataFrame:
    """A translation of one line of each labelled document, empty for some, of lines that don't exist for others."""
    line = F.concat(F.lit("b"), (F.col("doc_id") % 9 + 1).cast("string"))
    return table(spark, sf_dir, "labels").select("doc_id", line.alias("block_id"), F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.concat(F.lit("x"), F.col("doc_id").cast("string"))).alias("text")).distinct()


def aligned_blocks(spark, sf_dir):
    """Lines with their translations."""
    return quality.align(line_blocks(spark, sf_dir), sent_back(spark, sf_dir)).select("doc_id", "id", "source", "target")


def unknown_translations(spark, sf_dir):
    return D.unknown_ids(sent_back(spark, sf_dir), line_blocks(spark, sf_dir)).select("doc_id", "block_id")


def chunk_contents(spark, sf_dir):
    """The files of all chunks."""
    blocks_ = line_blocks(spark, sf_dir).withColumns({"page": F.lit(1), "level": F.lit(2)})
    return chunks.chunk_files(chunks.plan_chunks(blocks_, TARGET)).select("doc_id", "file", "content")


def block_report(spark, sf_dir):
    """Blocks and words of the shaped documents by type."""
    return chunks.report(blocks.build_blocks(layout.drop_furniture(derived.shaped_lines(spark, sf_dir)))).select("doc_id", "type", "n", F.col("words").cast("bigint").alias("words"))


def corpus_blocks(spark, sf_dir):
    """Typed blocks of all documents."""
    return derived.shown(typed_blocks(spark, sf_dir))


def typed_blocks(spark, sf_dir) -> DataFrame:
    return blocks.build_blocks(layout.drop_furniture(corpus_lines(spark, sf_dir)))


def corpus_markdown(spark, sf_dir):
    """Markdown of all documents, labelled ones standing in for translated; rendering has no SQL."""
    found = typed_blocks(spark, sf_dir)
    done = table(spark, sf_dir, "labels").select("doc_id", F.lit("b1").alias("block_id"), F.lit("x").alias("text")).distinct()
    return render.markdown_documents(found, done, bilingual=True)


def corpus_html(spark, sf_dir):
    found = typed_blocks(spark, sf_dir)
    done = table(spark, sf_dir, "labels").select("doc_id", F.lit("b1").alias("block_id"), F.lit("x").alias("text")).distinct()
    return render.html_documents(found, done)


def whole_markdown(spark, sf_dir):
    """Whole Markdown documents with how much of them is translated, the first block of labelled ones standing in for translated."""
    docs = table(spark, sf_dir, "documents")
    done = table(spark, sf_dir, "labels").select("doc_id", F.lit("b1").alias("block_id"), F.lit("x").alias("text")).distinct()
    none = F.lit(None).cast("string")
    meta = docs.select("doc_id", "source", none.alias("title"), F.lit(1).alias("pages"), F.concat(F.lit("# "), "lang").alias("summary"), none.alias("notes"))
    return whole.files(whole.markdown_parts(held(typed_blocks(spark, sf_dir)), done, meta))


def benchmark_phrases(spark, sf_dir):
    """Terms of benchmark items, as a lookup."""
    found = glossary.find_terms(table(spark, sf_dir, "benchmark"), TERMS, "item_id")
    return found.groupBy("key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_items"))


def _words(name: str) -> str:
    return f"CAST(len(regexp_extract_all({name}, '[\\p{{L}}\\p{{N}}_]+')) AS BIGINT)"


_CLEAN = r"trim(regexp_replace(raw, '[ \t]+', ' ', 'g'))"
_LINES = rf"""
    split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
    raw AS (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS raw FROM split),
    cleaned AS (SELECT doc_id, pos, {_CLEAN} AS text FROM raw),
    marked AS (SELECT *, coalesce(lag(text = '') OVER (PARTITION BY doc_id ORDER BY pos), false) AS blank_before FROM cleaned),
    lines AS (SELECT doc_id, 1::BIGINT AS page, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS line_no, blank_before, text FROM marked WHERE text <> '')"""
_SOURCED = _LINES + r""",
    sourced AS (SELECT d.source, l.doc_id, l.line_no, l.text, trim(regexp_replace(lower(l.text), '[0-9]+', '#', 'g')) AS key,
                row_number() OVER (PARTITION BY l.doc_id ORDER BY line_no) AS up, row_number() OVER (PARTITION BY l.doc_id ORDER BY line_no DESC) AS down
                FROM lines l JOIN documents d USING (doc_id)),
    cands AS (SELECT * FROM sourced WHERE (up <= 2 OR down <= 2) AND len(regexp_extract_all(text, '\S+')) <= 10),
    pages AS (SELECT source, count(DISTINCT doc_id) AS pages FROM sourced GROUP BY source),
    keys AS (SELECT c.source, key, count(DISTINCT doc_id) AS n_pages, any_value(pages) AS pages FROM cands c JOIN pages USING (source)
             GROUP BY c.source, key HAVING count(DISTINCT doc_id) >= 2 AND count(DISTINCT doc_id) >= 0.1 * any_value(pages))"""
_PLAN = rf"""
    items AS (SELECT doc_id, line_no AS n, text, {_words('text')} AS w, length(text) < 25 AS head FROM lines),
    plan AS (
        SELECT doc_id, n, 1::BIGINT AS chunk_no, w AS held FROM items WHERE n = 1
        UNION ALL
        SELECT i.doc_id, i.n, CASE WHEN (i.head AND p.held >= {TARGET / 2}) OR p.held + i.w > {1.25 * TARGET} THEN p.chunk_no + 1 ELSE p.chunk_no END,
               CASE WHEN (i.head AND p.held >= {TARGET / 2}) OR p.held + i.w > {1.25 * TARGET} THEN i.w ELSE p.held + i.w END
        FROM plan p JOIN items i ON i.doc_id = p.doc_id AND i.n = p.n + 1)"""
_PROGRESS = rf"""
    items AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, {_words("coalesce(text, '')")} AS w FROM documents),
    plan AS (
        SELECT source, doc_id, n, 1::BIGINT AS chunk_no, w, w AS held FROM items WHERE n = 1
        UNION ALL
        SELECT i.source, i.doc_id, i.n, CASE WHEN p.held + i.w > {5 * TARGET} THEN p.chunk_no + 1 ELSE p.chunk_no END, i.w,
               CASE WHEN p.held + i.w > {5 * TARGET} THEN i.w ELSE p.held + i.w END
        FROM plan p JOIN items i ON i.source = p.source AND i.n = p.n + 1),
    known AS (SELECT DISTINCT doc_id FROM labels),
    chunked AS (
        SELECT source, chunk_no, CAST(sum(w) AS BIGINT) AS words, count(*) AS need, count(known.doc_id) AS have
        FROM plan LEFT JOIN known USING (doc_id) GROUP BY source, chunk_no),
    stated AS (SELECT *, CASE WHEN have = need THEN 'done' WHEN have > 0 THEN 'partial' ELSE 'todo' END AS state, need - have AS n_missing FROM chunked)"""


_SENT = "sent AS (SELECT DISTINCT doc_id, 'b' || (doc_id % 9 + 1) AS block_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'x' || doc_id END AS text FROM labels)"


def _term_sql(table_name: str, key: str) -> str:
    """Leftmost matches without overlaps: signs that aren't word characters are doubled so that neighbours can share
    one, and a match has one at either end."""
    ranked = glossary.ranked_keys(TERMS)
    pattern = lambda t: glossary.term_pattern(t).replace(r"[\s\-]+", r"(?:\s\s|--)+")
    every = "|".join(map(pattern, ranked))
    case = " ".join(f"WHEN regexp_full_match(m, '(?i){pattern(t)}') THEN '{t.lower()}'" for t in ranked)
    return rf"""
        doubled AS (SELECT {key}, regexp_replace(text, '([^\p{{L}}\p{{N}}_-])', '\1\1', 'g') AS t FROM {table_name}),
        found AS (SELECT {key}, unnest(regexp_extract_all(t, '(?i)(?:^|[^\p{{L}}\p{{N}}_-])({every})(?:[^\p{{L}}\p{{N}}_-]|$)', 1)) AS m FROM doubled),
        named AS (SELECT {key}, CASE {case} END AS key FROM found)"""


_MATHS = classify.MATH.replace("'", "''")
_LONE_WORDS = r"len(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[A-Za-z]{2,}')))"
_NUMBERS = "len(list_filter(regexp_extract_all(text, '\\S+'), lambda x: regexp_matches(x, '" + "^(" + classify.NUMERIC + ")$')))"

#: A block's Markdown.
_SHOWN = """CASE WHEN type = 'heading' THEN repeat('#', least(5, level + 1)) || ' ' || coalesce(vi, text)
                             WHEN keep AND type IN ('equation', 'table', 'code') THEN '```text' || chr(10) || coalesce(vi, text) || chr(10) || '```' WHEN keep AND vi IS NULL THEN CASE type WHEN 'reference' THEN '- ' || text ELSE replace(text, chr(10), '  ' || chr(10)) END
                             WHEN type = 'caption' THEN '*' || coalesce(vi, text || ' *(chưa dịch)*') || '*' WHEN type = 'footnote' THEN '<small>' || coalesce(vi, text || ' *(chưa dịch)*') || '</small>'
                             WHEN type = 'title' THEN '# ' || coalesce(vi, text) || CASE WHEN vi IS NULL THEN '' ELSE chr(10) || chr(10) || '*' || text || '*' END ELSE coalesce(vi, text || ' *(chưa dịch)*') END"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (clean_lines, word_counts, digit_masks, furniture_keys, furniture_removed, line_features, line_len_p85, chunk_plan, chunk_summary, term_counts, benchmark_phrases,
                            align_turns, untranslated, progress_by_chunk, next_chunk, progress_totals, missing_blocks, status_report, aligned_blocks, unknown_translations, chunk_contents, block_report, corpus_blocks, corpus_markdown, corpus_html, whole_markdown)
} | derived.QUERIES

ORACLE_SQL: dict[str, str] = {
    "clean_lines": f"WITH {_LINES} SELECT doc_id, page, line_no, blank_before, text FROM lines",
    "word_counts": f"SELECT doc_id, {_words('text')} AS words FROM documents",
    "digit_masks": rf"WITH {_LINES} SELECT trim(regexp_replace(lower(text), '[0-9]+', '#', 'g')) AS mask, count(*) AS n_lines, count(DISTINCT doc_id) AS n_docs FROM lines GROUP BY 1",
    "furniture_keys": f"WITH {_SOURCED} SELECT source, key, n_pages, pages FROM keys",
    "furniture_removed": rf"""WITH {_SOURCED},
        gone AS (SELECT DISTINCT doc_id, line_no FROM cands c WHERE (source, key) IN (SELECT (source, key) FROM keys)
                 OR regexp_matches(text, '(?i)^(page\s*)?[0-9]{{1,4}}(\s*(of|/)\s*[0-9]{{1,4}})?$'))
        SELECT source, doc_id, line_no, text FROM sourced s WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = s.doc_id AND g.line_no = s.line_no)""",
    "line_features": rf"""WITH {_LINES},
        counted AS (
            SELECT *, len(regexp_extract_all(text, '[A-Za-z]{{4,}}')) AS long_words, {_LONE_WORDS} AS words, len(regexp_extract_all(text, '{_MATHS}')) AS signs,
                   contains(text, '=') AS equals, len(regexp_extract_all(text, '\S+')) AS tokens, {_NUMBERS} AS numbers,
                   len(list_filter(regexp_split_to_array(text, '\s{{2,}}'), lambda x: trim(x) <> '')) AS cells
            FROM lines)
        SELECT doc_id, count(*) AS n_lines,
               count(*) FILTER (length(text) <= 200 AND ((regexp_matches(text, '\([0-9]{{1,3}}[a-z]?\)\s*$') AND (equals OR signs >= 2) AND long_words <= 6)
                   OR (words < 8 AND ((equals AND signs >= 3 AND long_words <= 3) OR (signs >= 5 AND long_words <= 2))))) AS n_equation,
               count(*) FILTER (tokens > 0 AND ((cells >= 3 AND (numbers >= 1 OR tokens <= 12)) OR (tokens >= 3 AND numbers / tokens >= 0.5))) AS n_table,
               count(*) FILTER (regexp_matches(text, '[.!?:;]\s*$')) AS n_terminal,
               count(*) FILTER (regexp_matches(text, '{classify.CAPTION.replace("(?iu)", "(?i)")}')) AS n_caption,
               count(*) FILTER (regexp_matches(text, '{classify.REFERENCE.replace("'", "''")}')) AS n_reference
        FROM counted GROUP BY doc_id""",
    "line_len_p85": f"WITH {_LINES} SELECT doc_id, CAST(list_sort(list(length(text)))[CAST(floor(0.85 * (count(*) - 1)) AS BIGINT) + 1] AS BIGINT) AS typical FROM lines GROUP BY doc_id",
    "chunk_plan": f"WITH RECURSIVE {_LINES}, {_PLAN} SELECT p.doc_id, p.n AS block_no, p.chunk_no, i.w AS words FROM plan p JOIN items i ON i.doc_id = p.doc_id AND i.n = p.n",
    "chunk_summary": f"""WITH RECURSIVE {_LINES}, {_PLAN}
        SELECT p.doc_id, 'chunk-' || CASE WHEN p.chunk_no > 99 THEN CAST(p.chunk_no AS VARCHAR) ELSE lpad(CAST(p.chunk_no AS VARCHAR), 2, '0') END AS id,
               count(*) AS n_blocks, CAST(sum(i.w) AS BIGINT) AS words, coalesce(min_by(i.text, i.n) FILTER (i.head), '') AS heading
        FROM plan p JOIN items i ON i.doc_id = p.doc_id AND i.n = p.n GROUP BY p.doc_id, p.chunk_no""",
    "term_counts": f"WITH {_term_sql('documents', 'doc_id')} SELECT doc_id, key, count(*) AS n FROM named GROUP BY doc_id, key",
    "benchmark_phrases": f"WITH {_term_sql('benchmark', 'item_id')} SELECT key, count(*) AS n, count(DISTINCT item_id) AS n_items FROM named GROUP BY key",
    "align_turns": f"""SELECT a.conv_id, a.turn, {_words('a.text')} AS source_words, {_words('b.text')} AS target_words
        FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'""",
    "untranslated": rf"""WITH bare AS (SELECT doc_id, text, regexp_replace(regexp_replace(text, '\([^)]*\)', '', 'g'), '([^\p{{L}}\p{{N}}_])', '\1\1', 'g') AS t FROM documents),
        counted AS (SELECT doc_id, {_words('text')} AS words, CAST(len(regexp_extract_all(t, '(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:the|and|of|to|is|are|with|that|this|which|we|our|from)(?:[^\p{{L}}\p{{N}}_]|$)')) AS BIGINT) AS english FROM bare)
        SELECT doc_id, english, english >= 3 AND english > 0.08 * words AS untranslated FROM counted""",
    "progress_by_chunk": f"WITH RECURSIVE {_PROGRESS} SELECT source, chunk_no, words, need, have, state, n_missing FROM stated",
    "next_chunk": f"WITH RECURSIVE {_PROGRESS} SELECT source, min(chunk_no) AS chunk_no FROM stated WHERE state IN ('todo', 'partial') GROUP BY source",
    "missing_blocks": f"""WITH RECURSIVE {_PROGRESS}, lacking AS (SELECT p.source, p.chunk_no, p.doc_id FROM plan p LEFT JOIN known USING (doc_id) WHERE known.doc_id IS NULL)
        SELECT s.source, s.chunk_no, coalesce(array_to_string(list('b' || l.doc_id ORDER BY l.doc_id) FILTER (l.doc_id IS NOT NULL)[1:10], ','), '') AS missing
        FROM stated s LEFT JOIN lacking l ON l.source = s.source AND l.chunk_no = s.chunk_no GROUP BY s.source, s.chunk_no""",
    "status_report": f"""WITH RECURSIVE {_PROGRESS}, summed AS (SELECT source, sum(have) AS done, sum(need) AS total, min(chunk_no) FILTER (state IN ('todo', 'partial')) AS n FROM stated GROUP BY source),
        named AS (SELECT *, CASE WHEN n < 10 THEN '0' || n ELSE CAST(n AS VARCHAR) END AS k FROM summed)
        SELECT source, 'translated blocks: ' || done || '/' || total || ' (' || CAST(round_even(100 * done / greatest(total, 1), 0) AS INTEGER) || '%)' AS header,
               CASE WHEN n IS NULL THEN 'All chunks are translated.' ELSE 'Next: translate chunks/chunk-' || k || '.en.md -> translations/chunk-' || k || '.vi.md' END AS next FROM named""",
    "progress_totals": f"""WITH RECURSIVE {_PROGRESS} SELECT source, CAST(sum(need) AS BIGINT) AS total, CAST(sum(have) AS BIGINT) AS done, CAST(sum(words) AS BIGINT) AS words_total,
        CAST(coalesce(sum(words) FILTER (state = 'done'), 0) AS BIGINT) AS words_done FROM stated GROUP BY source""",
    "corpus_markdown": f"""WITH built AS ({block_sql.blocks_sql("documents", bare=True)}), known AS (SELECT DISTINCT doc_id FROM labels),
        joint AS (SELECT b.*, CASE WHEN b.block_no = 1 AND k.doc_id IS NOT NULL THEN 'x' END AS vi FROM built b LEFT JOIN known k USING (doc_id)),
        shown AS (SELECT doc_id, block_no, {_SHOWN} || CASE WHEN vi IS NULL OR type = 'title' THEN '' WHEN type = 'heading' THEN chr(10) || chr(10) || '<sub>' || text || '</sub>'
                         WHEN NOT keep THEN chr(10) || chr(10) || '> ' || replace(text, chr(10), chr(10) || '> ') ELSE '' END AS t FROM joint)
        SELECT doc_id, trim(regexp_replace(string_agg(t, chr(10) || chr(10) ORDER BY block_no), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10)) || chr(10) AS markdown FROM shown GROUP BY doc_id""",
    "whole_markdown": f"""WITH built AS ({block_sql.blocks_sql("documents", bare=True)}), known AS (SELECT DISTINCT doc_id FROM labels),
        joint AS (SELECT b.*, CASE WHEN b.block_no = 1 AND k.doc_id IS NOT NULL THEN 'x' END AS vi FROM built b LEFT JOIN known k USING (doc_id)),
        facts AS (SELECT doc_id, count(*) FILTER (NOT keep) AS total, count(*) FILTER (NOT keep AND vi IS NOT NULL) AS done, arg_min(text, block_no) FILTER (type = 'title') AS title, arg_min(vi, block_no) FILTER (type = 'title') AS title_vi,
                         min(block_no) FILTER (type = 'title') AS title_no, arg_min(text, block_no) FILTER (type = 'authors' AND block_no <= 4) AS authors, min(block_no) FILTER (type = 'authors' AND block_no <= 4) AS authors_no FROM joint GROUP BY doc_id),
        shown AS (SELECT doc_id, block_no, {_SHOWN} || chr(10) || chr(10) AS t
                  FROM joint JOIN facts USING (doc_id) WHERE block_no <> coalesce(title_no, -1) AND block_no <> coalesce(authors_no, -1)),
        bodies AS (SELECT doc_id, string_agg(t, '' ORDER BY block_no) AS body FROM shown GROUP BY doc_id)
        SELECT d.doc_id, '# ' || coalesce(title_vi, title, source, '') || chr(10) || chr(10) || CASE WHEN title_vi IS NULL THEN '' ELSE '*' || title || '*' || chr(10) || chr(10) END
               || CASE WHEN authors IS NULL THEN '' ELSE replace(authors, chr(10), '  ' || chr(10)) || chr(10) || chr(10) END
               || '> Bản dịch tiếng Việt của `' || coalesce(source, '') || '` (' || coalesce(done, 0) || '/' || coalesce(total, 0) || ' khối đã dịch). Hãy đối chiếu bản gốc khi trích dẫn.' || chr(10) || chr(10)
               || '## Đọc nhanh' || chr(10) || chr(10) || '## ' || lang || chr(10) || chr(10) || coalesce(body, '') AS text
        FROM documents d LEFT JOIN facts USING (doc_id) LEFT JOIN bodies USING (doc_id)""",
    "aligned_blocks": f"WITH {_LINES}, {_SENT} SELECT l.doc_id, 'b' || l.line_no AS id, l.text AS source, s.text AS target FROM lines l JOIN sent s ON s.doc_id = l.doc_id AND s.block_id = 'b' || l.line_no WHERE s.text <> ''",
    "unknown_translations": f"WITH {_LINES}, {_SENT} SELECT doc_id, block_id FROM sent s WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE l.doc_id = s.doc_id AND 'b' || l.line_no = s.block_id)",
    "chunk_contents": f"""WITH RECURSIVE {_LINES}, {_PLAN},
        joint AS (SELECT p.doc_id, p.n, p.chunk_no, i.w, i.text, i.head, CASE WHEN p.chunk_no > 99 THEN CAST(p.chunk_no AS VARCHAR) ELSE lpad(CAST(p.chunk_no AS VARCHAR), 2, '0') END AS k FROM plan p JOIN items i ON i.doc_id = p.doc_id AND i.n = p.n)
        SELECT doc_id, 'chunks/chunk-' || k || '.en.md' AS file, '<!-- chunk-' || k || ' | ' || count(*) || ' blocks | ~' || CAST(sum(w) AS BIGINT) || ' words to translate | '
               || replace(left(coalesce(min_by(text, n) FILTER (head), ''), 80), '--', '-') || ' -->' || chr(10) || chr(10)
               || string_agg('<!-- b' || n || ' | ' || CASE WHEN head THEN 'heading 2' ELSE 'paragraph' END || ' | p1 -->' || chr(10) || text || chr(10), chr(10) ORDER BY n) AS content
        FROM joint GROUP BY doc_id, chunk_no, k""",
    "block_report": f"SELECT doc_id, type, count(*) AS n, CAST(sum({_words('text')}) AS BIGINT) AS words FROM ({block_sql.blocks_sql('shaped', derived.SHAPED + ',', bare=True)}) GROUP BY doc_id, type",
    "corpus_blocks": block_sql.blocks_sql("documents", bare=True),
    "paper_blocks": block_sql.blocks_sql("shaped", f"{derived.SHAPED},", bare=True),
    "headings": f"WITH {derived.SHAPED}, {block_sql.lines_sql('shaped')} SELECT doc_id, line_no, level FROM levelled WHERE level > 0",
    "shape_features": f"""WITH {derived.SHAPED}, {block_sql.lines_sql('shaped')} SELECT doc_id, count(*) AS n_lines, count(*) FILTER (equation) AS n_equation, count(*) FILTER (tabular) AS n_table, count(*) FILTER (terminal) AS n_terminal,
        count(*) FILTER (caption) AS n_caption, count(*) FILTER (reference) AS n_reference, count(*) FILTER (known) AS n_known, count(*) FILTER (inline) AS n_abstract FROM levelled GROUP BY doc_id""",
    "state_fill": f"""WITH {derived.SHAPED}, {block_sql.lines_sql('shaped')},
        turned AS (SELECT *, CASE WHEN known THEN CASE WHEN name = 'abstract' THEN 'abstract' WHEN name IN ('references', 'bibliography', 'literature cited') THEN 'refs' ELSE 'body' END END AS turn FROM levelled)
        SELECT doc_id, line_no, coalesce(last_value(turn IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no), 'start') AS state FROM turned""",
} | derived.ORACLE_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From texts to lines, word counts and planned chunks."""
    return chunk_summary(spark, sf_dir)
