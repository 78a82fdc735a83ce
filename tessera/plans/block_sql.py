"""SQL for lines of texts without places, their features, and the fold of lines into blocks as a recursion by line."""

from __future__ import annotations

from tessera.operators import classify
from tessera.plans.derived import join_sql

_WORDS = r"len(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[A-Za-z]{2,}')))"
_NUMBERS = "len(list_filter(regexp_extract_all(text, '\\S+'), lambda x: regexp_matches(x, '^(" + classify.NUMERIC + ")$')))"
_KNOWN = "'" + classify.KNOWN.replace("(?iu)", "(?i)") + "'"
_NUMBERED = "'" + classify.NUMBERED + "'"
_NAME = f"lower(trim(regexp_replace(text, '{classify.NUMBERING}', ''), ' .:'))"


def lines_sql(table: str) -> str:
    """Cleaned lines of ``table(doc_id, text)`` that aren't empty, and then ``counted`` and ``featured`` ones."""
    return rf"""
    split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM {table}),
    raw AS (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS raw FROM split),
    cleaned AS (SELECT doc_id, pos, trim(regexp_replace(raw, '[ \t]+', ' ', 'g')) AS text FROM raw),
    marked_lines AS (SELECT *, coalesce(lag(text = '') OVER (PARTITION BY doc_id ORDER BY pos), false) AS blank_before FROM cleaned),
    lines AS (SELECT doc_id, 1::BIGINT AS page, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS line_no, blank_before, text FROM marked_lines WHERE text <> ''),
    counted AS (
        SELECT *, len(regexp_extract_all(text, '[A-Za-z]{{4,}}')) AS long_words, {_WORDS} AS words, len(regexp_extract_all(text, '{classify.MATH.replace("'", "''")}')) AS signs,
               contains(text, '=') AS equals, len(regexp_extract_all(text, '\S+')) AS tokens, {_NUMBERS} AS numbers, regexp_extract(text, {_NUMBERED}, 1) AS number,
               CASE WHEN regexp_matches(text, '^\d+') THEN len(string_split(regexp_extract(text, '^(\d+(?:\.\d+)*)', 1), '.')) ELSE 0 END AS own
        FROM lines),
    featured AS (
        SELECT *, length(text) <= 200 AND ((regexp_matches(text, '\([0-9]{{1,3}}[a-z]?\)\s*$') AND (equals OR signs >= 2) AND long_words <= 6)
                       OR (words < 8 AND ((equals AND signs >= 3 AND long_words <= 3) OR (signs >= 5 AND long_words <= 2)))) AS equation,
               tokens >= 3 AND numbers / tokens >= 0.5 AS tabular, regexp_matches(text, '[.!?:;]\s*$') AS terminal, regexp_matches(text, '{classify.CAPTION.replace("(?iu)", "(?i)")}') AS caption,
               regexp_matches(text, '{classify.REFERENCE.replace("'", "''")}') AS reference, regexp_matches(text, {_KNOWN}) AS known, regexp_matches(text, '{classify.INLINE_ABSTRACT.replace("(?iu)", "(?i)")}') AS inline, {_NAME} AS name
        FROM counted),
    levelled AS (
        SELECT *, CASE WHEN length(text) > 110 OR tokens > 14 THEN 0 WHEN known THEN CASE WHEN own > 0 THEN least(3, own) ELSE 1 END
                       WHEN regexp_matches(text, '[,;]$') OR (ends_with(text, '.') AND NOT regexp_matches(text, '^\d+\.$')) THEN 0
                       WHEN number <> '' AND tokens <= 12 AND regexp_matches(number, '^\d') AND length(text) <= 70 AND CAST(regexp_extract(number, '^\d+') AS BIGINT) <= 30 THEN least(3, len(string_split(number, '.')))
                       ELSE 0 END AS level
        FROM featured)"""


#: What a line does to part (0 start, 1 authors, 2 abstract, 3 abstract in a line, 4 body, 5 references) and kind of the block in progress.
_KINDS = "['', 'title', 'authors', 'abstract', 'heading', 'paragraph', 'caption', 'equation', 'table', 'reference']"


def blocks_sql(table: str, before: str = "", bare: bool = False) -> str:
    """Typed blocks of ``table(doc_id, text)``; ``bare``: without page numbers at the ends."""
    numbers = r"NOT ((up <= 2 OR down <= 2) AND tokens <= 10 AND regexp_matches(text, '(?i)^(page\s*)?[0-9]{1,4}(\s*(of|/)\s*[0-9]{1,4})?$'))" if bare else "true"
    return rf"""WITH RECURSIVE {before}{lines_sql(table)},
    placed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS up, row_number() OVER (PARTITION BY doc_id ORDER BY line_no DESC) AS down FROM levelled) WHERE {numbers}),
    typical AS (SELECT doc_id, list_sort(list(length(text)))[CAST(floor(0.85 * (count(*) - 1)) AS BIGINT) + 1] AS typical FROM placed GROUP BY doc_id),
    noted AS (
        SELECT *, max(CASE WHEN regexp_matches(text, '^[*†‡]') AND length(text) > 3 AND last <= 4 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) = 1 AS note
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no DESC) AS last, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM placed JOIN typical USING (doc_id))),
    seen AS (
        SELECT *, last_value(CASE WHEN NOT note THEN text END IGNORE NULLS) OVER ahead AS p, coalesce(bool_or(note) OVER ahead, false) AS note_before,
               coalesce(lead(tabular, 1) OVER (PARTITION BY doc_id ORDER BY k) AND lead(tabular, 2) OVER (PARTITION BY doc_id ORDER BY k), false) AND tokens <= 10 AND NOT regexp_matches(text, '[.!?:;]$') AS heads
        FROM noted WINDOW ahead AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    lettered AS (
        SELECT doc_id, k, text, page, note, note_before AND NOT regexp_matches(text, '^[*†‡]|^\d{{1,2}}\s') AS note_goes_on, NOT (known OR tokens > 25 OR ends_with(text, '.')) AS head,
               (regexp_matches(text, '^\p{{Ll}}') OR regexp_matches(text, '^(of|for|and|in|with|on|via|to|from)($|[^\p{{L}}\p{{N}}_])')) AND NOT blank_before AND tokens <= 12 AS more_title, level, CASE WHEN known THEN level ELSE 0 END AS level_in_refs, name,
               blank_before OR (p IS NOT NULL AND regexp_matches(p, '[.!?:;]\s*$') AND length(p) < 0.7 * typical) AS new, NOT (tokens >= 14 OR inline) AS front, inline, reference,
               coalesce(regexp_matches(p, '[.\]]\s*$'), false) OR starts_with(text, '[') AS closed, blank_before AS blank, caption, equation, tabular AND tokens <= 30 AS tab, p IS NOT NULL AND NOT ends_with(p, '.') AS open_caption, heads
        FROM seen),
    run AS (
        SELECT doc_id, 0::BIGINT AS k, 0 AS part, 0 AS kind, false AS waiting, 0 AS titled, 0 AS n, 0 AS block, 0 AS foot, 0 AS number, false AS begins FROM (SELECT DISTINCT doc_id FROM lettered)
        UNION ALL
        SELECT doc_id, k, part, kind, CASE WHEN note THEN true WHEN begins THEN false ELSE waiting END, titled, CASE WHEN begins THEN n + 1 ELSE n END,
               CASE WHEN begins AND NOT note THEN n + 1 ELSE block END, CASE WHEN begins AND note THEN n + 1 ELSE foot END,
               CASE WHEN begins THEN n + 1 WHEN note THEN foot ELSE block END, begins
        FROM (SELECT * REPLACE (CASE WHEN note THEN part WHEN in_title THEN 1 WHEN lev > 0 THEN CASE WHEN name = 'abstract' THEN 2 WHEN name IN ('references', 'bibliography', 'literature cited') THEN 5 ELSE 4 END
                                     WHEN part = 1 AND front THEN 1 WHEN act = 30 THEN 3 ELSE part_then END AS part,
                                CASE WHEN note THEN kind WHEN act // 10 = 0 THEN kind ELSE act // 10 END AS kind),
                     CASE WHEN note THEN NOT (waiting AND note_goes_on) ELSE act >= 10 END AS begins
              FROM (SELECT *, CASE WHEN in_title THEN CASE WHEN kind = 1 THEN 0 ELSE 10 END WHEN lev > 0 THEN 40 WHEN part = 1 AND front THEN CASE WHEN kind = 2 THEN 0 ELSE 20 END
                                   WHEN part_then = 5 THEN CASE WHEN NOT (reference AND (kind <> 9 OR closed)) AND kind = 9 AND NOT (blank AND reference) THEN 0 ELSE 90 END
                                   WHEN caption THEN 60 WHEN equation THEN CASE WHEN kind = 7 AND NOT fresh THEN 0 ELSE 70 END WHEN tab THEN CASE WHEN kind = 8 OR (kind = 6 AND NOT fresh AND open_caption) THEN 0 ELSE 80 END
                                   WHEN heads AND NOT (kind = 5 AND NOT fresh) THEN 80 WHEN NOT fresh AND kind NOT IN (7, 8) THEN 0 WHEN inline AND part_then <> 2 THEN 30 WHEN part_then = 2 THEN 31 ELSE 50 END AS act
                    FROM (SELECT *, CASE part WHEN 5 THEN level_in_refs ELSE level END AS lev, kind IN (0, 1, 4) OR new AS fresh, CASE WHEN part = 1 AND NOT front THEN 4 ELSE part END AS part_then
                          FROM (SELECT l.*, r.part, r.kind, r.waiting, r.n, r.block, r.foot, NOT l.note AND CASE WHEN r.titled >= 3 THEN false WHEN r.titled = 0 THEN head ELSE more_title END AS in_title,
                                       CASE WHEN l.note OR r.titled >= 3 THEN r.titled WHEN CASE WHEN r.titled = 0 THEN head ELSE more_title END THEN r.titled + 1 ELSE 3 END AS titled
                                FROM run r JOIN lettered l ON l.doc_id = r.doc_id AND l.k = r.k + 1))))),
    numbered AS (SELECT r.doc_id, r.k, r.number, r.begins, l.note, l.text, l.page, CASE WHEN l.note THEN 'footnote' ELSE {_KINDS}[r.kind + 1] END AS type, CASE WHEN r.kind = 4 AND NOT l.note THEN l.level ELSE 0 END AS level
                 FROM run r JOIN lettered l ON l.doc_id = r.doc_id AND l.k = r.k),
    grouped AS (SELECT doc_id, number AS block_no, arg_min(type, k) AS type, min(page) AS page, arg_min(level, k) AS level, list(text ORDER BY k) AS parts FROM numbered GROUP BY doc_id, number),
    texts AS (SELECT *, CASE WHEN type IN ('table', 'equation', 'code', 'authors') THEN array_to_string(parts, chr(10)) WHEN type = 'footnote' THEN trim(array_to_string(parts, ' ')) ELSE {join_sql('parts')} END AS text FROM grouped)
    SELECT doc_id, block_no::BIGINT AS block_no, 'b' || block_no AS id, type, page, level::BIGINT AS level, type IN ('authors', 'equation', 'table', 'reference', 'code') AS keep,
           coalesce(last_value(CASE WHEN type = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS section, text
    FROM texts"""
