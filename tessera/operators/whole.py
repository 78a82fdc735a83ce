"""Whole HTML and Markdown documents as ordered parts.

A document is rows ``doc_id, section, no, text``: its head, entries of its contents, blocks, notes, terms.  Read in the order of
section and number they are the document, so none is ever one array; ``placed`` says where each part starts, and
``files`` puts parts of bounded documents together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as T
from tessera.operators import render
from tessera.sources.shared import joined

# Headings of sections and labels.
PAGES, DONE_BEFORE, DONE_AFTER = " trang", "đã dịch ", " khối ("
LINE_BEFORE, LINE_AFTER = "> Bản dịch tiếng Việt của `", " khối đã dịch). Hãy đối chiếu bản gốc khi trích dẫn."
QUICK, NOTES, TERMS, NO_ENTRY, NO_TERM = "Đọc nhanh", "Ghi chú & giải thích", "Thuật ngữ", "(không có mục)", "(chưa có thuật ngữ)"
HEAD, CONTENTS, BETWEEN, BLOCKS, NOTE, TERM_HEAD, TERM, TAIL = range(8)


def _facts(blocks: DataFrame, translations: DataFrame, meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks with ``vi`` and without the title and the authors that stand in the head; and a row for each document of
    ``meta(doc_id, source, title, pages, summary, notes)`` with what its head tells."""
    both = render.with_translations(blocks, translations)
    first = lambda column, test: F.min_by(F.when(test, column), F.when(test, F.col("block_no")))
    titled, written = F.col("type") == "title", (F.col("type") == "authors") & (F.col("block_no") <= 4)
    counted = both.groupBy("doc_id").agg(
        F.count_if(~F.col("keep")).alias("total"), F.count_if(~F.col("keep") & F.col("vi").isNotNull()).alias("done"), first(F.col("text"), titled).alias("block_title"), first(F.col("vi"), titled).alias("title_vi"),
        F.min(F.when(titled, F.col("block_no"))).alias("title_no"), first(F.col("text"), written).alias("authors"), F.min(F.when(written, F.col("block_no"))).alias("authors_no"))
    empty = lambda name: F.coalesce(name, F.lit(""))
    docs = joined(meta, counted, ["doc_id"]).select(
        "doc_id", empty("source").alias("source"), F.coalesce(F.nullif("title", F.lit("")), "block_title", "source", F.lit("")).alias("title"), "title_vi", "title_no", empty("authors").alias("authors"), "authors_no",
        F.coalesce("pages", F.lit(0)).alias("pages"), T.strip(empty("summary")).alias("summary"), T.strip(empty("notes")).alias("notes"), F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("done", F.lit(0)).alias("done"))
    heads = docs.select("doc_id", F.coalesce("title_no", F.lit(-1)).alias("title_no"), F.coalesce("authors_no", F.lit(-1)).alias("authors_no"))
    body = joined(both, heads, ["doc_id"], "inner").where((F.col("block_no") != F.col("title_no")) & (F.col("block_no") != F.col("authors_no"))).drop("title_no", "authors_no")
    return body, docs


def _parts(frame: DataFrame, section: int, text: Column, no: Column | None = None) -> DataFrame:
    return frame.select("doc_id", F.lit(section).alias("section"), (F.lit(0) if no is None else no).cast("bigint").alias("no"), text.alias("text")).where("text is not null")


def _union(parts: list[DataFrame]) -> DataFrame:
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def html_parts(blocks: DataFrame, translations: DataFrame, meta: DataFrame, terms: DataFrame | None = None, summary_only: bool = False) -> DataFrame:
    """The parts of a page for each document of ``meta(doc_id, source, title, pages, summary, notes)``: title, authors, how much is
    translated, contents, summary, blocks side by side, notes and ``terms(doc_id, en, vi, count)``, by number ``no`` if there is
    one, else by term.  Without ``summary_only``, which leaves blocks out.  Texts are escaped; nothing is a template.

    Null texts in ``meta`` are empty ones; a document without blocks has the other parts; blocks of other documents don't
    count; a null id is a document of its own; ``meta`` has each id once; an empty ``meta`` gives no parts."""
    body, docs = _facts(blocks, translations, meta)
    esc, inline = T.escape_html, render.inline
    shown = body.where(F.lit(not summary_only))
    percent = F.bround(100 * F.col("done") / F.greatest(F.col("total"), F.lit(1))).cast("int").cast("string")
    told = F.concat_ws(" · ", F.nullif(esc(F.col("source")), F.lit("")), F.when(F.col("pages") > 0, F.concat(F.col("pages").cast("string"), F.lit(PAGES))),
                       F.concat(F.lit(DONE_BEFORE), F.col("done").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(DONE_AFTER), percent, F.lit("%)")))
    names = F.array_join(F.transform(F.filter(F.split("authors", "\n", -1), lambda x: x != ""), lambda x: F.concat(F.lit("<span>"), esc(x), F.lit("</span>"))), "")
    vi = F.col("title_vi")
    head = F.concat(
        F.lit('<!DOCTYPE html>\n<html lang="vi"><head><meta charset="utf-8"><title>'), esc(F.coalesce(vi, "title")), F.lit("</title></head><body>\n<header><h1>"), F.coalesce(inline(vi), esc(F.col("title"))), F.lit('</h1><p class="en" lang="en">'),
        F.when(vi.isNotNull(), esc(F.col("title"))).otherwise(F.lit("")), F.lit('</p><p class="authors">'), names, F.lit('</p><p class="meta">'), told, F.lit('</p><progress max="100" value="'), percent, F.lit('"></progress></header>\n<nav><ul>'))
    label = inline(F.coalesce(T.strip_heading_marks(F.col("vi")), "text"))
    entry = F.concat(F.lit('<li class="l'), F.col("level").cast("string"), F.lit('"><a href="#'), "id", F.lit('">'), label, F.lit("</a></li>"))
    entries = shown.where("type = 'heading'")
    listed = joined(docs, entries.select("doc_id").distinct().withColumn("has", F.lit(True)), ["doc_id"])
    notes = F.col("notes") != ""
    after = F.when(notes, F.lit(f'<li class="l1"><a href="#notes">{NOTES.replace("&", "&amp;")}</a></li>')).when(F.col("has").isNull(), F.lit(f"<li>{NO_ENTRY}</li>")).otherwise(F.lit(""))
    quick = F.when(F.col("summary") != "", F.concat(F.lit(f'<details class="quick" open><summary>{QUICK}</summary><div class="md">'), render.mini_markdown(F.col("summary")), F.lit("</div></details>"))).otherwise(F.lit(""))
    between = F.concat(after, F.lit("</ul></nav>\n"), quick, F.lit("\n<main>"))
    note = F.concat(F.lit("</main>\n"), F.when(notes, F.concat(F.lit(f'<section class="notes" id="notes"><h2>{NOTES.replace("&", "&amp;")}</h2><div class="md">'), render.mini_markdown(F.col("notes")), F.lit("</div></section>"))).otherwise(F.lit("")))
    parts = [
        _parts(docs, HEAD, head), _parts(entries, CONTENTS, entry, F.col("block_no")), _parts(listed, BETWEEN, between), _parts(render.rendered(shown), BLOCKS, F.col("html"), F.col("block_no")), _parts(docs, NOTE, note),
        _parts(docs, TERM_HEAD, F.lit('<table class="terms"><tbody>')), _parts(docs, TAIL, F.lit("</tbody></table>\n</body></html>\n")),
    ]
    others = F.array_join(F.slice("vi", 2, F.greatest(F.size("vi") - 1, F.lit(0))), ", ")
    row = F.concat(F.lit('<tr><td lang="en">'), esc(F.col("en")), F.lit('</td><td lang="vi"><b>'), esc(F.col("vi")[0]), F.lit("</b>"), F.when(others != "", F.concat(F.lit("<br><small>"), esc(others), F.lit("</small>"))).otherwise(F.lit("")),
                   F.lit("</td><td>"), F.when(F.col("count") > 0, F.col("count").cast("string")).otherwise(F.lit("")), F.lit("</td></tr>"))
    return _union([*parts, *_terms(docs, terms, row, F.lit(f'<tr><td colspan="3">{NO_TERM}</td></tr>'))])


def _terms(docs: DataFrame, terms: DataFrame | None, row: Column, none: Column | None) -> list[DataFrame]:
    if terms is None:
        return [] if none is None else [_parts(docs, TERM, none)]
    known = joined(terms, docs.select("doc_id"), ["doc_id"], "left_semi")
    if "no" not in terms.columns:
        known = known.withColumn("no", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.lower("en"), "en")))
    bare = [] if none is None else [_parts(joined(docs, known.select("doc_id"), ["doc_id"], "left_anti"), TERM, none)]
    return [_parts(known, TERM, row, F.col("no")), *bare]


def markdown_parts(blocks: DataFrame, translations: DataFrame, meta: DataFrame, terms: DataFrame | None = None, bilingual: bool = False, summary_only: bool = False) -> DataFrame:
    """The same in Markdown, a part ending in an empty line; ``bilingual`` adds sources below translations."""
    body, docs = _facts(blocks, translations, meta)
    vi, end = F.col("title_vi"), F.lit("\n\n")
    deeper = lambda c: F.regexp_replace(c, r"(?m)^(#{1,5})\s", "#$1 ")
    head = F.concat(F.lit("# "), F.coalesce(vi, "title"), end, F.when(vi.isNotNull(), F.concat(F.lit("*"), "title", F.lit("*"), end)).otherwise(F.lit("")), F.when(F.col("authors") != "", F.concat(F.replace("authors", F.lit("\n"), F.lit("  \n")), end)).otherwise(F.lit("")),
                    F.lit(LINE_BEFORE), "source", F.lit("` ("), F.col("done").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(LINE_AFTER), end)
    section = lambda name, column: F.when(F.col(column) != "", F.concat(F.lit(f"## {name}\n\n"), deeper(F.col(column)), end))
    parts = [_parts(docs, HEAD, head), _parts(docs, BETWEEN, section(QUICK, "summary")), _parts(render.as_markdown(body.where(F.lit(not summary_only)), bilingual), BLOCKS, F.concat("shown", end), F.col("block_no")), _parts(docs, NOTE, section(NOTES, "notes"))]
    if terms is not None:
        with_terms = joined(docs, terms.select("doc_id"), ["doc_id"], "left_semi")
        parts.append(_parts(with_terms, TERM_HEAD, F.lit(f"## {TERMS}\n\n| English | Tiếng Việt |\n|---|---|\n")))
    return _union([*parts, *_terms(docs, terms, F.concat(F.lit("| "), "en", F.lit(" | "), F.col("vi")[0], F.lit(" |\n")), None)])


def placed(parts: DataFrame, stretch: int = 4096) -> DataFrame:
    """``parts`` with ``at``: the character of its document that each starts at.  Lengths are summed by stretches of numbers
    first, so no task sums up a whole document's parts."""
    size = F.char_length("text").cast("bigint")
    keys = ["doc_id", "section", "stretch"]
    cut = parts.withColumn("stretch", F.floor(F.col("no") / stretch))
    sums = cut.groupBy(*keys).agg(F.sum(size).alias("size"))
    ahead = Window.partitionBy("doc_id").orderBy("section", "stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("start"))
    within = Window.partitionBy(*keys).orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    return joined(cut, starts, keys).withColumn("at", F.col("start") + F.coalesce(F.sum(size).over(within), F.lit(0))).drop("stretch", "start")


def write(parts: DataFrame, path: str) -> None:
    """Parts as a table in the order of documents, by ranges: each file has a stretch of parts, and files follow each other."""
    placed(parts).repartitionByRange("doc_id", "section", "no").sortWithinPartitions("doc_id", "section", "no").write.mode("overwrite").parquet(path)


def files(parts: DataFrame) -> DataFrame:
    """``doc_id, text`` of documents that each fit a row."""
    ordered = F.sort_array(F.collect_list(F.struct("section", "no", "text")))
    return parts.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "").alias("text"))
