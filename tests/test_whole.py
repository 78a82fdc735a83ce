"""Whole pages: parts in order against pages put together in plain Python."""

import html

from pyspark.sql import functions as F

from tessera.operators import blocks, render, whole
from tessera.sources import documents as D
from tests import rows as R

META = "doc_id long, source string, title string, pages int, summary string, notes string"
ROWS = [(1, "log<1>.txt", None, 2, "# In short\nRain *fell*.", "- a note"), (2, "b.txt", "Own & title", None, None, ""), (3, None, None, None, None, None)]


def inputs(spark):
    docs = spark.createDataFrame([(1, R.LOG), (2, "A Title of Things\nIda Example\n\nText that goes on and ends here."), (8, "not asked for")], "doc_id long, text string")
    found = blocks.build_blocks(D.lines(docs)).cache()
    done = spark.createDataFrame([(1, "b1", "Tựa <đề>"), (1, "b3", "đoạn\n\nhai"), (1, "b4", "## Tuần khô"), (1, "b9", "Bảng  1\n2  3"), (2, "b3", "")], "doc_id long, block_id string, text string")
    terms = spark.createDataFrame([(1, "rain", ["mưa", "cơn mưa"], 3), (1, "Gauge", ["<máy>"], 0), (8, "no", ["x"], 1)], "doc_id long, en string, vi array<string>, count long")
    return found, done, spark.createDataFrame(ROWS, META), terms


def plain_html(rows, docs, terms, summary_only):
    """``rows``: blocks with vi and html by document."""
    pages = {}
    for doc, source, title, pages_, summary, notes in docs:
        mine = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.block_no)
        titled = next((r for r in mine if r.type == "title"), None)
        authors = next((r for r in mine[:4] if r.type == "authors"), None)
        todo, done = sum(not r.keep for r in mine), sum(not r.keep and r.vi is not None for r in mine)
        name = title or (titled.text if titled else source) or ""
        vi, percent = titled.vi if titled else None, round(100 * done / max(1, todo))
        body = [] if summary_only else [r for r in mine if r not in (titled, authors)]
        told = " · ".join(x for x in (html.escape(source or ""), f"{pages_} trang" if pages_ else "", f"đã dịch {done}/{todo} khối ({percent}%)") if x)
        toc = "".join(f'<li class="l{r.level}"><a href="#{r.id}">{render.inline_html((r.vi or r.text).lstrip("# "))}</a></li>' for r in body if r.type == "heading")
        toc += '<li class="l1"><a href="#notes">Ghi chú &amp; giải thích</a></li>' if notes else "" if toc else "<li>(không có mục)</li>"
        quick = f'<details class="quick" open><summary>Đọc nhanh</summary><div class="md">{render.markdown_html(summary)}</div></details>' if summary else ""
        said = f'<section class="notes" id="notes"><h2>Ghi chú &amp; giải thích</h2><div class="md">{render.markdown_html(notes)}</div></section>' if notes else ""
        listed = "".join(
            f'<tr><td lang="en">{html.escape(t.en)}</td><td lang="vi"><b>{html.escape(t.vi[0])}</b>' + (f"<br><small>{html.escape(', '.join(t.vi[1:]))}</small>" if t.vi[1:] else "") + f"</td><td>{t['count'] or ''}</td></tr>"
            for t in sorted(terms, key=lambda t: t.en.lower()) if t.doc_id == doc)
        pages[doc] = (
            f'<!DOCTYPE html>\n<html lang="vi"><head><meta charset="utf-8"><title>{html.escape(vi or name)}</title></head><body>\n<header><h1>{render.inline_html(vi) if vi else html.escape(name)}</h1>'
            f'<p class="en" lang="en">{html.escape(name) if vi else ""}</p><p class="authors">{"".join(f"<span>{html.escape(x)}</span>" for x in (authors.text.split(chr(10)) if authors else []))}</p><p class="meta">{told}</p>'
            f'<progress max="100" value="{percent}"></progress></header>\n<nav><ul>{toc}</ul></nav>\n{quick}\n<main>{"".join(r.html for r in body)}</main>\n{said}<table class="terms"><tbody>'
            f'{listed or "<tr><td colspan=3>(chưa có thuật ngữ)</td></tr>".replace("colspan=3", chr(99) + "olspan=" + chr(34) + "3" + chr(34))}</tbody></table>\n</body></html>\n')
    return pages


def test_html(spark):
    found, done, meta, terms = inputs(spark)
    rows = render.render_blocks(found, done).collect()
    for summary_only in (False, True):
        parts = whole.html_parts(found, done, meta, terms, summary_only)
        assert {r.doc_id: r.text for r in whole.files(parts).collect()} == plain_html(rows, ROWS, terms.collect(), summary_only)
    assert whole.html_parts(found, done, meta.where("false"), terms).count() == 0 and 'title="Tài liệu tham khảo"' in next(r.html for r in rows if r.type == "reference")


def test_parts_are_placed(spark, tmp_path):
    """By stretches of any size; the written table, read file by file, is the documents one after the other."""
    found, done, meta, terms = inputs(spark)
    parts = whole.html_parts(found, done, meta, terms).cache()
    texts = {r.doc_id: r.text for r in whole.files(parts).collect()}
    for stretch in (1, 3, 4096):
        assert all(texts[r.doc_id][r.at :].startswith(r.text) for r in whole.placed(parts, stretch).collect())
    whole.write(parts, str(tmp_path / "parts"))
    back = spark.read.parquet(str(tmp_path / "parts")).withColumn("file", F.input_file_name()).collect()
    order = sorted(back, key=lambda r: (r.file, r.doc_id, r["section"], r.no))
    assert [(r.doc_id, r["section"], r.no) for r in order] == sorted((r.doc_id, r["section"], r.no) for r in back)
    assert "".join(r.text for r in order if r.doc_id == 1) == texts[1]


def test_markdown(spark):
    found, done, meta, terms = inputs(spark)
    texts = {r.doc_id: r.text for r in whole.files(whole.markdown_parts(found, done, meta, terms, bilingual=True)).collect()}
    assert texts[1].startswith("# Tựa <đề>\n\n*Rain Gauge Log of the Upper Meadow*\n\n> Bản dịch tiếng Việt của `log<1>.txt` (3/8 khối đã dịch). Hãy đối chiếu bản gốc khi trích dẫn.\n\n## Đọc nhanh\n\n## In short\nRain *fell*.\n\n## Setup\n\nđoạn\n\nhai\n\n> The gauge")
    assert texts[1].endswith("## Ghi chú & giải thích\n\n- a note\n\n## Thuật ngữ\n\n| English | Tiếng Việt |\n|---|---|\n| Gauge | <máy> |\n| rain | mưa |\n")
    assert texts[2].startswith("# Own & title\n\nIda Example  \nText that goes on and ends here.\n\n> Bản dịch") and "*(chưa dịch)*" in texts[1] and "Thuật ngữ" not in texts[2] and set(texts) == {1, 2, 3}
    short = {r.doc_id: r.text for r in whole.files(whole.markdown_parts(found, done, meta, summary_only=True)).collect()}
    assert "The gauge" not in short[1] and "## Đọc nhanh" in short[1]
