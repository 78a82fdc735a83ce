"""HTML and Markdown of documents with their translations.

Markup inside a paragraph nests, so it is made by Arrow-batched functions of a text; documents are put together from
their blocks by grouped aggregates.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions import text as T
from tessera.sources.shared import joined

# Marks of inline Markdown, and labels.
CODE, MATHS = r"`([^`\n]+)`", r"\$\$[^$]+\$\$|\$[^$\n]+\$"
URL = r"https?://[^\s<>()\]]+[^\s<>().,;:\]]"
STRONG, EM = r"\*\*(?=\S)(.+?)(?<=\S)\*\*", r"(?<![\w*])\*(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*(?![\w*])"
CITED = r"\[(\d+(?:\s*[,–\-]\s*\d+)*)\]"
LABELS = {"equation": "Công thức", "table": "Bảng", "reference": "Tài liệu tham khảo", "authors": "Tác giả", "code": "Mã"}
MISSING, NOT_YET = "Chưa dịch", "*(chưa dịch)*"
#: What is taken out, in this order, and how it is shown.
_VERBATIM = (
    (re.compile(CODE), lambda m: f"<code>{html.escape(m[1])}</code>"),
    (re.compile(MATHS), lambda m: f'<span class="math">{html.escape(m[0])}</span>'),
    (re.compile(URL), lambda m: f'<a href="{html.escape(m[0])}" rel="noopener noreferrer" target="_blank">{html.escape(m[0])}</a>'),
)
_HELD = re.compile("\0(\\d+)\0")
_LIST = re.compile(r"^\s*(?:([-*+])|(\d+[.)]))\s+(.*)$")


def inline_html(text: str) -> str:
    """A safe subset of inline Markdown: code, formulas, links, strong, emphasis and citations; all else is escaped.
    Code is taken out first, then formulas, then links, and all are put back last, so nothing in them is marked up."""
    kept: list[str] = []
    held = text.replace("\0", "")
    for pattern, show in _VERBATIM:
        def take(match: re.Match, show=show) -> str:
            kept.append(show(match))
            return f"\0{len(kept) - 1}\0"

        held = pattern.sub(take, held)
    marked = html.escape(held, quote=False)
    for pattern, shown in ((STRONG, r"<strong>\1</strong>"), (EM, r"<em>\1</em>"), (CITED, r'<span class="cite">[\1]</span>')):
        marked = re.sub(pattern, shown, marked)
    while _HELD.search(marked):  # a formula may have code in it
        marked = _HELD.sub(lambda m: kept[int(m[1])], marked)
    return marked


def paragraphs_html(text: str) -> str:
    return "".join(f"<p>{inline_html(' '.join(part.split()))}</p>" for part in re.split(r"\n\s*\n", text) if part.strip())


def markdown_html(text: str) -> str:
    """Headings, lists, tables, quotes, fences and paragraphs of a small Markdown text."""
    out: list[str] = []
    lines = text.replace("\r\n", "\n").split("\n")
    kinds = [_kind(line, lines[k + 1] if k + 1 < len(lines) else "") for k, line in enumerate(lines)]
    k = 0
    while k < len(lines):
        kind, start = kinds[k], k
        k += 1
        if kind == "fence":
            while k < len(lines) and not lines[k].strip().startswith("```"):
                k += 1
            out.append(f"<pre>{html.escape(chr(10).join(lines[start + 1 : k]))}</pre>")
            k += 1
        elif kind == "heading":
            marks, title = lines[start].strip().split(None, 1)
            out.append("<h{0}>{1}</h{0}>".format(min(6, len(marks) + 1), inline_html(title.strip())))
        elif kind == "table":
            while k < len(lines) and lines[k].strip().startswith("|"):
                k += 1
            cells = [[c.strip() for c in line.strip().strip("|").split("|")] for line in lines[start:k]]
            row = lambda tag, cs: "<tr>" + "".join(f"<{tag}>{inline_html(c)}</{tag}>" for c in cs) + "</tr>"
            out.append(f"<table><thead>{row('th', cells[0])}</thead><tbody>{''.join(row('td', r) for r in cells[2:])}</tbody></table>")
        elif kind == "list":
            items = [_LIST.match(lines[start])[3]]
            while k < len(lines):
                more = _LIST.match(lines[k])
                if more:
                    items.append(more[3])
                elif lines[k].strip() and lines[k].startswith(("  ", "\t")):
                    items[-1] += " " + lines[k].strip()
                else:
                    break
                k += 1
            tag = "ol" if _LIST.match(lines[start])[2] else "ul"
            out.append(f"<{tag}>{''.join(f'<li>{inline_html(x)}</li>' for x in items)}</{tag}>")
        elif kind == "quote":
            while k < len(lines) and lines[k].strip().startswith(">"):
                k += 1
            out.append(f"<blockquote>{paragraphs_html(chr(10).join(line.strip()[1:].strip() for line in lines[start:k]))}</blockquote>")
        elif kind == "text":
            while k < len(lines) and kinds[k] == "text":
                k += 1
            out.append(f"<p>{inline_html(' '.join(line.strip() for line in lines[start:k]))}</p>")
    return "\n".join(out)


def _kind(line: str, following: str) -> str:
    bare = line.strip()
    if not bare:
        return "blank"
    if bare.startswith("```"):
        return "fence"
    if re.match(r"#{1,6}\s+\S", bare):
        return "heading"
    if bare.startswith("|") and re.match(r"\s*\|?\s*:?-{2,}", following):
        return "table"
    if _LIST.match(bare):
        return "list"
    return "quote" if bare.startswith(">") else "text"


def _udf(function):
    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else function(x))

    return run


inline = _udf(inline_html)
paragraphs = _udf(paragraphs_html)
mini_markdown = _udf(markdown_html)


def table_rows(text: Column) -> Column:
    """Cells of the lines of a table: set apart by two blanks or a tab."""
    lines = F.filter(F.split(T.strip(text), "\n", -1), lambda x: T.strip(x) != "")
    return F.transform(lines, lambda x: F.split(T.strip(x), r"\s{2,}|\t", -1))


def is_table(text: Column) -> Column:
    """Two rows and columns at least, and as many cells in every row."""
    rows = table_rows(text)
    return (F.size(rows) >= 2) & F.coalesce((F.size(rows[0]) >= 2) & F.forall(rows, lambda r: F.size(r) == F.size(rows[0])), F.lit(False))


def table_html(text: Column) -> Column:
    row = lambda r, tag: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit(f"<{tag}>"), T.escape_html(c), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
    rows = table_rows(text)
    body = F.array_join(F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: row(r, "td")), "")
    table = F.concat(F.lit('<div class="tbl"><table><thead>'), row(rows[0], "th"), F.lit("</thead><tbody>"), body, F.lit("</tbody></table></div>"))
    return F.when(is_table(text), table).otherwise(F.concat(F.lit('<pre class="verbatim">'), T.escape_html(text), F.lit("</pre>")))


def with_translations(blocks: DataFrame, translations: DataFrame) -> DataFrame:
    """``blocks`` with ``vi``, their translation or null.  Empty and null translations don't count; of repeated ones for a block
    the greatest is taken; null ids are equal; translations of other blocks don't matter."""
    done = translations.where("text <> ''").groupBy("doc_id", F.col("block_id").alias("id")).agg(F.max("text").alias("vi"))
    return joined(blocks, done, ["doc_id", "id"])


def render_blocks(blocks: DataFrame, translations: DataFrame) -> DataFrame:
    """``blocks`` with ``vi`` and ``html``: source and translation side by side, kept blocks as they are."""
    return rendered(with_translations(blocks, translations))


def rendered(both: DataFrame) -> DataFrame:
    """Blocks with ``vi``, and with ``html``."""
    pre = lambda c: F.concat(F.lit('<pre class="verbatim">'), T.escape_html(c), F.lit("</pre>"))
    kind, text, vi = F.col("type"), F.col("text"), F.col("vi")
    level = F.least(F.lit(4), F.greatest(F.lit(2), F.col("level") + 1)).cast("string")
    missing = F.lit(f'<span class="missing">{MISSING}</span>')
    as_is = F.when(kind == "table", table_html(text)).when(kind.isin("equation", "code"), pre(text)).when(
        kind == "authors", F.array_join(F.transform(F.split(text, "\n"), lambda x: F.concat(F.lit("<p>"), T.escape_html(x), F.lit("</p>"))), "")).otherwise(F.concat(F.lit("<p>"), inline(text), F.lit("</p>")))
    own = F.when(kind == "table", table_html(vi)).when(kind.isin("equation", "code"), pre(vi)).otherwise(paragraphs(vi))
    left = F.when(kind == "heading", F.concat(F.lit("<h"), level, F.lit(' class="en" lang="en">'), T.escape_html(text), F.lit("</h"), level, F.lit(">"))).otherwise(
        F.concat(F.lit('<div class="en" lang="en">'), F.when(F.col("keep"), as_is).otherwise(paragraphs(text)), F.lit("</div>")))
    right = F.when(kind == "heading", F.concat(F.lit("<h"), level, F.lit(' class="vi" lang="vi">'), F.coalesce(inline(T.strip_heading_marks(vi)), missing), F.lit("</h"), level, F.lit(">"))).otherwise(
        F.concat(F.lit('<div class="vi" lang="vi">'), F.coalesce(own, F.concat(F.lit("<p>"), missing, F.lit("</p>"))), F.lit("</div>")))
    row = lambda extra, inner: F.concat(F.lit('<div class="row t-'), kind, F.lit(f'{extra}" id="'), F.col("id"), F.lit('">'), inner, F.lit("</div>"))
    label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair]), kind), F.lit(""))
    full = F.concat(F.lit('<div class="row t-'), kind, F.lit(' full" id="'), F.col("id"), F.lit('" title="'), label, F.lit('"><div class="both">'), as_is, F.lit("</div></div>"))
    whole = F.when(F.col("keep") & vi.isNull(), full).otherwise(row("", F.concat(left, right)))
    return both.withColumn("html", whole)


def html_documents(blocks: DataFrame, translations: DataFrame, summary_only: bool = False) -> DataFrame:
    """``doc_id, title, toc, body``: what a page template puts together, of documents that fit a row (``whole`` serves others).
    Null ids, repeated and missing translations as for ``with_translations``; an empty table gives an empty one."""
    rendered = render_blocks(blocks, translations)
    title = F.min_by(F.when(F.col("type") == "title", F.coalesce("vi", "text")), F.when(F.col("type") == "title", F.col("block_no")))
    shown = F.lit(not summary_only) & ~F.col("type").isin("title")
    entry = F.concat(F.lit('<li class="l'), F.col("level").cast("string"), F.lit('"><a href="#'), "id", F.lit('">'), inline(F.coalesce(T.strip_heading_marks(F.col("vi")), "text")), F.lit("</a></li>"))
    rows = rendered.withColumn("entry", F.when(shown & (F.col("type") == "heading"), entry))
    joined = lambda name, test: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(test, F.struct("block_no", name)))), lambda x: x[name]), "\n")
    return rows.groupBy("doc_id").agg(T.escape_html(F.coalesce(title, F.lit(""))).alias("title"), joined("entry", F.col("entry").isNotNull()).alias("toc"), joined("html", shown).alias("body"))


def markdown_documents(blocks: DataFrame, translations: DataFrame, bilingual: bool = False, summary_only: bool = False) -> DataFrame:
    """``doc_id, markdown``: the translation, or where there is none the source with a note; ``bilingual`` adds sources.  Of
    documents that fit a row; nulls, repeats and empty tables as for ``html_documents``."""
    both = with_translations(blocks, translations)
    rows = as_markdown(both, bilingual).where(F.lit(not summary_only) | (F.col("type") == "title"))
    parts = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("block_no", "shown"))).alias("b"))
    return parts.select("doc_id", F.concat(T.strip(F.regexp_replace(F.array_join("b.shown", "\n\n"), r"\n{3,}", "\n\n")), F.lit("\n")).alias("markdown"))


def as_markdown(both: DataFrame, bilingual: bool = False) -> DataFrame:
    """Blocks with ``vi``, and with ``shown``, their Markdown."""
    kind, text, vi = F.col("type"), F.col("text"), F.col("vi")
    hashes = F.repeat(F.lit("#"), F.least(F.lit(5), F.col("level") + 1))
    fenced = lambda c: F.concat(F.lit("```text\n"), c, F.lit("\n```"))
    note = F.coalesce(vi, F.concat(text, F.lit(f" {NOT_YET}")))
    plain = F.when(kind == "caption", F.concat(F.lit("*"), note, F.lit("*"))).when(kind == "footnote", F.concat(F.lit("<small>"), note, F.lit("</small>"))).otherwise(note)
    kept = F.when(kind == "reference", F.concat(F.lit("- "), text)).when(kind == "authors", F.replace(text, F.lit("\n"), F.lit("  \n"))).otherwise(text)
    shown = (
        F.when(kind == "title", F.concat(F.lit("# "), F.coalesce(vi, text), F.when(vi.isNotNull(), F.concat(F.lit("\n\n*"), text, F.lit("*"))).otherwise(F.lit(""))))
        .when(kind == "heading", F.concat(hashes, F.lit(" "), F.coalesce(T.strip_heading_marks(vi), text)))
        .when(F.col("keep") & kind.isin("equation", "table", "code"), fenced(F.coalesce(vi, text))).when(F.col("keep") & vi.isNull(), kept).otherwise(plain))
    if bilingual:
        again = F.when(kind == "heading", F.concat(F.lit("\n\n<sub>"), text, F.lit("</sub>"))).when(~F.col("keep") & (kind != "title"), F.concat(F.lit("\n\n> "), F.replace(text, F.lit("\n"), F.lit("\n> "))))
        shown = F.concat(shown, F.coalesce(F.when(vi.isNotNull(), again), F.lit("")))
    return both.withColumn("shown", shown)
