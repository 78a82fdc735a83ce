"""Sources: texts as ordered lines, glossaries, translations and work folders.

Every reader is a ``spark.read`` with a fixed schema, so files can be in any store that Spark reaches.
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as T

LINES = ("page int, line_no int, text string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, "
         "page_w double, page_h double, blank_before boolean, md_heading int, footnote boolean")

# Page breaks, heading marks, block markers.
PAGE_BREAK = r"(?im)\f|^-{2,}\s*page\s+\d+\s*-{2,}\s*$"
NEW_LINE = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
ODD_LINE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
HEADING_MARK = r"^(#{1,6})\s+(.*)$"
MARKER = r"^[ \t]*<!--\s*(b\d+)\b[^>]*-->[ \t]*$"
COMMENT = r"(?s)<!--.*?-->"


class MissingDependency(RuntimeError):
    """No library for reading PDF files is installed."""


def page_numbers(spec: str | None, n: int) -> list[int]:
    """The pages that "1-3,5", "8-" or "-3" name, of 1 to ``n``, sorted; all if there is no spec."""
    chosen: set[int] = set()
    for part in (spec or f"1-{n}").split(","):
        first, dash, last = (x.strip() for x in part.strip().partition("-"))
        if first or dash:
            lo, hi = int(first or 1), int(last or n) if dash else int(first)
            chosen |= set(range(max(lo, 1), min(hi, n) + 1))
    return sorted(chosen)


def in_pages(page: Column, spec: str | None) -> Column:
    """The same choice as a filter of a page column, for texts of any number of pages."""
    if not spec:
        return F.lit(True)
    tests = []
    for part in filter(None, (x.strip() for x in spec.split(","))):
        first, dash, last = (x.strip() for x in part.partition("-"))
        tests.append(page.between(int(first or 1), int(last)) if dash and last else page >= int(first or 1) if dash else page == int(first))
    chosen = F.lit(False)
    for test in tests:
        chosen = chosen | test
    return chosen


def _page_texts(text: Column) -> Column:
    """A text cut at form feeds and page lines; an empty first page doesn't count."""
    text = F.coalesce(text, F.lit(""))
    text = F.when(text.startswith("\ufeff"), F.substr(text, F.lit(2))).otherwise(text)
    parts = F.when(text.contains("\f") | text.contains("--"), F.split(text, PAGE_BREAK, -1)).otherwise(F.array(text))
    return F.transform(F.array(parts), lambda p: F.when((F.size(p) > 1) & (T.strip(p[0]) == ""), F.slice(p, 2, F.size(p))).otherwise(p))[0]


def _rows(text: Column) -> Column:
    """A text cut at line ends of any kind; where only line feeds occur, no pattern is needed."""
    # Bound by a lambda, for an expression that stands in many places would be computed in each.
    cut = lambda t: F.split(F.when(T.has_any(t, ODD_LINE_ENDS), F.regexp_replace(t, NEW_LINE, "\n")).otherwise(t), "\n", -1)
    return F.transform(F.array(text), cut)[0]


def pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, page, text``: pages numbered from 1.  A null text is one empty page; repeated rows and null ids stay."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(_page_texts(F.col(text_col))).alias("page", "text")).withColumn("page", F.col("page") + 1)


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", markdown: bool = False, spec: str | None = None, composed: bool = False, paged: bool = True) -> DataFrame:
    """``doc_id`` and the columns of ``LINES``: cleaned lines that aren't empty, numbered from 1 in their document; and ``up`` and
    ``down``, their numbers from either end of their page.  Without ``paged`` a text is one page.

    ``blank_before`` looks at the lines of the page before empty ones go.  With ``markdown``, heading marks become
    levels, and if the only level 1 is the first line, the others go up by one.

    A row's lines are numbered within their array, so nothing is shuffled; each row is a document, also where ids repeat
    or are null.  A null or empty text has no lines, an empty table gives an empty one; other columns aren't looked at.
    """
    whole = F.col(text_col) if composed else T.nfc(F.col(text_col))
    texts = docs.select(F.col(id_col).alias("doc_id"), (_page_texts(whole) if paged else F.array(F.coalesce(whole, F.lit("")))).alias("texts"))
    split = lambda p: F.transform(_rows(T.plain_signs(p)), T.strip)
    paged = texts.select("doc_id", F.transform("texts", lambda p, k: F.struct((k + 1).alias("page"), split(p).alias("rows"))).alias("pages"))
    level = lambda text: F.length(F.regexp_extract(text, HEADING_MARK, 1)) if markdown else F.lit(0)

    def kept(page: Column) -> Column:
        entry = lambda text, k: F.struct(page["page"].alias("page"), text.alias("text"), ((k > 0) & (F.get(page["rows"], k - 1) == "")).alias("blank_before"), level(text).alias("level"))
        rows = F.filter(F.transform(page["rows"], entry), lambda e: e["text"] != "")
        counted = lambda r: F.transform(r, lambda e, k: F.struct(*[e[x].alias(x) for x in ("page", "text", "blank_before", "level")], (k + 1).alias("up"), (F.size(r) - k).alias("down")))
        return F.transform(F.array(rows), counted)[0]

    listed = paged.select("doc_id", F.flatten(F.transform(F.filter("pages", lambda p: in_pages(p["page"], spec)), kept)).alias("entries"))
    shift = (F.get("entries", F.lit(0))["level"] == 1) & (F.size(F.filter("entries", lambda e: e["level"] == 1)) == 1) if markdown else F.lit(False)
    # Outer, for a filter on the size of the array would have it computed twice.
    found = listed.select("doc_id", shift.alias("shift"), F.posexplode_outer("entries").alias("pos", "e")).where("pos is not null")
    text = F.when(F.col("e.level") > 0, T.strip(F.regexp_extract("e.text", HEADING_MARK, 2))).otherwise(F.col("e.text")) if markdown else F.col("e.text")
    raised = F.when(F.col("shift") & (F.col("pos") > 0) & (F.col("e.level") > 0), F.greatest(F.lit(1), F.col("e.level") - 1)).otherwise(F.col("e.level"))
    # The mark tells later steps that no line has a place, so they needn't look for any.
    none = [F.lit(None).cast("double").alias(x, metadata={"unplaced": True}) for x in ("x0", "y0", "x1", "y1", "size")]
    return found.select("doc_id", F.col("e.page").alias("page"), (F.col("pos") + 1).alias("line_no"), text.alias("text"), *none, F.lit(False).alias("bold"), F.lit(None).cast("double").alias("page_w"),
                        F.lit(None).cast("double").alias("page_h"), F.col("e.blank_before").alias("blank_before"), raised.cast("int").alias("md_heading"), F.lit(False).alias("footnote"), F.col("e.up").alias("up"), F.col("e.down").alias("down"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id`` (the file's path) and ``text`` of text and Markdown files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))


def pdf_engine(name: str = "auto"):
    """(engine, module): PyMuPDF if there is one, then pypdf."""
    import importlib

    if name not in ("auto", "pymupdf", "pypdf"):
        raise ValueError(f"unknown engine {name!r}")
    for engine, module in (("pymupdf", "pymupdf"), ("pymupdf", "fitz"), ("pypdf", "pypdf")):
        if name in ("auto", engine):
            try:
                return engine, importlib.import_module(module)
            except ImportError:
                continue
    raise MissingDependency("reading PDF files needs PyMuPDF or pypdf; texts and Markdown need neither")


def read_pdf_pages(spark: SparkSession, path: str, engine: str = "auto") -> DataFrame:
    """``doc_id, page, text`` of PDF files; a page that can't be read is empty.  Feed it to ``lines`` page by page."""
    engine, _ = pdf_engine(engine)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                _, module = pdf_engine(engine)
                found = []
                if engine == "pymupdf":
                    found = [page.get_text("text") for page in module.open(stream=content, filetype="pdf")]
                else:
                    for page in module.PdfReader(io.BytesIO(content)).pages:
                        try:
                            found.append(page.extract_text() or "")
                        except Exception:  # one bad font shouldn't lose the other pages
                            found.append("")
                yield pd.DataFrame({"doc_id": name, "page": range(1, len(found) + 1), "text": found})

    return files.mapInPandas(run, "doc_id string, page int, text string")


def read_glossary(spark: SparkSession, path: str, source: str) -> DataFrame:
    """``en, vi, domain, note, source, row`` of a glossary file or of a folder of such files, each with a header of its own
    (``folders.read_glossaries``)."""
    from tessera.sources import folders

    return folders.read_glossaries(spark, path, source)[0]


def parse_glossary(raw: DataFrame, source: str | None, *more: str) -> DataFrame:
    """Cells of glossary files (``en, vi, domain, note`` and ``more``) as entries; without ``source``, that is the column ``file``."""
    variants = F.filter(F.transform(F.split(F.coalesce(F.col("vi"), F.lit("")), r"\|", -1), T.strip), lambda v: v != "")
    plain = lambda name: T.strip(F.coalesce(F.col(name), F.lit("")))
    rows = raw.select(T.strip(T.nfc(plain("en"))).alias("en"), T.nfc(F.array_join(variants, "|")).alias("joined"), plain("domain").alias("domain"), plain("note").alias("note"), *more)
    return rows.where((F.col("en") != "") & (F.col("joined") != "")).select(
        "en", F.split("joined", r"\|").alias("vi"), "domain", "note", (F.col("file") if source is None else F.lit(source)).alias("source"), *(more or [F.monotonically_increasing_id().alias("row")]))


def parse_marked(files: DataFrame) -> DataFrame:
    """``doc_id, file, block_id, text`` of ``files(doc_id, file, text)``: a block's text stands below its marker line.
    Other comments go; of a block that a file marks again the last text counts, even an empty one."""
    rows = files.select("doc_id", "file", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("line", F.regexp_replace("line", "\r$", ""))
    order = Window.partitionBy("doc_id", "file").orderBy("pos")
    opened = F.nullif(F.regexp_extract("line", MARKER, 1), F.lit(""))
    rows = rows.withColumn("opened", opened).withColumn("run", F.count("opened").over(order)).where("run > 0")
    bodies = rows.groupBy("doc_id", "file", "run").agg(F.max("opened").alias("block_id"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("opened").isNull(), F.struct("pos", "line")))), lambda x: x["line"]), "\n").alias("body"))
    text = T.nfc(T.strip(F.regexp_replace("body", COMMENT, "")))
    return bodies.groupBy("doc_id", "file", "block_id").agg(F.max_by("body", "run").alias("body")).select("doc_id", "file", "block_id", text.alias("text"))


def parse_translation_json(files: DataFrame) -> DataFrame:
    """The same of JSON files in any of three shapes: {"b1": text}, {"blocks": [{"id", "vi" or "text"}]}, or that list.
    A file that isn't JSON gives no row."""
    item = "array<struct<id: string, vi: string, text: string>>"
    listed = F.coalesce(F.from_json("text", f"struct<blocks: {item}>")["blocks"], F.when(F.ltrim("text").startswith("["), F.from_json("text", item)))
    blocks = F.coalesce(F.from_json("text", "struct<blocks: map<string, string>>")["blocks"], F.from_json("text", "map<string, string>"))
    mapped = F.transform(F.filter(F.map_entries(blocks), lambda e: e["key"].rlike(r"^b\d+$")), lambda e: F.struct(e["key"].alias("id"), e["value"].alias("value")))
    found = F.when(listed.isNotNull(), F.transform(F.filter(listed, lambda x: x["id"].isNotNull()), lambda x: F.struct(x["id"].alias("id"), F.coalesce(x["vi"], x["text"], F.lit("")).alias("value")))).otherwise(mapped)
    rows = files.select("doc_id", "file", F.posexplode(found).alias("pos", "e")).where("e.value is not null")
    return rows.groupBy("doc_id", "file", F.col("e.id").alias("block_id")).agg(F.max_by("e.value", "pos").alias("text")).withColumn("text", T.nfc(T.strip(F.col("text"))))


def merge_translations(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``parts(doc_id, file, block_id, text)``: the translations, the last file by name winning, and a warning row
    (doc_id, block_id, file, earlier_file) for each time that a file says something else than the one before."""
    order = Window.partitionBy("doc_id", "block_id").orderBy("file")
    seen = parts.where("text <> ''").withColumn("earlier", F.lag("text").over(order)).withColumn("earlier_file", F.lag("file").over(order))
    merged = seen.groupBy("doc_id", "block_id").agg(F.max_by("text", "file").alias("text"), F.max("file").alias("origin"))
    return merged, seen.where("earlier <> text").select("doc_id", "block_id", "file", "earlier_file")


def unknown_ids(translations: DataFrame, blocks: DataFrame) -> DataFrame:
    """Translations of blocks that don't exist."""
    return translations.join(blocks.select("doc_id", F.col("id").alias("block_id")), ["doc_id", "block_id"], "left_anti")


def first_text(*columns: str) -> Column:
    """The first of some optional side texts that isn't empty, or an empty one."""
    return F.coalesce(*[F.nullif(F.col(x), F.lit("")) for x in columns], F.lit(""))


def source_text(blocks: DataFrame) -> DataFrame:
    """``doc_id, text``: the blocks that need translation, a line each."""
    parts = blocks.where(~F.col("keep")).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("block_no", "text"))).alias("b"))
    return parts.select("doc_id", F.array_join("b.text", "\n").alias("text"))


def ordered_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """Glossary layers as one frame with ``prec``, their load order."""
    merged = None
    for k, frame in enumerate(frames):
        layer = frame.withColumn("prec", F.lit(k))
        merged = layer if merged is None else merged.unionByName(layer)
    return merged
