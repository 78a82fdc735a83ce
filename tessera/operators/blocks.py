"""Typed blocks from the lines of documents of any length.

What a line looks like is computed by column expressions and packed into a letter; what it does in its document follows
from its letter and a state (``tessera.operators.fold``).  Documents of up to ``stretch`` lines are read from their first
line on, sorted, with nothing held but the state.  Longer ones are cut into stretches, which are dealt to all tasks: each
is read once for every state that it may be entered in, which gives one row; these rows, in the order of the document, tell
where each stretch is entered; then the stretches are read again from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as T
from tessera.operators import classify as C
from tessera.operators import fold, layout
from tessera.sources.documents import LINES
from tessera.sources.shared import held, in_arrow, joined

KEEP = ("authors", "equation", "table", "reference", "code")
BY_LINE = ("table", "equation", "code", "authors")
STRETCH = 4096


# ---- what is known of a document


def placed_titles(lines: DataFrame) -> DataFrame:
    """``doc_id, title_from, title_to, title_size`` of placed documents that have a title: the run of the largest lines high
    on the first page.  ``lines`` have ``footnote``, ``body`` and ``first_page``; a first page is one array."""
    front = F.filter(F.sort_array("rows"), lambda r: ~r["footnote"])
    pages = (
        lines.where((F.col("page") == F.col("first_page")) & F.col("y0").isNotNull() & (F.coalesce("body", F.lit(0.0)) != 0)).groupBy("doc_id")
        .agg(F.collect_list(F.struct("line_no", "y0", F.coalesce("size", F.lit(0.0)).alias("size"), F.coalesce("page_h", F.lit(800.0)).alias("page_h"), "footnote")).alias("rows"), F.first("body").alias("body"))
        .select("doc_id", "body", front.alias("front"))
    )
    high = lambda r: r["y0"] < 0.45 * r["page_h"]
    largest = pages.withColumn("largest", F.coalesce(F.array_max(F.transform(F.filter("front", high), lambda r: r["size"])), F.lit(0.0))).where(F.col("largest") >= 1.25 * F.col("body"))
    fits = F.transform("front", lambda r: (r["size"] >= F.col("largest") - 0.6) & high(r))
    begun = largest.withColumn("fits", fits).withColumn("start", F.array_position("fits", True)).where("start > 0")
    # The run ends before the first line behind its start that doesn't fit.
    rest = F.array_position(F.slice("fits", F.col("start"), F.size("fits")), False)
    run = F.slice("front", F.col("start"), F.when(rest == 0, F.size("fits")).otherwise(rest - 1))
    titled = begun.withColumn("run", run)
    return titled.select("doc_id", F.get("run", F.lit(0))["line_no"].alias("title_from"), F.element_at("run", -1)["line_no"].alias("title_to"), F.array_max("run.size").alias("title_size"))


NO_TITLE = {"title_from": "int", "title_to": "int", "title_size": "double"}


def _without_titles(lines: DataFrame) -> DataFrame:
    return lines.withColumns({name: F.lit(None).cast(kind) for name, kind in NO_TITLE.items()})


def short_documents(lines: DataFrame, placed: bool) -> DataFrame:
    """``lines`` with their document's ``body, gap, typical, first_page``, title and ``footnote``, by windows over a document."""
    doc = Window.partitionBy("doc_id")
    marked = layout.measured(layout.mark_footnotes(lines, placed), placed).withColumn("first_page", F.min("page").over(doc))
    return joined(marked, placed_titles(marked), ["doc_id"]) if placed else _without_titles(marked)


def long_documents(lines: DataFrame, placed: bool) -> DataFrame:
    """The same for documents that are too long for a window: what is measured are aggregates, and joined by stretch."""
    measures = lines.groupBy("doc_id").agg(F.min("page").alias("first_page"))
    for found in (layout.typical_length(lines), layout.body_size(lines), layout.base_gap(lines)):
        measures = joined(measures, found, ["doc_id"])
    page = Window.partitionBy("doc_id", "page").orderBy(F.desc("line_no"))
    tails = lines.where("y0 is null").select("doc_id", "page", "stretch", "line_no", layout.note_sign().alias("sign")).withColumn("down", F.row_number().over(page)).where("down <= 4")
    after = F.max("sign").over(Window.partitionBy("doc_id", "page").orderBy("line_no"))
    notes = tails.withColumn("note", after).where("note").groupBy("doc_id", "stretch").agg(F.collect_set("line_no").alias("notes"))
    stretches = joined(lines.select("doc_id", "stretch").distinct(), measures, ["doc_id"])
    marked = joined(lines, joined(stretches, notes, ["doc_id", "stretch"]), ["doc_id", "stretch"])
    footnote = F.when(F.col("y0").isNotNull(), layout.small_print()).otherwise(F.coalesce(F.array_contains("notes", F.col("line_no")), F.lit(False)))
    marked = marked.withColumn("footnote", F.coalesce(footnote, F.lit(False))).drop("notes")
    if not placed:
        return _without_titles(marked)
    stretches = joined(lines.select("doc_id", "stretch").distinct(), placed_titles(marked), ["doc_id"])
    return joined(marked, stretches, ["doc_id", "stretch"])


# ---- letters


def _before() -> Column:
    """What a line is asked by the next one."""
    text = F.col("text")
    return F.struct(
        "page", F.col("y0").isNotNull().alias("placed"), "x0", "x1", "y0", "y1", "size", "bold", C.is_terminal(text).alias("terminal"), text.rlike(r"[.\]]\s*$").alias("closed"),
        F.char_length(text).alias("length"), T.strip(text).endswith(".").alias("stopped"))


def borders(lines: DataFrame) -> DataFrame:
    """``doc_id, stretch`` with what lines of a stretch need from beyond it: ``border`` and ``border_note``, the last line that is
    no footnote and the page of the last that is one before it, and ``beyond``, whether the next two lines are tabular."""
    at = Window.partitionBy("doc_id", "stretch").orderBy("line_no")
    ranked = lines.select("doc_id", "stretch", "line_no", "page", "footnote", _before().alias("before"), F.when(F.row_number().over(at) <= 2, F.struct("line_no", C.is_table_line(F.col("text")).alias("tabular"))).alias("start"))
    edges = ranked.groupBy("doc_id", "stretch").agg(
        F.max_by("before", F.when(~F.col("footnote"), F.col("line_no"))).alias("last"), F.max_by("page", F.when(F.col("footnote"), F.col("line_no"))).alias("last_note"),
        F.transform(F.sort_array(F.collect_list("start")), lambda s: s["tabular"]).alias("starts"))
    doc = Window.partitionBy("doc_id").orderBy("stretch")
    ahead = doc.rowsBetween(Window.unboundedPreceding, -1)
    none = F.array().cast("array<boolean>")
    return edges.select("doc_id", "stretch", F.last("last", ignorenulls=True).over(ahead).alias("border"), F.last("last_note", ignorenulls=True).over(ahead).alias("border_note"),
                        F.concat(F.coalesce(F.lead("starts", 1).over(doc), none), F.coalesce(F.lead("starts", 2).over(doc), none)).alias("beyond"))


def letters(lines: DataFrame, keys: list[str], placed: bool) -> DataFrame:
    """``keys, line_no, page, text`` and ``letter`` of lines with what is known of their document; windows are over ``keys``."""
    order = Window.partitionBy(*keys).orderBy("line_no")
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    text, body = F.col("text"), F.col("body")
    border = "border" in lines.columns
    asked = lines.select(
        "*", _before().alias("own"), C.is_table_line(text).alias("tabular"), C.token_count(text).alias("n_words"), *([F.max("x1").over(Window.partitionBy("doc_id", "page")).alias("page_right")] if placed else []),
    )
    before, note_page = F.last(F.when(~F.col("footnote"), F.col("own")), ignorenulls=True).over(ahead), F.last(F.when(F.col("footnote"), F.col("page")), ignorenulls=True).over(ahead)
    one, two = F.lead("tabular", 1).over(order), F.lead("tabular", 2).over(order)
    if border:
        before, note_page = F.coalesce(before, "border"), F.coalesce(note_page, "border_note")
        one, two = F.coalesce(one, F.get("beyond", F.lit(0))), F.coalesce(two, F.get("beyond", F.when(one.isNull(), 1).otherwise(0)))
    seen = asked.withColumn("before", before).withColumn("note_page", note_page).withColumn("one", one).withColumn("two", two)

    b = F.col("before")
    size, body_or = F.coalesce("size", F.lit(0.0)), F.coalesce(body, F.lit(10.0))
    own_placed, ended = F.col("y0").isNotNull(), b["terminal"]
    lower, linking = text.rlike(r"^\p{Ll}"), text.rlike(r"^(of|for|and|in|with|on|via|to|from)(?!\w)")
    moved = F.col("page") != b["page"]
    unplaced_new = F.col("blank_before") | (moved & ended) | (ended & (b["length"] < 0.7 * F.col("typical")))
    both = own_placed & b["placed"]
    new, new_after_set, front_small, goes_on_heading = unplaced_new, unplaced_new, F.lit(False), F.lit(False)
    known, numbered = C.is_known_section(text), text.rlike(C.NUMBERED)
    if placed:
        jumps = moved | (F.col("y0") < b["y0"] - 1)
        far = F.col("y0") - b["y1"] > F.col("gap") + 0.45 * body_or
        resized = (size > 0) & (F.coalesce(b["size"], F.lit(0.0)) > 0) & (F.abs(size - b["size"]) > 1.0)
        indented = ended & ((b["x1"] < F.col("page_right") - 4 * body_or) | (F.col("x0") > b["x0"] + 1.2 * body_or))
        new = F.when(both, F.when(jumps, ended | ~lower).otherwise(far | resized | indented)).otherwise(unplaced_new)
        new_after_set = F.when(both & jumps, True).otherwise(new)
        front_small = own_placed & (F.coalesce(body, F.lit(0.0)) > 0) & (size > 0) & (size < body - 1.5) & (F.col("n_words") > 10)
        goes_on_heading = both & (F.abs(F.coalesce(b["size"], F.lit(0.0)) - size) < 0.3) & (b["bold"] == F.col("bold")) & ~moved & (F.col("y0") - b["y1"] < F.col("gap") + 2) & ~numbered & ~known
    name = F.lower(F.regexp_replace(F.regexp_replace(text, C.NUMBERING, ""), "^[ .:]+|[ .:]+$", ""))
    inline, reference, stopped = C.is_inline_abstract(text), C.starts_reference(text), text.rlike("[.!?:;]$")
    large = (F.coalesce("title_size", F.lit(0.0)) > 0) & (size >= F.col("title_size") - 0.6)
    level = lambda **where: F.when(large, 0).otherwise(C.heading_level(body, **where))
    bits = {
        "footnote": F.col("footnote"), "note_goes_on": (F.col("note_page") == F.col("page")) & ~text.rlike(r"^[*†‡]|^\d{1,2}\s"), "on_first_page": F.col("page") == F.col("first_page"),
        "title_head": (F.col("md_heading") == 1) | ~(known | (F.col("n_words") > 25) | text.endswith(".")), "title_goes_on": (lower | linking) & ~F.col("blank_before") & (F.col("n_words") <= 12),
        "placed_title": own_placed & (F.coalesce(body, F.lit(0.0)) != 0), "in_placed_title": F.col("line_no").between(F.col("title_from"), F.col("title_to")) & (F.col("page") == F.col("first_page")),
        "level": level(), "level_in_refs": level(in_refs=F.lit(True)), "level_in_front": level(in_front=F.lit(True)), "names_abstract": name == "abstract",
        "names_refs": name.isin("references", "bibliography", "literature cited"), "heading_goes_on": goes_on_heading, "new": new, "new_after_set": new_after_set,
        "front": ~((F.col("n_words") >= 14) | inline | front_small), "inline_abstract": inline, "reference": reference, "closed": b["closed"] | text.startswith("["), "blank_before": F.col("blank_before"),
        "caption": C.is_caption(text), "equation": C.is_equation(text), "same_placing": own_placed == b["placed"], "tabular": F.col("tabular") & (F.col("n_words") <= 30), "open_caption": ~b["stopped"],
        "heads_table": F.col("one") & F.col("two") & (F.col("n_words") <= 10) & ~stopped,
    }
    letter = F.lit(0)
    for bit, test in bits.items():
        value = test if bit.startswith("level") else test.cast("int")
        letter = letter.bitwiseOR(F.shiftleft(F.coalesce(value, F.lit(0)), fold.SHIFT[bit]))
    return seen.select(*keys, "line_no", "page", "text", letter.alias("letter"))


# ---- blocks


POSITION = "state int, n int, block int, note int, section array<string>"


def _numbered(lines: DataFrame, kind: str) -> DataFrame:
    columns = ("doc_id", "stretch", "line_no", "page", "letter", "text", "state", "n", "block", "note", "section")
    return in_arrow(lines.select(*columns), fold.number, f"doc_id {kind}, line_no int, text string, block_no int, type string, page int, level int, section_parts array<string>")


def build_blocks(lines: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """``doc_id, block_no, id, type, page, level, keep, section, text``: titles, authors, abstracts, headings, paragraphs,
    captions, equations, tables, references and footnotes in the order of the document.

    ``lines`` have the columns of ``sources.documents.LINES``; ``line_no`` is the order in a document.  Lines without an id are
    one document, and so are those of rows that repeat an id; an empty table gives an empty one; other columns aren't
    looked at.  Documents with line numbers of ``stretch`` or more are read by stretches, with the same result; which
    these are is counted first, and what is known of their stretches is written to the shared folder.
    """
    kind = lines.schema["doc_id"].dataType.simpleString()
    lines = lines.select("doc_id", *[c.split()[0] for c in LINES.split(", ")])
    placed = not lines.schema["y0"].metadata.get("unplaced", False)
    cut = lines.withColumn("line_no", F.col("line_no").cast("int")).withColumn("stretch", F.floor(F.col("line_no") / stretch).cast("int"))
    long = held(lines.groupBy("doc_id").agg(F.max("line_no").alias("most")).where(F.col("most") >= stretch).select("doc_id"))
    start = [F.lit(0).alias(x) for x in ("state", "n", "block", "note")] + [F.array().cast("array<string>").alias("section")]
    if long.isEmpty():
        short = cut
    else:
        short = joined(cut, long, ["doc_id"], "left_anti")
    one = letters(short_documents(short.repartition("doc_id"), placed), ["doc_id"], placed).sortWithinPartitions("doc_id", "line_no")
    numbered = _numbered(one.select("*", F.lit(0).alias("stretch"), *start), kind)
    if not long.isEmpty():
        keys = ["doc_id", "stretch"]
        found = held(joined(cut, long, ["doc_id"], "left_semi").repartition(*keys))
        known = long_documents(found, placed)
        lettered = held(letters(joined(known, borders(known), keys), keys, placed).repartition(*keys).sortWithinPartitions(*keys, "line_no"))
        tables = in_arrow(lettered.select(*keys, "letter", "text"), fold.summarise, f"doc_id {kind}, stretch int, steps binary, goes_on array<boolean>, heads array<array<string>>")
        entered = held(in_arrow(tables.repartition("doc_id").sortWithinPartitions(*keys), fold.carry, f"doc_id {kind}, stretch int, {POSITION}"))
        numbered = numbered.unionByName(_numbered(joined(lettered, entered, keys).sortWithinPartitions(*keys, "line_no"), kind))
    first = F.struct("type", "page", "level")
    grouped = numbered.groupBy("doc_id", "block_no").agg(
        F.min_by(first, F.when(F.col("type").isNotNull(), F.col("line_no"))).alias("first"), F.max_by("section_parts", F.when(F.col("section_parts").isNotNull(), F.col("line_no"))).alias("section_parts"),
        F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("line_no", "text")))).alias("rows"))
    texts = grouped.select("doc_id", "block_no", "first.*", "section_parts", F.col("rows.text").alias("parts"))
    parts = F.col("parts")
    text = F.when(F.col("type").isin(*BY_LINE), F.array_join(parts, "\n")).when(F.col("type") == "footnote", T.join_lines(F.array(F.array_join(parts, " ")))).otherwise(T.join_lines(parts))
    section = F.when(F.size("section_parts") == 1, F.col("section_parts")[0]).otherwise(T.join_lines(F.col("section_parts")))
    return texts.select("doc_id", "block_no", F.concat(F.lit("b"), "block_no").alias("id"), "type", "page", "level", F.col("type").isin(*KEEP).alias("keep"), section.alias("section"), text.alias("text"))


def titles(blocks: DataFrame) -> DataFrame:
    """``doc_id, title``: the first title block's text."""
    return blocks.groupBy("doc_id").agg(F.coalesce(F.min_by(F.when(F.col("type") == "title", F.col("text")), F.when(F.col("type") == "title", F.col("block_no"))), F.lit("")).alias("title"))


def states(lines: DataFrame) -> DataFrame:
    """``lines`` with ``state``: the part of the document each stands in, by the known section names alone."""
    name = F.lower(F.regexp_replace(F.regexp_replace("text", C.NUMBERING, ""), "^[ .:]+|[ .:]+$", ""))
    turn = F.when(C.is_known_section(F.col("text")), F.when(name == "abstract", "abstract").when(name.isin("references", "bibliography", "literature cited"), "refs").otherwise("body"))
    order = Window.partitionBy("doc_id").orderBy("line_no")
    return lines.withColumn("state", F.coalesce(F.last(turn, ignorenulls=True).over(order), F.lit("start")))
