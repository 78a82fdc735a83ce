"""Blocks against a plain fold over each document's lines, one after the other."""

import random
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as T
from tessera.operators import blocks, fold, layout
from tessera.operators import classify as C
from tessera.sources import documents as D


def plain_features(lines: DataFrame) -> DataFrame:
    """``lines`` (after ``mark_footnotes``) with everything that the fold asks of a line or a document."""
    text = F.col("text")
    marked = layout.measured(lines)
    name = F.lower(F.regexp_replace(F.regexp_replace(text, C.NUMBERING, ""), "^[ .:]+|[ .:]+$", ""))
    body = F.col("body")
    first = F.min("page").over(Window.partitionBy("doc_id").orderBy("line_no"))
    right = F.max("x1").over(Window.partitionBy("doc_id", "page"))
    return marked.select(
        "*", F.col("y0").isNotNull().alias("placed"), C.heading_level(body).alias("level"), C.heading_level(body, in_refs=F.lit(True)).alias("level_in_refs"),
        C.heading_level(body, in_front=F.lit(True)).alias("level_in_front"), name.alias("name"), C.token_count(text).alias("n_words"), C.is_known_section(text).alias("known"),
        text.rlike(C.NUMBERED).alias("numbered"), C.is_caption(text).alias("caption"), C.is_equation(text).alias("equation"), C.is_table_line(text).alias("tabular"),
        C.starts_reference(text).alias("reference"), C.is_inline_abstract(text).alias("inline_abstract"), C.is_terminal(text).alias("terminal"), text.rlike("[.!?:;]$").alias("stopped"),
        text.rlike(r"[.\]]\s*$").alias("closed"), text.rlike(r"^\p{Ll}").alias("lower_start"), text.rlike(r"^(of|for|and|in|with|on|via|to|from)(?!\w)").alias("linking_start"),
        text.rlike(r"^[*†‡]|^\d{1,2}\s").alias("note_start"), (F.col("page") == first).alias("on_first_page"), right.alias("page_right"))


def _number(x, other: float = 0.0) -> float:
    return other if x is None or x != x else float(x)


def _title_lines(rows: list[dict]) -> set[int]:
    """Which lines make the title: the run of the largest lines high on the first page, or the first line and those that
    go on with it."""
    front = [r for r in rows if r["on_first_page"] and not r["footnote"]]
    if not front:
        return set()
    body = _number(front[0]["body"])
    if front[0]["placed"] and body:
        high = [r for r in front if r["y0"] < 0.45 * _number(r["page_h"], 800.0)]
        largest = max((_number(r["size"]) for r in high), default=0.0)
        if largest < 1.25 * body:
            return set()
        fits = [_number(r["size"]) >= largest - 0.6 and r in high for r in front]
        start = fits.index(True)
        stop = next((k for k in range(start, len(front)) if not fits[k]), len(front))
        return {r["line_no"] for r in front[start:stop]}
    head = front[0]
    if head["md_heading"] != 1 and (head["known"] or head["n_words"] > 25 or head["text"].endswith(".")):
        return set()
    chosen = {head["line_no"]}
    for r in front[1:3]:
        if not (r["lower_start"] or r["linking_start"]) or r["blank_before"] or r["n_words"] > 12:
            break
        chosen.add(r["line_no"])
    return chosen


@dataclass
class _Fold:
    """The blocks so far, the block in progress and the part of the document it stands in."""

    title: set[int]
    title_size: float
    done: list[dict] = field(default_factory=list)
    notes: list[dict] = field(default_factory=list)
    open: dict | None = None
    last: dict | None = None
    previous: dict | None = None
    section: list[str] = field(default_factory=list)
    state: str = "start"

    def close(self) -> None:
        if self.open:
            self.done.append(self.open)
        self.done += [note | {"section_parts": self.section} for note in self.notes]
        self.open, self.notes = None, []

    def begin(self, kind: str, row: dict, level: int = 0) -> None:
        self.close()
        self.open = {"type": kind, "page": row["page"], "level": level, "parts": [row["text"]], "section_parts": self.section}
        self.last = row

    def add(self, row: dict) -> None:
        self.open["parts"].append(row["text"])
        self.last = row

    @property
    def kind(self) -> str | None:
        return self.open["type"] if self.open else None

    def note(self, row: dict) -> None:
        if self.notes and self.notes[-1]["page"] == row["page"] and not row["note_start"]:
            self.notes[-1]["parts"][0] += " " + row["text"]
        else:
            self.notes.append({"type": "footnote", "page": row["page"], "level": 0, "parts": [row["text"]]})

    def breaks(self, row: dict) -> bool:
        """Whether a line starts a paragraph, by its distance from the line before and by how that one ends."""
        before = self.previous
        if self.open is None or self.kind in ("heading", "title"):
            return True
        if before is None:
            return False
        ended, body = self.last["terminal"], _number(row["body"], 10.0)
        if not (row["placed"] and before["placed"]):
            moved = row["page"] != before["page"] and ended
            return row["blank_before"] or moved or (ended and len(before["text"]) < 0.7 * row["typical"])
        if row["page"] != before["page"] or row["y0"] < before["y0"] - 1:
            return ended or not row["lower_start"] or self.kind in ("table", "equation", "caption", "authors")
        if row["y0"] - before["y1"] > row["gap"] + 0.45 * body:
            return True
        if _number(row["size"]) and _number(before["size"]) and abs(row["size"] - before["size"]) > 1.0:
            return True
        return ended and (before["x1"] < row["page_right"] - 4 * body or row["x0"] > before["x0"] + 1.2 * body)

    def goes_on_heading(self, row: dict) -> bool:
        before = self.previous
        return bool(
            self.kind == "heading" and before and before["placed"] and row["placed"] and abs(_number(before["size"]) - _number(row["size"])) < 0.3
            and before["bold"] == row["bold"] and before["page"] == row["page"] and row["y0"] - before["y1"] < row["gap"] + 2 and not row["numbered"] and not row["known"])

    def heading(self, row: dict, level: int) -> None:
        if self.goes_on_heading(row):
            self.add(row)
            self.section = list(self.open["parts"])
            return
        self.begin("heading", row, level)
        self.section = [row["text"]]
        self.state = "abstract" if row["name"] == "abstract" else "refs" if row["name"] in ("references", "bibliography", "literature cited") else "body"

    def in_front(self, row: dict) -> bool:
        """Takes a line of the authors; False for the first line that isn't one."""
        small = row["placed"] and _number(row["body"]) and _number(row["size"]) and row["size"] < row["body"] - 1.5 and row["n_words"] > 10
        if row["n_words"] >= 14 or row["inline_abstract"] or small:
            self.state = "body"
            return False
        self.add(row) if self.kind == "authors" else self.begin("authors", row)
        return True

    def in_refs(self, row: dict) -> None:
        entry = row["reference"] and (self.kind != "reference" or self.last["closed"] or row["text"].startswith("["))
        if not entry and self.kind == "reference" and not (row["blank_before"] and row["reference"]):
            self.add(row)
        else:
            self.begin("reference", row)

    def in_body(self, row: dict, coming: list[dict]) -> None:
        new, kind = self.breaks(row), self.kind
        if self.state == "authors" and self.in_front(row):
            return
        if self.state == "refs":
            return self.in_refs(row)
        heads_table = len(coming) == 2 and coming[0]["tabular"] and coming[1]["tabular"] and row["n_words"] <= 10 and not row["stopped"]
        if row["caption"]:
            self.begin("caption", row)
        elif row["equation"]:
            same = kind == "equation" and not new and self.previous and self.previous["placed"] == row["placed"]
            self.add(row) if same else self.begin("equation", row)
        elif row["tabular"] and row["n_words"] <= 30:
            open_caption = kind == "caption" and not new and not self.last["text"].rstrip().endswith(".")
            self.add(row) if kind == "table" or open_caption else self.begin("table", row)
        elif heads_table and not (kind == "paragraph" and not new):
            self.begin("table", row)
        elif not (new or kind in ("equation", "table")):
            self.add(row)
        elif row["inline_abstract"] and self.state != "abstract":
            self.begin("abstract", row)
            self.state = "abstract-inline"
        else:
            self.begin("abstract" if self.state == "abstract" else "paragraph", row)

    def take(self, row: dict, coming: list[dict]) -> None:
        if row["footnote"]:
            return self.note(row)
        if row["line_no"] in self.title:
            self.add(row) if self.kind == "title" else self.begin("title", row)
            self.state = "authors"
        else:
            level = row["level_in_refs"] if self.state == "refs" else row["level_in_front"] if self.state == "authors" else row["level"]
            if self.title_size and _number(row["size"]) >= self.title_size - 0.6:
                level = 0
            self.heading(row, int(level)) if level else self.in_body(row, coming)
        self.previous = row


def plain_blocks(lines):
    """(doc_id, block_no, type, page, level, section parts, parts) of every document."""
    documents = {}
    for row in plain_features(layout.mark_footnotes(lines)).orderBy("line_no").collect():
        documents.setdefault(row.doc_id, []).append(row.asDict())
    found = []
    for doc, rows in documents.items():
        title = _title_lines(rows)
        state = _Fold(title, max((_number(r["size"]) for r in rows if r["line_no"] in title), default=0.0))
        for k, row in enumerate(rows):
            state.take(row, rows[k + 1 : k + 3])
        state.close()
        found += [(doc, k, b["type"], b["page"], b["level"], b["section_parts"], b["parts"]) for k, b in enumerate(state.done, 1)]
    return found


def as_text(spark, rows):
    """Plain blocks with the text and section that ``build_blocks`` gives."""
    if not rows:
        return []
    made = spark.createDataFrame(rows, "doc_id long, block_no int, type string, page int, level int, section_parts array<string>, parts array<string>")
    text = F.when(F.col("type").isin(*blocks.BY_LINE), F.array_join("parts", "\n")).otherwise(T.join_lines(F.col("parts")))
    section = F.when(F.size("section_parts") == 1, F.col("section_parts")[0]).otherwise(T.join_lines(F.col("section_parts")))
    return made.select("doc_id", "block_no", "type", "page", "level", section.alias("section"), text.alias("text")).collect()


SHAPES = [
    "Abstract", "References", "1 Introduction", "2.1 Tools and Beds", "3 Results.", "Conclusion", "IV. Outlook", "A Short Title", "of several rows", "and more of it", "Ines Okoro and Pavel Dvorak",
    "A sentence that ends here, with enough words to count as the text of a paragraph of a certain length.", "a line that goes on without any end and is of the usual length of lines in this text",
    "ends short.", "Abstract: what was done and why it matters to all of us who read such things every day.", "Figure 2: beds at noon", "Table 1. Yields", "y = a * x + b / c  (3)", "q = {x + y} / z * k = 1",
    "Uniform  86.1 ± 0.9  90.4 ± 0.5", "12 13 14 15", "name  value  unit  note", "Yields by bed", "[1] A. Author. A title. 2011.", "[2] B. Writer. Another one", "with a second line. 2012.", "Okoro, I. A third. 2013.",
    "* a note at the foot", "that goes on", "† another one", "12 a number that starts a note", "§", "under-", "ground water was", "",
]


def random_texts(rng, n):
    texts = []
    for _ in range(n):
        lines = [rng.choice(SHAPES) for _ in range(rng.randrange(0, 45))]
        if rng.random() < 0.5:
            lines = ["A Short Title", "of several rows", *["Ines Okoro"] * rng.randrange(3), "Abstract", *lines]
        texts.append("".join(x + rng.choice(["\n", "\n", "\n", "\n\n", "\f"] if rng.random() < 0.3 else ["\n"]) for x in lines))
    return texts


def compare(spark, lines, stretches):
    want = sorted(map(tuple, as_text(spark, plain_blocks(lines))), key=repr)
    for stretch in stretches:
        found = blocks.build_blocks(lines, stretch)
        assert found.columns == ["doc_id", "block_no", "id", "type", "page", "level", "keep", "section", "text"]
        rows = found.collect()
        assert all(r.id == f"b{r.block_no}" and r.keep == (r.type in blocks.KEEP) for r in rows)
        assert sorted(((r.doc_id, r.block_no, r.type, r.page, r.level, r.section, r.text) for r in rows), key=repr) == want, stretch


def test_texts(spark):
    """Whole, and cut into stretches of one and of seven lines; one document has no id."""
    texts = random_texts(random.Random(11), 90)
    docs = spark.createDataFrame([(k or None, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    kinds = {r.type for r in blocks.build_blocks(D.lines(docs)).select("type").distinct().collect()}
    assert kinds == {*fold.KINDS[1:], "footnote"}
    compare(spark, layout.drop_furniture(D.lines(docs)), (blocks.STRETCH, 1, 7))


def random_pages(rng, n):
    rows = []
    for doc in range(1, n + 1):
        line = 0
        for page in range(1, rng.randrange(2, 4)):
            y = 40.0
            for _ in range(rng.randrange(1, 22)):
                line += 1
                size = rng.choice([10.0, 10.0, 10.0, 10.0, 12.0, 18.0, 8.0, None])
                y = 730.0 + rng.randrange(40) if rng.random() < 0.1 else y + rng.choice([12, 13, 13, 14, 30]) if rng.random() < 0.95 else 60.0
                x = rng.choice([50.0, 50.0, 62.0, 80.0])
                rows.append((doc, page, line, rng.choice(SHAPES[:-1]), x, y, x + rng.choice([480.0, 480.0, 200.0]), y + 11, size, rng.random() < 0.2, 600.0, 800.0, False, 0, False))
    return rows


def test_pages(spark):
    """Lines with places, sizes and weights."""
    schema = "doc_id long, page int, line_no int, text string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, page_w double, page_h double, blank_before boolean, md_heading int, footnote boolean"
    lines = spark.createDataFrame(random_pages(random.Random(12), 60), schema).repartition(3)
    compare(spark, lines, (blocks.STRETCH, 4))


def test_empty_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "A Title\nIntroduction\nSome text."), (2, ""), (3, None)], "doc_id long, text string")
    assert blocks.build_blocks(D.lines(docs.where("false"))).count() == 0
    lines = D.lines(docs).withColumns({x: F.lit(9) for x in ("stretch", "letter", "state", "n", "body", "notes", "before", "own", "one", "border")})
    assert [(r.block_no, r.type) for r in blocks.build_blocks(lines, 2).orderBy("block_no").collect()] == [(1, "title"), (2, "heading"), (3, "paragraph")]


def test_stretches_compose():
    """A stretch tells for every state what reading its lines one by one from that state does."""
    rng = random.Random(13)
    for _ in range(30):
        lines = [(rng.getrandbits(29), f"t{k}") for k in range(rng.randrange(12))]
        stretch = fold.Stretch()
        for letter, text in lines:
            stretch.take(letter, text)
        table, goes_on, heads = stretch.packed()
        for state in rng.sample(range(fold.STATES), 40):
            entered = fold.Position(state, 7, 5, 6, ["above"])
            at = fold.Position(state, 7, 5, 6, ["above"])
            for letter, text in lines:
                at.take(letter, text)
            assert fold.after(entered, table, goes_on, heads) == at
    assert np.frombuffer(fold.Stretch().packed()[0], "<i4").reshape(5, -1)[0].tolist() == list(range(fold.STATES))
