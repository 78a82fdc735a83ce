import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import blocks, chunks, classify, glossary, layout, progress, quality, render
from tessera.sources import documents as D
from tests import rows as R


def text_lines(spark, text, markdown=False):
    return D.lines(spark.createDataFrame([(1, text)], "doc_id long, text string"), markdown=markdown)


@pytest.fixture(scope="module")
def log(spark):
    return blocks.build_blocks(layout.drop_furniture(text_lines(spark, R.LOG))).cache()


def test_kinds_of_a_log(log):
    rows = log.orderBy("block_no").collect()
    assert [r.type for r in rows] == ["title", "heading", "paragraph", "heading", "paragraph", "heading", "paragraph", "equation", "table", "heading", "reference"]
    assert rows[1].text == "Setup" and rows[2].section == "Setup" and rows[6].section == "2 Wet weeks" and rows[8].text == "Week 21 22 23\nRain 40 52 61"
    assert [r.type for r in rows if r.keep] == ["equation", "table", "reference"]


def test_running_lines_by_a_plain_rule(spark):
    """Random pages: what stands at the edges of half of the pages, numbers aside, goes; so do page numbers there."""
    rng, edges = random.Random(21), ["Vol. 3, No. 4", "Meadow and Pasture", "p. 12", "a line of its own", "Vol. 9, No. 8", "17", "page 3 of 9", "one line more than ten words long would be left alone as it is"]
    mask = lambda t: re.sub(r"\d+", "#", t.lower())
    for _ in range(6):
        pages = [[rng.choice(edges) for _ in range(rng.randrange(1, 9))] for _ in range(rng.randrange(2, 7))]
        edge = lambda page, k: (k < 2 or k >= len(page) - 2) and len(page[k].split()) <= 10
        masks = [{mask(t) for k, t in enumerate(page) if edge(page, k)} for page in pages]
        running = {m for m in set().union(*masks) if sum(m in x for x in masks) >= max(2, len(pages) / 2)}
        want = [(p, t) for p, page in enumerate(pages, 1) for k, t in enumerate(page) if not (edge(page, k) and (mask(t) in running or re.fullmatch(r"(page )?\d{1,4}( of \d+)?", t)))]
        lines = text_lines(spark, "\f".join("\n".join(page) for page in pages))
        found = [(r.page, r.text) for r in layout.drop_furniture(lines).orderBy("line_no").collect()]
        by_window = [(r.page, r.text) for r in layout.drop_furniture(lines.drop("up", "down")).orderBy("line_no").collect()]
        assert found == want and by_window == want


def test_markdown_headings(spark):
    found = blocks.build_blocks(text_lines(spark, "# Beds\n\n## Abstract\nA few words.\n\n## 3.2 Tools\nSpades and rakes.\n", True)).orderBy("block_no").collect()
    assert [(r.text, r.level) for r in found if r.type == "heading"] == [("Abstract", 1), ("3.2 Tools", 2)]
    assert found[0].type == "title" and found[2].type == "abstract"


def placed(spark, rows):
    columns = "doc_id long, page int, line_no int, text string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, page_w double, page_h double, blank_before boolean, md_heading int, footnote boolean"
    return spark.createDataFrame([(1, 1, k, t, *map(float, box), float(size), bold, 600.0, 800.0, False, 0, False) for k, (t, box, size, bold) in enumerate(rows, 1)], columns)


def test_two_columns(spark):
    """Two bands of two columns below crossing lines."""
    rows, want = [], []
    for band in range(2):
        top = 100 + 200 * band
        rows.append((f"across {band}", (80, top - 20, 520, top - 8), 12, False))
        rows += [(f"{side} {band}.{i}", (x, top + 15 * i, x + 230, top + 15 * i + 11), 10, False) for i in range(5) for side, x in (("l", 40), ("r", 330))]
        want += [f"across {band}", *[f"{side} {band}.{i}" for side in "lr" for i in range(5)]]
    assert [r.text for r in layout.reading_order(placed(spark, rows)).orderBy("place").collect()] == want


def test_rows_are_merged(spark):
    rows = [
        ("u = v * w", (150, 200, 260, 211), 9, False), ("(7)", (500, 201, 520, 210), 9, False), ("and", (262, 199, 290, 212), 12, False), ("so on", (290.2, 200, 330, 211), 9, False),
        ("below", (150, 240, 200, 251), 9, False), ("under it", (150, 243, 210, 254), 9, False),
    ]
    merged = layout.merge_rows(layout.reading_order(placed(spark, rows))).orderBy("y0").collect()
    assert [r.text for r in merged] == ["u = v * w andso on  (7)", "below", "under it"]
    assert (merged[0].x0, merged[0].x1, merged[0].y0, merged[0].y1, merged[0].size) == (150, 520, 199, 212, 9)
    assert layout.merge_rows(layout.reading_order(placed(spark, rows)).where("false")).count() == 0


def test_geometry_blocks(spark):
    rows = [("A Large Title", (100, 50, 500, 70), 18, True), ("1 Introduction", (50, 200, 200, 212), 12, True)]
    rows += [(f"body line number {i} goes on and on", (50, 220 + 14 * i, 550, 232 + 14 * i), 10, False) for i in range(4)]
    found = blocks.build_blocks(placed(spark, rows)).orderBy("block_no").collect()
    assert [r.type for r in found] == ["title", "heading", "paragraph"]
    sizes = {r.doc_id: r.body for r in layout.body_size(placed(spark, rows)).collect()}
    assert sizes == {1: 10.0} and layout.base_gap(placed(spark, rows)).first().gap == 2.0


@pytest.mark.parametrize(("text", "expected"), [
    ("h_t <- g * h_t + (1 - g) * R(k(z_t; m), q_t)  (4)", True), ("r(z | q) = sigmoid(K m + c)", True), ("They kept the water level at 0.035 for each bed.", False),
    ("Let B = {(z_t, q_t)}, t = 1..M, be the weighed beds and k(z; m) a curve with slopes m.", False)])
def test_equations(spark, text, expected):
    assert spark.range(1).select(classify.is_equation(F.lit(text))).first()[0] is expected


@pytest.mark.parametrize(("text", "expected"), [
    ("Uniform  86.1 ± 0.9  90.4 ± 0.5  93.2 ± 0.3  52.0", True), ("Uniform 86.1 ± 0.9 90.4 ± 0.5 93.2 ± 0.3 52.0", True), ("We report the mean accuracy over 5 seeds in Table 1.", False), ("", False)])
def test_table_lines(spark, text, expected):
    assert spark.range(1).select(classify.is_table_line(F.lit(text))).first()[0] is expected


def test_footnotes(spark):
    found = layout.mark_footnotes(text_lines(spark, "a\nb\nc\n* a note here\nthat goes on")).orderBy("line_no").collect()
    assert [r.footnote for r in found] == [False, False, False, True, True]


def test_chunks_cover_blocks_in_order(spark, log):
    planned = chunks.plan_chunks(log, 30)
    rows = planned.orderBy("block_no").collect()
    numbers = [r.chunk_no for r in rows]
    assert numbers == sorted(numbers) and numbers[0] == 1 and len(rows) == log.count()
    listed = [x for r in chunks.summarise(planned).orderBy("chunk_no").collect() for x in r.blocks]
    assert listed == [r.id for r in rows]
    content = chunks.chunk_files(planned).orderBy("file").first().content
    assert content.startswith("<!-- chunk-01 | ") and "<!-- b1 | title | p1 -->\nRain Gauge Log of the Upper Meadow\n" in content


def test_seeded_errors(spark):
    codes = {(r.id, r.code) for r in quality.pair_issues(spark.createDataFrame(R.PAIRS, "id long, source string, target string"), "id").collect()}
    assert {(1, "number"), (1, "citation"), (1, "pronoun"), (2, "verbatim"), (2, "we"), (3, "calque"), (3, "passive"), (5, "untranslated"), (6, "citation")} <= codes
    assert (2, "citation") not in codes and not [c for c in codes if c[0] == 4]


def test_check_and_summary(spark, log):
    merged = glossary.merge_layers(R.layers(spark))
    done = spark.createDataFrame([(1, "b3", "Chúng ta đo mùa gặt một cách tốt."), (1, "b5", "")], "doc_id long, block_id string, text string")
    issues = quality.check(log, done, merged)
    codes = {r.code for r in issues.collect()}
    assert {"number", "citation", "calque", "we"} <= codes
    row = quality.summary(log, done, issues).first()
    assert row.to_translate == 8 and row.translated == 1 and row.warnings >= 2
    assert quality.ordered(issues).first().level == "warn"


def test_progress(spark, log):
    planned = chunks.plan_chunks(log, 30)
    done = spark.createDataFrame([(1, r.id, "x") for r in planned.where("chunk_no = 1 and not keep").collect()], "doc_id long, block_id string, text string")
    states = {r.chunk_no: r.state for r in progress.by_chunk(planned, done).collect()}
    assert states[1] == "done" and set(states.values()) <= {"done", "todo", "keep-only"}
    assert progress.next_chunk(progress.by_chunk(planned, done)).first().chunk_no == min(k for k, s in states.items() if s == "todo")
    assert [r.block_id for r in D.unknown_ids(spark.createDataFrame([(1, "b1", "x"), (1, "b99", "y")], "doc_id long, block_id string, text string"), log).collect()] == ["b99"]


def test_inline():
    assert render.inline_html("a **b** *c* `x<y` [3, 4] $a*b*c$ <i>") == 'a <strong>b</strong> <em>c</em> <code>x&lt;y</code> <span class="cite">[3, 4]</span> <span class="math">$a*b*c$</span> &lt;i&gt;'
    assert render.inline_html("see https://e.org/a_b. ok") == 'see <a href="https://e.org/a_b" rel="noopener noreferrer" target="_blank">https://e.org/a_b</a>. ok'


def test_inline_takes_code_before_formulas():
    assert render.inline_html("$a `b$ c`") == "$a <code>b$ c</code>"
    assert render.inline_html("$u `v` w$") == '<span class="math">$u <code>v</code> w$</span>'


def test_first_uses_of_other_terms_with_a_paper_glossary(spark):
    """What counts is whether the glossary has entries of the paper's own, also where the document uses none."""
    pairs = spark.createDataFrame([(1, "b1", 1, "paragraph", "each sensor", "mỗi cảm biến")], "doc_id long, id string, block_no int, type string, source string, target string")
    layers = R.layers(spark)
    for chosen, told in ((layers.where("prec = 0"), 1), (layers, 0)):
        merged = glossary.merge_layers(chosen)
        assert quality.term_issues(quality.term_uses(pairs, merged), merged).where("code = 'first-use'").count() == told


def test_panel_leaves_out_generic_terms(spark):
    merged = glossary.merge_layers(R.layers(spark))
    found = spark.createDataFrame([("token", 4), ("harvest", 2)], "key string, n long")
    assert [(r.en, r["count"]) for r in progress.panel_terms(found, merged).collect()] == [("mulch", 0), ("Soil Moisture", 0), ("harvest", 2)]


def test_mini_markdown():
    shown = render.markdown_html("# T\n\n- a\n  more\n- b\n\n1. x\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n> q\n\n```\n<x>\n```\ntext\nmore")
    for part in ("<h2>T</h2>", "<ul><li>a more</li><li>b</li></ul>", "<ol><li>x</li></ol>", "<th>a</th>", "<td>2</td>", "<blockquote><p>q</p></blockquote>", "<pre>&lt;x&gt;</pre>", "<p>text more</p>"):
        assert part in shown


def test_render(spark, log):
    done = spark.createDataFrame([(1, "b1", "Một <b>"), (1, "b3", "Tóm tắt")], "doc_id long, block_id string, text string")
    page = render.html_documents(log, done).first()
    assert page.title == "Một &lt;b&gt;" and "Chưa dịch" in page.body and '<li class="l1"><a href="#b2">Setup</a></li>' in page.toc and "Tóm tắt" in page.body
    assert render.html_documents(log, done, summary_only=True).first().body == ""
    text = render.markdown_documents(log, done, bilingual=True).first().markdown
    assert text.startswith("# Một <b>\n\n*Rain Gauge Log of the Upper Meadow*") and "> The gauge stands on a post." in text and "*(chưa dịch)*" in text and "\n\n\n" not in text


def test_streaming(spark, tmp_path):
    from tessera.streaming import incremental

    rows = [(k, R.LOG, "en", "s", 1) for k in range(2)]
    spark.createDataFrame(rows, incremental.DOCS).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        incremental.start(incremental.stream_documents(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"), 30).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).select("doc_id").distinct().count() == 2


def test_no_pdf_library():
    try:
        import pypdf  # noqa: F401
    except ImportError:
        with pytest.raises(D.MissingDependency):
            D.pdf_engine()
    with pytest.raises(ValueError):
        D.pdf_engine("other")
