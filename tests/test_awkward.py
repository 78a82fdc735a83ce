"""Document operators on empty tables, null ids and texts, and repeated rows."""

from tessera.operators import chunks, glossary, layout, progress, quality, render
from tessera.sources import documents as D
from tests import rows as R

BLOCKS = "doc_id long, block_no int, id string, type string, page int, level int, keep boolean, section string, text string"
DONE = "doc_id long, block_id string, text string"
ROWS = [(None, 1, "b1", "title", 1, 0, False, "", "A title"), (None, 2, "b2", "paragraph", 1, 0, False, "", "The sensor reads 12.5 and 31."), (3, 1, "b1", "paragraph", 1, 0, False, "", None), (3, 2, "b2", "paragraph", None, 0, False, None, "")]
TRANSLATED = [(None, "b2", "cảm biến đọc 12,5"), (None, "b2", "cảm biến đọc 12,5"), (None, "b1", ""), (None, "b1", None), (9, "b1", "x"), (None, None, "y")]


def test_empty_tables(spark):
    blocks, done, terms = spark.createDataFrame([], BLOCKS), spark.createDataFrame([], DONE), R.layers(spark).where("false")
    planned, merged = chunks.plan_chunks(blocks), glossary.merge_layers(terms)
    assert chunks.summarise(planned).count() == chunks.chunk_files(planned).count() == chunks.report(blocks).count() == chunks.outline(blocks).count() == 0
    assert render.html_documents(blocks, done).count() == render.markdown_documents(blocks, done).count() == quality.check(blocks, done, merged).count() == 0
    assert quality.summary(blocks, done, quality.check(blocks, done, merged)).count() == progress.by_chunk(planned, done).count() == progress.status_json(progress.by_chunk(planned, done)).count() == 0
    assert glossary.lookup(spark.createDataFrame([], "doc_id long, text string"), merged, "doc_id").count() == glossary.show(merged, "").count() == glossary.export(merged).count() == 0
    assert layout.reading_order(D.lines(spark.createDataFrame([], "doc_id long, text string"))).count() == layout.furniture(D.lines(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_null_ids_and_repeats(spark):
    blocks, done, merged = spark.createDataFrame(ROWS, BLOCKS), spark.createDataFrame(TRANSLATED, DONE), glossary.merge_layers(R.layers(spark))
    planned = chunks.plan_chunks(blocks, 100)
    assert {r.doc_id for r in chunks.chunk_files(planned).collect()} == {None, 3}
    assert {(r.doc_id, r.need, r.have) for r in progress.by_chunk(planned, done).collect()} == {(None, 2, 1), (3, 2, 0)}
    assert [(r.doc_id, r.id, r.target) for r in quality.align(blocks, done).collect()] == [(None, "b2", "cảm biến đọc 12,5")]
    issues = quality.check(blocks, done, merged)
    assert [(r.doc_id, r.block, r.detail) for r in issues.where("code = 'number'").collect()] == [(None, "b2", "31")]
    assert issues.where("code = 'term'").count() == 0
    pages = {r.doc_id: r for r in render.html_documents(blocks, done).collect()}
    assert set(pages) == {None, 3} and pages[None].body.count("cảm biến") == 1
    lines = D.lines(spark.createDataFrame([(None, "one\ntwo"), (1, None)], "doc_id long, text string"))
    assert [(r.doc_id, r.place) for r in layout.reading_order(lines).orderBy("place").collect()] == [(None, 1), (None, 2)]
    pairs = spark.createDataFrame([(1, None, "x 22"), (1, "x 33", None), (None, None, None)], "id long, source string, target string")
    assert quality.pair_issues(pairs, "id").count() == 0
    found = glossary.lookup(spark.createDataFrame([(None, "a sensor"), (None, "sensors"), (2, None)], "doc_id long, text string"), merged, "doc_id")
    assert [(r.doc_id, r.key, r.n) for r in found.collect()] == [(None, "sensor", 2)]
