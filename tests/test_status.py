"""Status by batch and while translations arrive, and lists that keep a few entries."""

import json
import random

from pyspark.sql import functions as F

from tessera.operators import chunks, lists, progress
from tessera.streaming import status

BLOCKS = "doc_id long, block_no int, id string, type string, keep boolean, section string, text string"


def plan(spark, rng, docs=6):
    rows = [(d, k, f"b{k}", "paragraph", rng.random() < 0.2, "", "w " * rng.randrange(1, 9)) for d in range(docs) for k in range(1, rng.randrange(2, 30))]
    return chunks.plan_chunks(spark.createDataFrame(rows, BLOCKS), 12).cache(), rows


def test_totals_are_those_of_the_batch(spark, tmp_path):
    """Translations in any order over several batches: repeated, empty, null, of unknown blocks and documents."""
    rng = random.Random(31)
    planned, rows = plan(spark, rng)
    sent = [(d, i, rng.choice(["x", "y", "", None])) for d, _, i, *_ in rows if rng.random() < 0.7 for _ in range(rng.randrange(1, 3))]
    sent += [(0, "b999", "x"), (0, "b999", "y"), (77, "b1", "x"), (None, "b1", "x"), (1, None, "x")]
    rng.shuffle(sent)
    schema = spark.createDataFrame([], status.TRANSLATIONS).schema
    for part in range(3):
        spark.createDataFrame(sent[part::3], status.TRANSLATIONS).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={part}"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part=*"))
        status.start(stream, planned, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        arrived = spark.createDataFrame([r for p in range(part + 1) for r in sent[p::3]], status.TRANSLATIONS)
        want = {r.doc_id: (r.total, r.done, r.words_total, r.words_done) for r in progress.totals(progress.by_chunk(planned, arrived)).collect()}
        found = {r.doc_id: tuple(r)[1:] for r in status.totals(spark, str(tmp_path / "out"), planned).collect()}
        assert {d: x[:4] for d, x in found.items() if d != 77} == want
    assert found[0][4] == 1 and found[77] == (0, 0, 0, 0, 1)


def test_first_few(spark):
    rng = random.Random(32)
    rows = [(rng.choice([None, 1, 2]), rng.randrange(20), rng.choice([None, *"abcdef"])) for _ in range(300)]
    for most in (1, 6, 500):
        found = lists.first_few(spark.createDataFrame(rows, "k int, o int, v string").repartition(4), ["k"], ["o"], F.col("v"), most, "few").collect()
        want = {k: sorted((o, v) for x, o, v in rows if x == k and v is not None) for k in (None, 1, 2)}
        assert {r.k: (r.few, r.n_few) for r in found} == {k: ([v for _, v in x[:most]], len(x)) for k, x in want.items()}
    plan = lists.first_few(spark.range(10).selectExpr("id % 2 as k", "id as o", "cast(id as string) as v"), ["k"], ["o"], F.col("v"), 3, "few")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_status_text_and_json(spark):
    rows = [(1, k, f"b{k}", "paragraph", False, "", "w " * 8) for k in range(1, 30)] + [(2, 1, "b1", "paragraph", True, "", "w")]
    planned = chunks.plan_chunks(spark.createDataFrame(rows, BLOCKS), 100)
    done = spark.createDataFrame([(1, f"b{k}", "x") for k in (*range(1, 16), 17)], "doc_id long, block_id string, text string")
    found = progress.by_chunk(planned, done)
    assert [r.line for r in progress.status_lines(found).where("doc_id = 1").orderBy("chunk_no").collect()] == [
        "chunk-01  done      15/15 ~120 words", "chunk-02  partial   1/14 ~112 words  missing: b16, b18, b19, b20, b21, b22, b23, b24, b25, b26 ..."]
    told = {r.doc_id: (r.header, r.next) for r in progress.status(found).collect()}
    assert told == {1: ("translated blocks: 16/29 (55%)", "Next: translate chunks/chunk-02.en.md -> translations/chunk-02.vi.md"), 2: ("translated blocks: 0/0 (0%)", "All chunks are translated.")}
    lines = {(r.doc_id, r.chunk_no): json.loads(r.json) for r in progress.status_json(found).collect()}
    assert lines[1, None] == {"done": 16, "total": 29} and lines[1, 2]["missing"] == ["b16", *[f"b{k}" for k in range(18, 27)]] and lines[1, 2]["n_missing"] == 13 and lines[2, 1]["state"] == "keep-only"
