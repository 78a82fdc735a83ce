"""Chunk planning against plain greedy cutting, whole and by stretches."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import chunks, greedy

SCHEMA = "doc_id long, block_no int, id string, type string, keep boolean, section string, text string"


def plain(rows, target):
    """Chunk numbers of (words, type) in order."""
    out, held, last = [], None, None
    for words, kind in rows:
        if held is None or (kind == "heading" and held >= target / 2) or held + words > 1.25 * target or (kind == "reference" and last != "reference"):
            out.append(out[-1] + 1 if out else 1)
            held = 0
        else:
            out.append(out[-1])
        held, last = held + words, kind
    return out


@pytest.mark.parametrize("stretch", [1, 3, 16, 4096])
def test_plan(spark, stretch):
    """Random documents, one without an id, null texts, gaps in the numbers, an extra column, an empty table."""
    rng, rows, want = random.Random(stretch), [], {}
    for doc in [None, *range(40)]:
        at, items = 0, []
        for _ in range(rng.randrange(1, 60)):
            at += rng.choice([1, 1, 1, 5])
            kind, keep, words = rng.choice(["heading", "paragraph", "paragraph", "paragraph", "reference", "table"]), rng.random() < 0.15, rng.choice([0, 1, 3, 7, 7, 20, 60])
            text = None if words == 0 and rng.random() < 0.5 else " ".join(["w"] * words)
            rows.append((doc, at, f"b{at}", kind, keep, "", text))
            items.append((at, 0 if keep else words, kind))
        want |= {(doc, n): (w, c) for (n, w, _), c in zip(items, plain([x[1:] for x in items], 30))}
    rng.shuffle(rows)
    blocks = spark.createDataFrame(rows, SCHEMA).withColumn("more", F.lit("x")).repartition(3)
    found = chunks.plan_chunks(blocks, 30, stretch)
    assert found.columns == [*blocks.columns, "words", "chunk_no"] and {(r.doc_id, r.block_no): (r.words, r.chunk_no) for r in found.collect()} == want
    assert found.count() == len(rows) and chunks.plan_chunks(blocks.where("false"), 30, stretch).count() == 0


@pytest.mark.parametrize("target", [1, 10, 33])
def test_stretches_are_functions_of_what_is_held(target):
    rng = random.Random(target)
    for _ in range(300):
        n = rng.randrange(1, 25)
        words, head, reference = [rng.choice([0, 1, 2, 5, 12, 50]) for _ in range(n)], [rng.random() < 0.2 for _ in range(n)], [rng.random() < 0.3 for _ in range(n)]
        made = greedy.Stretch(np.array(words), np.array(head), np.array(reference), target)
        summary = (int(made.before[-1]), made.first_refers, made.refers, *made.from_first(), *made.steps())
        for held in {0, *(rng.randrange(6 * target) for _ in range(6))}:
            for chunk, referred in ((0, False), (3, False), (3, True)):
                at = greedy.Running(*greedy.bounds(target), held if chunk else 0, chunk, referred)
                entered = greedy.Running(*greedy.bounds(target), held if chunk else 0, chunk, referred)
                for item in zip(words, head, reference):
                    at.take(*item)
                assert greedy.after(entered, summary) == at
