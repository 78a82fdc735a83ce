"""Fill-in-the-middle against plain cutting of texts."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import fill_middle

TEXTS = [
    None, "", "\n", "\n\n\n", "one line", "a line\nanother", "ends\n", "a\r\nb\rc\x0bd e\n", "has <P> in it\nyes", "<M>", "<<S", "P>\nS>\n<", "🙂\nç\n漢字\n" * 9,
    "\n".join(f"line {k}" for k in range(3000)), "x" * 70000 + "\n" + "y" * 70000,
]


def plain(i, text, rate=100, spm=50, unit=r"[^\n]*\n|[^\n]+"):
    text, digest = text or "", hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h, units = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)], re.findall(unit, text)
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return i, n, "plain", None, None, text, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < spm else "psm"
    return i, n, form, len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m if form == "spm" else "<P>" + p + "<S>" + s + "<M>" + m, text


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_forms_and_cuts(spark, chunk):
    rng = random.Random(5)
    texts = (TEXTS if chunk > 1 else TEXTS[:13]) + ["".join(rng.choice("ab\n<PSM>é🙂") for _ in range(rng.randrange(40))) for _ in range(200)]
    rows = [(None if k % 9 == 0 else k // 2, t, 1, "f", "k") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, form string, key string")
    found = fill_middle.fill_middle(docs, chunk=chunk).withColumn("restored", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(repr(plain(i, t)) for i, t, *_ in rows)
    assert {r.form for r in found} == {"plain", "psm", "spm"} and fill_middle.fill_middle(docs.where("false")).count() == 0


def test_other_rates_and_units(spark):
    rng = random.Random(6)
    rows = [(k, "".join(rng.choice("ab \t\nç🙂") for _ in range(rng.randrange(50)))) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for starts, unit in ((fill_middle.word_starts, r"^[^ \t\n]+|[ \t\n]+[^ \t\n]*"), (fill_middle.character_starts, r"(?s).")):
        found = fill_middle.fill_middle(docs, rate=60, spm=10, starts=starts, chunk=5)
        found = found.withColumn("restored", fill_middle.restored(F.col("output"), F.col("form"))).collect()
        assert sorted(map(tuple, found)) == sorted(plain(i, t, 60, 10, unit) for i, t in rows)


def test_only_owning_chunks_are_scanned_again():
    text, scanned = "\n".join(str(k) for k in range(1000)), []

    def starts(before, after):
        scanned.append(len(after))
        return fill_middle.line_starts(before, after)

    units = fill_middle.Units(text, starts, 64)
    counted = len(scanned)
    assert counted == -(-len(text) // 64) and units.n == 1000
    assert text[units.place(500) :].startswith("500\n") and text[units.place(17) :].startswith("17\n") and units.place(1000) == len(text)
    assert len(scanned) == counted + 2
