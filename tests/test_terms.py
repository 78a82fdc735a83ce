"""Terms by automaton and by pattern, and variants by marks, against each other and against plain patterns."""

import random

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import glossary
from tessera.operators.automaton import TermAutomaton

TERMS = ["soil", "soil moisture", "soil-moisture sensor", "self-watering", "bed", "raised bed", "berry", "box", "boxe", "glass", "NDVI", "ID", "self", "watering can", "can", "über", "x y z", "-", "Bed Rest"]
PARTS = ["soil", "Soils", "moisture", " ", "  ", "-", "--", "\n", "sensor", "sensors", "self", "watering", "selfwatering", "bed", "beds", "raised", "berries", "berry", "box", "boxes", "glasses", "NDVI", "ndvi", "ID", "id", "ids",
         "can", "Can", "Über", "über", "x", "y", "z", ".", ",", "İ", "ß", "_", "9", "rest"]


def texts(rng, n):
    return ["".join(rng.choice(PARTS) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(14))) for _ in range(n)]


def test_automaton_is_the_pattern(spark):
    rng = random.Random(3)
    rows = [(k // 2 or None, t) for k, t in enumerate(texts(rng, 600))] + [(7, None), (8, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for terms in (TERMS, TERMS[:1], ["bed"]):
        one, other = glossary._by_pattern(frame, terms, "doc_id", text_col="text"), glossary.by_automaton(frame, terms, "doc_id")
        key = lambda r: (r.doc_id is None, r.doc_id or 0, r.key)
        assert sorted(map(tuple, one.select("doc_id", "key", "n").collect()), key=repr) == sorted(map(tuple, other.select("doc_id", "key", "n").collect()), key=repr), terms
        assert glossary.find_terms(frame, ["-", " "], "doc_id").count() == 0
        firsts = lambda found: {key(r): r.first_pos for r in found.collect()}
        assert firsts(one) == firsts(other)


def test_join_is_the_automaton(spark, monkeypatch):
    """The same rows, with repeated texts and ids, and nothing of the glossary on the driver or in an automaton."""
    rng = random.Random(5)
    rows = [(k // 3 if k % 50 else None, t) for k, t in enumerate(texts(rng, 600))] * 2 + [(7, None), (8, ""), (9, "soil, soil, soils")] * 2
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {}
    for terms in (TERMS + ["Soil", "ndvi", "C++", "id", " ", ""], ["bed"], ["-"]):
        want = glossary.by_automaton(frame, terms, "doc_id").collect()
        entries = spark.createDataFrame([(t,) for t in terms], "en string")
        with monkeypatch.context() as m:
            m.setattr(glossary, "HELD_SIGNS", 0)
            m.setattr(glossary, "find_terms", None)
            found = glossary.find_listed(frame, entries, "doc_id").collect()
        assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, want), key=repr), terms
        assert bool(found) == (terms != ["-"])
    assert glossary.find_listed(frame, entries.where("false"), "doc_id").count() == 0


def test_thousands_of_terms(spark):
    rng = random.Random(4)
    terms = [f"word{k} tail{k % 7}" for k in range(5000)] + [f"word{k}" for k in range(0, 5000, 3)]
    found = TermAutomaton(terms).matches(" ".join(f"word{k} tail{k % 5}" for k in range(300)))
    want = [f"word{k} tail{k % 7}" if k % 7 == k % 5 else f"word{k}" for k in range(300) if k % 7 == k % 5 or k % 3 == 0]
    assert [key for _, _, key in found] == want
    frame = spark.createDataFrame([(k, f"a word{rng.randrange(5000)} word{k} tail{k % 7}.") for k in range(50)], "doc_id long, text string")
    counted = glossary.find_terms(frame, terms, "doc_id").collect()
    assert {r.doc_id for r in counted if r.key == f"word{r.doc_id} tail{r.doc_id % 7}"} == set(range(50))


def test_listed_checks_the_size(spark, monkeypatch):
    frame = spark.createDataFrame([("one",), ("two",), ("one",)], "en string")
    assert sorted(glossary.listed(frame)) == ["one", "two"] and glossary.listed(frame.where("false")) == []
    monkeypatch.setattr(glossary, "MOST_SIGNS", 8)
    try:
        glossary.listed(frame)
        raise AssertionError
    except ValueError as error:
        assert "9 signs" in str(error)


def test_variants_by_marks(spark):
    """As whole words, also with signs at their ends; equal to a pattern made for each."""
    rng = random.Random(5)
    parts = ["độ", "ẩm", "do", "am", " ", " ", "-", "(", ")", ".", "a", "b", "ab", "9", "_", "+"]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randrange(12))), ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(3)], "".join(rng.choice(parts) for _ in range(rng.randrange(1, 4)))) for _ in range(800)]
    frame = spark.createDataFrame(rows, "text string, vi array<string>, en string")
    key = T.term_key(F.col("text"), True)
    quoted = lambda v: F.regexp_replace(v, r"([\\.\[\]{}()*+\-?^$|])", r"\\$1")
    plain = F.filter(F.transform("vi", lambda v, i: F.when(F.call_function("rlike", key, F.concat(F.lit(r"(?U)(?<!\w)"), quoted(T.term_key(v, True)), F.lit(r"(?!\w)"))), i)), lambda i: i.isNotNull())
    english = F.call_function("rlike", F.col("text"), F.concat(F.lit(r"(?iU)(?<![\w-])"), quoted(F.col("en"))))
    found = frame.select("text", "vi", "en", glossary.variant_hits(F.col("vi"), key).alias("got"), plain.alias("want"), glossary.has_term(F.col("en"), F.col("text")).alias("has"), english.alias("should")).collect()
    assert [r for r in found if r.got != r.want or r.has != r.should] == [] and sum(len(r.want) for r in found) > 50
