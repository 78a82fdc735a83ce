import time

import duckdb

import __spark_entry__
from tessera.operators import glossary


def differences(spark, folder, name, **tables):
    """Rows by which a query differs from its SQL, over tables given as (schema, rows)."""
    found, con = [], duckdb.connect()
    for table, (schema, rows) in tables.items():
        path = f"{folder}/{table}.parquet"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    told = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in told.description]
    found = sorted(map(tuple, __spark_entry__.queries()[name](spark, str(folder)).select(*columns).collect()), key=str)
    return [pair for pair in zip(found, sorted(told.fetchall(), key=str), strict=True) if pair[0] != pair[1]]


def test_dehyphenate_keeps_digits_and_other_blanks(spark, tmp_path):
    texts = ["0 first\n1 second 1\n 22 third 2", "  a line\n\n \n", "", None, "one-\r\ntwo", "\ta tab\t\n\x0bend\t", "\xa0blank \nwide　", "three words trained\nfine-\ntuning", "-\n-\nx"]
    assert differences(spark, tmp_path, "dehyphenate", documents=("doc_id long, text string, lang string", [(k, t, "en") for k, t in enumerate(texts)])) == []


def test_dehyphenate_takes_time_with_the_length_of_a_text(spark, tmp_path):
    """A text of 12,000 broken words; where each line passes all the text before it, that takes most of a minute."""
    text = " ".join(["harvester"] * 12_000)
    spark.createDataFrame([(1, "a harvester", "en"), (2, text, "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    start = time.time()
    assert dict(map(tuple, __spark_entry__.queries()["dehyphenate"](spark, str(tmp_path)).collect())) == {1: "a harvester", 2: text}
    assert time.time() - start < 15


def test_inconsistent_terms_without_a_held_glossary(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(glossary, "HELD_SIGNS", 0)
    monkeypatch.setattr(glossary, "listed", None)
    said = [(1, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(("harvest and sensors, harvests", "harv and sensorx", "the Harvest", "harvestx; harv", "no sensor", None))] + [(2, 0, "user", "sensor"), (2, 1, "assistant", "sens sensorx")]
    tables = {"conversations": ("conv_id long, turn long, role string, text string", said), "benchmark": ("item_id long, text string", [(4, "harvest of sensor beds")])}
    assert differences(spark, tmp_path, "inconsistent_terms", **tables) == []
    assert __spark_entry__.queries()["inconsistent_terms"](spark, str(tmp_path)).count() > 0
