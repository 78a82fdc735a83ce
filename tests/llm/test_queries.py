"""The registered queries against their SQL, and the pipeline against what its stages promise."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tessera.llm import queries

TABLES = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the generated tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_is_its_sql(spark, name):
    import duckdb

    base = duckdb.connect()
    for table in ("documents", "conversations", "labels", "pages"):
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM '{TABLES}/{table}.parquet'")
    got, want = queries.QUERIES[name](spark, TABLES), base.sql(queries.ORACLE_SQL[name])
    columns = sorted(got.columns)
    rows = lambda found: sorted(tuple(map(str, r)) for r in found)
    assert columns == sorted(want.columns) and rows(got.select(columns).collect()) == rows(want.select(*columns).fetchall())


def test_every_operator_is_registered():
    names = [x for x in __spark_entry__.queries() if x.startswith("op")]
    assert sorted(int(x[2:].split("_")[0]) for x in names) == list(range(1, 14)) and "pipeline" in __spark_entry__.queries()
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_pipeline(spark, tmp_path):
    from tests.llm.test_operators import toxic_rows

    rows, labels = toxic_rows(240)
    near = " ".join(f"long{k} text{k * 7 % 13}" for k in range(60))
    rows += [(1000, near, "b"), (1001, near, "b"), (1002, near + " more", "a"), (1003, "unlike the others", "a")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    frame, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage{k}"))
        frame = spark.read.parquet(str(tmp_path / f"stage{k}"))
        seen.append([r.doc_id for r in frame.collect()])
    clean, once, apart, mixed, encoded = seen
    assert {1000, 1001, 1002, 1003} <= set(clean) and sum(i % 4 == 0 for i in clean if i < 240) <= 6 and sum(i % 4 != 0 for i in clean if i < 240) >= 174
    assert 1000 not in once and {1001, 1002, 1003} <= set(once) and len(set(once)) == len(once)
    assert 1002 not in apart and 1001 in apart
    assert set(mixed) <= set(apart) and max(mixed.count(i) for i in mixed) <= 3 and sorted(mixed) == sorted(encoded)
    assert frame.where(F.col("n_tokens") != F.size("ids")).count() == 0


def test_near_copies_without_own_ids(spark):
    """Of each component one row stays, also where ids are null or repeated."""
    text = lambda name, end="": " ".join(f"{name}{k} {name}{k * 7 % 13}" for k in range(40)) + end
    rows = [
        (None, text("a")), (None, text("a", " x")), (None, text("b")), (None, text("c")), (2, text("c", " y")), (1, text("d")), (1, text("e")), (3, text("d", " z")), (0, text("e", " w")),
        (None, text("b", " v")), (4, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, "").where("doc_id is not null").collect() if r.text)
    assert found == [(0, text("e", " w")), (1, text("d")), (2, text("c", " y"))]
    unnamed = [r.text for r in corpus_pipeline.drop_near_copies(spark, docs, "").where("doc_id is null").collect()]
    assert len(unnamed) == 2 and {t[0] for t in unnamed} == {"a", "b"}


def test_stages_with_awkward_rows(spark, tmp_path):
    """Null and repeated ids and texts, an empty table, and other columns named as stages might name theirs."""
    names = "row_key stay_key taken_key copies copy sha256 stay_id stay_sha256 kept id size hi lo b n label".split()
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{x} long" for x in names)
    texts = [(1, None, "a"), (None, "", "a"), (None, "one text of its own", None), (2, "one text of its own", "a"), (2, "one text of its own", "a"), (2, "another text", "b"), (None, "last one", None)]
    docs = spark.createDataFrame([(i, t, None, s, None, *range(77, 77 + len(names))) for i, t, s in texts], schema)
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [x.split()[0] for x in schema.split(", ")]
        rows = docs.collect()
        sizes.append(len(rows))
        assert all(tuple(r)[5:] == tuple(range(77, 77 + len(names))) for r in rows)
    assert sizes[:3] == [7, 4, 4]
    assert {(r.doc_id, r.text) for r in docs.where("text <> ''").collect()} <= {(2, "one text of its own"), (2, "another text"), (None, "last one")}
