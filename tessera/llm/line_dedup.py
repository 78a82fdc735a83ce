"""Line deduplication over a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, SPACE, UPPER, digest, held, text_of


def line_key(line: Column) -> Column:
    """A line without ASCII white space at its ends and with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Drop lines whose key of at least ``min_chars`` code points occurs in at least ``min_docs`` documents, except in the
    document with the largest id that holds it.

    Lines are exploded and hashed (128 bits of SHA-256) once, into the shared checkpoint folder; distinct documents are counted for each hash; the positions of
    dropped lines come back by document, and a document is put together from the stretches between them.  Only hashes,
    ids and positions move until that last join, which moves each text once.  A hash that very many lines share is
    counted by partial aggregates and then joined, where adaptive execution splits it.

    Returns ``id, n_lines, n_dropped, text`` for each row.  A null or empty text is one empty line.  Rows that repeat an
    id count as one document, each keeping its own lines; rows with a null id aren't counted and keep all lines.  Other
    columns aren't looked at; an empty table gives an empty one.
    """
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    base = base.withColumn("version", F.xxhash64("text"))
    lines = held(
        base.where(F.col("id").isNotNull())
        .select("id", "version", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .select("id", "version", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("id", "version", "pos", F.unhex(digest(F.col("key"))).alias("hash"))
    )
    # The counts are dealt anew for the join: its left side is then a shuffle of its own, which adaptive execution can split.
    common = (
        lines.select("hash", "id").distinct()
        .groupBy("hash").agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
        .select(F.unhex(F.hex("hash")).alias("common_hash"), "keeper")
    )
    dropped = (
        lines.withColumnRenamed("hash", "line_hash")
        .join(common, (F.col("line_hash") == F.col("common_hash")) & (F.col("id") != F.col("keeper")))
        .groupBy(F.col("id").alias("drop_id"), F.col("version").alias("drop_version"))
        .agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
    )
    found = base.join(dropped, (F.col("id") == F.col("drop_id")) & (F.col("version") == F.col("drop_version")), "left")
    kept = """
        array_join(transform(
            filter(sequence(0, size(dropped)),
                   i -> if(i = size(dropped), n_lines, dropped[i]) > if(i = 0, 0, dropped[i - 1] + 1)),
            i -> array_join(slice(lines, if(i = 0, 0, dropped[i - 1] + 1) + 1,
                 if(i = size(dropped), n_lines, dropped[i]) - if(i = 0, 0, dropped[i - 1] + 1)), '\n')), '\n')"""
    return (
        found.withColumn("lines", F.split("text", "\n", -1))
        .withColumn("n_lines", F.size("lines"))
        .select(
            F.col("id").alias(id_col),
            F.col("n_lines").cast("long").alias("n_lines"),
            F.when(F.col("dropped").isNull(), F.lit(0)).otherwise(F.size("dropped")).cast("long").alias("n_dropped"),
            F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.expr(kept)).alias("text"),
        )
    )
