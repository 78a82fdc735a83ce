"""Exact deduplication by recipes of content-defined chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.llm.common import fresh, held, text_of

#: A chunk has at least 512 characters, and ends after the next line end or else sentence end, or at 4,096.
CHUNK = r"(?s).{512}[^\n]{0,3583}\n|.{512}[^.!?]{0,3583}[.!?]|.{1,4096}"


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_digits: int = 32) -> DataFrame:
    """Classes of equal texts.

    1. The dictionary: each distinct chunk moves once to the task that owns its bytes, where its key (``key_digits``
       hexadecimal digits of SHA-256) is taken; keys of more than one chunk are numbered apart.  So an identifier (key,
       and number for clashing keys) stands for one chunk, verified over all chunks.
    2. Recipes: a text is the ordered list of its chunks' identifiers; equal lists are equal texts.  Only recipes are
       grouped and joined, never texts.

    Recipes are written to the shared checkpoint folder.  A class that holds very many rows is one row for each task
    after partial aggregation, and is joined back by a join that adaptive execution can split.

    Returns ``id, keep_id, group_size, kept, text_sha256`` for each row.  A null text equals an empty one.  The row with
    the largest id stays; of rows that repeat this id one stays; null ids come below all others.  Other columns aren't
    looked at; an empty table gives an empty one.
    """
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    key = lambda c: F.substring(F.sha2(c, 256), 1, key_digits)
    dictionary = base.select(F.explode(chunks(F.col("text"))).alias("chunk")).groupBy("chunk").agg(key(F.col("chunk")).alias("key"))
    clashing = dictionary.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    facts = base.select("id", F.sha2("text", 256).alias("text_sha256"), "text")
    if clashing.isEmpty():
        listed = facts.withColumn("recipe", F.array_join(F.transform(chunks(F.col("text")), key), " ")).drop("text")
    else:
        numbered = dictionary.join(clashing, "key", "left_semi").select(
            "key", F.col("chunk").alias("clash"), F.row_number().over(Window.partitionBy("key").orderBy("chunk")).alias("number"))
        parts = facts.withColumn("row", F.monotonically_increasing_id()).select("id", "text_sha256", "row", F.posexplode_outer(chunks(F.col("text"))).alias("pos", "chunk"))
        listed = (
            held(parts).join(numbered.drop("key"), F.col("chunk") == F.col("clash"), "left")
            .groupBy("id", "text_sha256", "row")
            .agg(F.sort_array(F.collect_list(F.when(F.col("chunk").isNotNull(), F.struct("pos", F.concat(key(F.col("chunk")), F.lit(":"), F.coalesce(F.col("number"), F.lit(0))).alias("one"))))).alias("parts"))
            .select("id", "text_sha256", F.array_join("parts.one", " ").alias("recipe"))
        )
    recipes = held(listed.withColumn("row", F.monotonically_increasing_id()))
    classes = (
        recipes.groupBy("recipe")
        .agg(F.max(F.struct("id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size"))
        .select(F.concat(F.lit("="), "recipe").alias("class"), "best", "group_size")
    )
    return (
        recipes.withColumn("mine", F.concat(F.lit("="), "recipe"))
        .join(classes, F.col("mine") == F.col("class"))
        .select(
            F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), F.col("group_size").cast(T.LongType()).alias("group_size"),
            (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256",
        )
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns whatever their names, that stay by ``exact_dedup``: one of each class
    of equal texts.

    Rows are found again by id (null equals null) and text digest, in one join; only where rows that repeat an id and a
    text stay are they made one by a further shuffle, and which one's other columns stay is then open.  A null text
    stays null.  An empty table gives an empty one.
    """
    sha, stay_id, stay_sha = fresh(docs, "sha256", "stay_id", "stay_sha256")
    best = held(exact_dedup(docs, id_col, text_col).where(F.col(id_col).eqNullSafe(F.col("keep_id"))).select(F.col(id_col).alias(stay_id), F.col("text_sha256").alias(stay_sha), "kept"))
    stay = best.where("kept").drop("kept")
    found = docs.withColumn(sha, F.sha2(text_of(text_col), 256)).join(stay, F.col(id_col).eqNullSafe(F.col(stay_id)) & (F.col(sha) == F.col(stay_sha)), "left_semi")
    return (found if best.where("not kept").isEmpty() else found.dropDuplicates([id_col, sha])).drop(sha)
