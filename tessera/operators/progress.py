"""How far translations are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.glossary import PAPER, is_generic
from tessera.operators.lists import first_few
from tessera.sources.shared import joined


def by_chunk(planned: DataFrame, translations: DataFrame, most: int = 10) -> DataFrame:
    """``doc_id, chunk_no, words, need, have, state, missing, n_missing`` of blocks with ``chunk_no``; a state is keep-only,
    done, partial or todo; ``missing`` has the ids of the first ``most`` blocks that lack a translation, ``n_missing`` counts all.
    Empty and null translations don't count, repeated ones count once, and those of unknown blocks not at all."""
    done = translations.where("text <> ''").select("doc_id", F.col("block_id").alias("id"), F.lit(True).alias("done")).distinct()
    marked = joined(planned, done, ["doc_id", "id"]).withColumn("needed", ~F.col("keep")).withColumn("done", F.coalesce("done", F.lit(False)) & F.col("needed"))
    grouped = marked.groupBy("doc_id", "chunk_no").agg(F.sum("words").cast("bigint").alias("words"), F.count_if("needed").alias("need"), F.count_if("done").alias("have"))
    lacking = first_few(marked.where(F.col("needed") & ~F.col("done")), ["doc_id", "chunk_no"], ["block_no"], F.col("id"), most, "missing")
    both = joined(grouped, lacking, ["doc_id", "chunk_no"])
    return both.select("doc_id", "chunk_no", "words", "need", "have", state().alias("state"), F.coalesce("missing", F.array().cast("array<string>")).alias("missing"), F.coalesce("n_missing", F.lit(0)).alias("n_missing"))


def state() -> Column:
    """Of how many blocks a chunk needs and has."""
    return F.when(F.col("need") == 0, "keep-only").when(F.col("have") == F.col("need"), "done").when(F.col("have") > 0, "partial").otherwise("todo")


def totals(chunks: DataFrame) -> DataFrame:
    """``doc_id, total, done, words_total, words_done``; words count as done with their whole chunk."""
    return chunks.groupBy("doc_id").agg(F.sum("need").alias("total"), F.sum("have").alias("done"), F.sum("words").alias("words_total"),
                                        F.sum(F.when(F.col("state") == "done", F.col("words")).otherwise(0)).alias("words_done"))


def next_chunk(chunks: DataFrame) -> DataFrame:
    """The first chunk of each document that isn't finished."""
    return chunks.where(F.col("state").isin("todo", "partial")).groupBy("doc_id").agg(F.min("chunk_no").alias("chunk_no"))


def panel_terms(found: DataFrame, glossary: DataFrame) -> DataFrame:
    """Entries that were found and aren't generic, and all of the paper's own (with 0): the paper's first, then by term."""
    counted = glossary.join(found.groupBy("key").agg(F.sum("n").alias("n")), "key", "left").withColumn("count", F.coalesce("n", F.lit(0)))
    return counted.where((F.col("count") > 0) & ~is_generic() | (F.col("source") == PAPER)).drop("n").orderBy(F.col("source") != PAPER, F.lower("en"))


def _chunk(name: Column) -> Column:
    number = name.cast("string")
    return F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number)


def status_lines(chunks: DataFrame) -> DataFrame:
    """A line of text for each chunk, ``line``; partial ones name their first ten blocks that are missing."""
    shown = F.slice("missing", 1, 10)
    missing = F.when(F.col("state") == "partial", F.concat(F.lit("  missing: "), F.array_join(shown, ", "), F.when(F.col("n_missing") > F.size(shown), F.lit(" ...")).otherwise(F.lit("")))).otherwise(F.lit(""))
    line = F.concat(F.lit("chunk-"), _chunk(F.col("chunk_no")), F.lit("  "), F.rpad("state", 9, " "), F.lit(" "), F.col("have").cast("string"), F.lit("/"), F.col("need").cast("string"), F.lit(" ~"), F.col("words").cast("string"), F.lit(" words"), missing)
    return chunks.select("doc_id", "chunk_no", line.alias("line"))


def status(chunks: DataFrame) -> DataFrame:
    """``doc_id, header, next, done, total, percent``: what is told above and below the lines of a document's chunks."""
    whole = totals(chunks)
    coming = next_chunk(chunks).withColumnRenamed("chunk_no", "next_no")
    percent = F.bround(100 * F.col("done") / F.greatest(F.col("total"), F.lit(1))).cast("int")
    told = joined(whole, coming, ["doc_id"]).withColumn("percent", percent)
    number = _chunk(F.col("next_no"))
    following = F.when(F.col("next_no").isNull(), "All chunks are translated.").otherwise(F.concat(F.lit("Next: translate chunks/chunk-"), number, F.lit(".en.md -> translations/chunk-"), number, F.lit(".vi.md")))
    return told.select("doc_id", F.concat(F.lit("translated blocks: "), "done", F.lit("/"), "total", F.lit(" ("), "percent", F.lit("%)")).alias("header"), following.alias("next"), "done", "total", "percent")


def status_json(chunks: DataFrame) -> DataFrame:
    """``doc_id, chunk_no, json``: a line of JSON for each chunk, and with a null ``chunk_no`` one for the document."""
    line = F.to_json(F.struct(F.concat(F.lit("chunk-"), _chunk(F.col("chunk_no"))).alias("id"), "state", "have", "need", "missing", "n_missing"))
    return chunks.select("doc_id", "chunk_no", line.alias("json")).unionByName(status(chunks).select("doc_id", F.lit(None).cast("int").alias("chunk_no"), F.to_json(F.struct("done", "total")).alias("json")))
