"""How far translations are, while they arrive: a state for each document in the state store."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
import pyspark.cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.sources.shared import held, joined

TRANSLATIONS = "doc_id bigint, block_id string, text string"
COLUMNS = ("total", "done", "words_total", "words_done", "unknown")


def plan_facts(planned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of blocks with ``words`` and ``chunk_no``: a row for each block with what its chunk needs, and for each document its totals."""
    needed = ~F.col("keep")
    chunks = planned.groupBy("doc_id", "chunk_no").agg(F.count_if(needed).alias("chunk_need"), F.sum("words").cast("bigint").alias("chunk_words"))
    documents = chunks.groupBy("doc_id").agg(F.sum("chunk_need").alias("total"), F.sum("chunk_words").alias("words_total"))
    return joined(planned.select("doc_id", F.col("id").alias("block_id"), "chunk_no", needed.alias("needed")), chunks, ["doc_id", "chunk_no"]), documents


def count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Takes a document's new rows into its state: the ids seen, how many of each chunk, and the sums that are told."""
    seen, have, done, words, unknown, total, words_total = ({}, {}, 0, 0, 0, 0, 0) if not state.exists else [json.loads(x) if isinstance(x, str) else x for x in state.get]
    for frame in frames:
        for block, chunk, needed, need, chunk_words, of, words_of in frame[["block_id", "chunk_no", "needed", "chunk_need", "chunk_words", "total", "words_total"]].itertuples(index=False):
            total, words_total = max(total, int(of)), max(words_total, int(words_of))
            if block in seen:
                continue
            seen[block] = 1
            if pd.isna(chunk):
                unknown += 1
            elif needed:
                part = str(int(chunk))
                have[part] = have.get(part, 0) + 1
                done += 1
                words += int(chunk_words) if have[part] == int(need) else 0
    state.update((json.dumps(seen), json.dumps(have), done, words, unknown, total, words_total))
    yield pd.DataFrame([[key[0], total, done, words_total, words, unknown]], columns=["doc_id", *COLUMNS])


def track(translations: DataFrame, planned: DataFrame) -> DataFrame:
    """A stream of ``doc_id, total, done, words_total, words_done, unknown`` in update mode from a stream of translations
    (``doc_id, block_id, text``) and the blocks of a plan.  Words count as done with their whole chunk; ``unknown`` counts ids
    that the plan doesn't have.

    A block counts once, however often and in whatever order its translations come; empty and null texts, rows without a
    document or a block, and those of kept blocks don't count.  A document's state holds the ids that it has seen."""
    blocks, documents = plan_facts(planned)
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("bigint").alias(name)
    rows = translations.where("text <> '' and doc_id is not null and block_id is not null").select("doc_id", "block_id")
    known = rows.join(held(blocks), ["doc_id", "block_id"], "left").join(held(documents), "doc_id", "left")
    facts = known.select("doc_id", "block_id", "chunk_no", F.coalesce("needed", F.lit(False)).alias("needed"), zero("chunk_need"), zero("chunk_words"), zero("total"), zero("words_total"))
    schema = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COLUMNS)
    state = "seen string, have string, done bigint, words bigint, unknown bigint, total bigint, words_total bigint"
    return facts.groupBy("doc_id").applyInPandasWithState(count, schema, state, "update", GroupStateTimeout.NoTimeout)


def start(translations: DataFrame, planned: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes what each batch changes below ``out``; a batch that is run again overwrites its own folder."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return track(translations, planned).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, out: str, planned: DataFrame) -> DataFrame:
    """``doc_id`` and ``COLUMNS`` of every document of the plan or with translations, as of the last batch that told of it."""
    told = spark.read.schema(f"doc_id bigint, {', '.join(f'{c} bigint' for c in COLUMNS)}, batch bigint").parquet(out)
    latest = told.groupBy("doc_id").agg(F.max_by(F.struct(*COLUMNS), "batch").alias("s")).select(F.col("doc_id").alias("of"), "s")
    documents = plan_facts(planned)[1].withColumnRenamed("total", "need").withColumnRenamed("words_total", "words")
    both = documents.join(latest, F.col("doc_id") == F.col("of"), "full")
    other = {"total": F.col("need"), "words_total": F.col("words")}
    return both.select(F.coalesce("doc_id", "of").alias("doc_id"), *[F.coalesce(f"s.{c}", other.get(c, F.lit(None)), F.lit(0)).alias(c) for c in COLUMNS])


pyspark.cloudpickle.register_pickle_by_value(sys.modules[__name__])
