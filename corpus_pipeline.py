"""A pipeline over a corpus of documents: each stage is one operator of tessera.llm.

The stages in order: documents that the toxicity classifier rejects go; of equal texts one stays; of documents linked by
near-duplicate similarity one stays; sources are mixed to their target weights, a document appearing as often as the
mixture takes it; texts become token ids.  All but the last return the columns of documents, whatever other columns there
are and however they are named.  Rows are known by id and text together, so null and repeated ids are rows like others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, exact_dedup, mixing, ngram_join, queries, toxicity
from tessera.llm.common import digest, fresh, text_of


def row_key() -> Column:
    """What names a row: its id and its text's digest.  Null ids come after all others."""
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("doc_id"), digest(text_of("text")).alias("digest"))


def by_key(docs: DataFrame, of: DataFrame, key: str, how: str) -> DataFrame:
    """``docs`` joined with ``of`` where the row key equals that in column ``key`` of ``of``."""
    return docs.join(of, F.col("doc_id").eqNullSafe(F.col(f"{key}.doc_id")) & (digest(text_of("text")) == F.col(f"{key}.digest")), how)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the classifier, trained on the labels that aren't held out, leaves.

    A null or empty text is scored as one without words, repeated rows stay or go together, ids may be null; an empty
    table, or one without labelled rows, gives scores that reject nothing.
    """
    return toxicity.keep_clean(docs, queries.toxicity_model(docs, queries.table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of equal texts, that with the largest id.

    Null texts equal empty ones, null ids come below all others, rows that repeat an id and a text become one, and an
    empty table stays empty.
    """
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of the similarity join, that with the smallest id.

    Null ids come last, of rows with one id that with the smallest digest stays; rows that repeat both all stay (there
    are none after exact deduplication).  Null and empty texts link with nothing and stay.
    """
    key, stay = fresh(docs, "row_key", "stay_key")
    joined = ngram_join.ngram_join(docs.select(row_key().alias(key), "text"), key)
    return by_key(docs, joined.where(F.col(key) == F.col("component_id")).select(F.col(key).alias(stay)), stay, "left_semi")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mixture of the sources takes it.

    Null and empty texts have size 0; they are there as often as whole epochs of their source.  Null sources are one
    source.  Rows that repeat an id and a text are taken equally often, each.  An empty table stays empty.
    """
    key, taken_key, copies, copy = fresh(docs, "row_key", "taken_key", "copies", "copy")
    taken = mixing.mix_sources(docs.select(row_key().alias(key), "text", "source"), key).where("copies > 0")
    taken = taken.groupBy(F.col(key).alias(taken_key)).agg(F.max("copies").alias(copies))
    found = by_key(docs, taken, taken_key, "inner")
    return found.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row's text: doc_id, n_tokens, ids and digests.  A null text has no tokens, repeated rows give
    repeated results, a null id stays null, and an empty table gives an empty one."""
    return bpe.byte_bpe(docs, queries.ranks(), queries.pattern())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near_copies), ("mixing", mix), ("byte-level BPE", encode),
]
#: A trained classifier can't be put into SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
