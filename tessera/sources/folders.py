"""Folders of files, with a row for each file that can't be used next to the rows of the others.

Files are read as bytes by Spark, so they may be in any store it reaches; a file is one row, and nothing comes to the driver.
"""

from __future__ import annotations

import csv
import os
import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyspark.cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources import documents as D
from tessera.sources.shared import in_arrow

WARNING = "doc_id string, file string, block_id string, message string"
#: Fixed value: the format that a work folder's description names.
FORMAT = "tessera/1"


def read_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``path, file, text, problem`` of the files below ``path``, at any depth, whose name fits ``pattern``: the text without a
    byte-order mark, or null and a problem where the bytes aren't UTF-8.  Spark doesn't list empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    text = F.regexp_replace(F.try_validate_utf8(F.col("content").cast("string")), "^﻿", "")
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), text.alias("text"), F.when(text.isNull(), "not UTF-8").alias("problem"))


def _in_folder(files: DataFrame, folder: str) -> DataFrame:
    """Files with ``doc_id``: the folder above ``folder``, in which they stand (any folder for an empty one)."""
    inner = rf"([^/]+)/{folder}/[^/]+$" if folder else r"([^/]+)/[^/]+$"
    return files.withColumn("doc_id", F.nullif(F.regexp_extract("path", inner, 1), F.lit(""))).where("doc_id is not null")


def _told(frame: DataFrame, message: str, block: str = "cast(null as string)", file: str = "file") -> DataFrame:
    return frame.select("doc_id", F.col(file).alias("file"), F.expr(block).alias("block_id"), F.expr(message).alias("message"))


def read_translations(spark: SparkSession, path: str, folder: str = "translations") -> tuple[DataFrame, DataFrame]:
    """Of all ``<document>/<folder>/*.md`` and ``*.json`` below ``path``: the translations (``doc_id, block_id, text, origin``) and
    the warnings (``doc_id, file, block_id, message``) on files that aren't UTF-8 or no JSON, that have no block, and on blocks
    that a later file, by name, says otherwise than an earlier one."""
    files = _in_folder(read_files(spark, path, "*.{md,json}"), folder)
    is_json = F.col("file").endswith(".json")
    problem = F.coalesce("problem", F.when(is_json & F.try_parse_json("text").isNull(), "no JSON"))
    known = files.withColumn("problem", problem)
    good = known.where("problem is null").select("doc_id", "file", "text")
    parts = D.parse_marked(good.where(~is_json)).unionByName(D.parse_translation_json(good.where(is_json)))
    merged, conflicts = D.merge_translations(parts)
    unread = _told(known.where("problem is not null"), "concat('cannot read: ', problem)")
    bare = _told(good.join(parts.select("doc_id", "file").distinct(), ["doc_id", "file"], "left_anti"), "'no blocks'")
    twice = _told(conflicts, "concat('translated in both ', earlier_file, ' and ', file, '; using ', file)", "block_id")
    return merged, unread.unionByName(bare).unionByName(twice)


BLOCK = "array<struct<id: string, type: string, page: int, level: int, keep: boolean, section: string, text: string>>"
CHUNK = "array<struct<id: string, file: string, translation: string, blocks: array<string>, words: int, keep_only: boolean, heading: string>>"


def read_documents(spark: SparkSession, path: str, name: str = "document.json") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of all ``<document>/<name>`` below ``path``: documents (``doc_id, format, source, title, pages, chunk_words, chunks``), their
    blocks (``doc_id, block_no``, and as ``build_blocks`` gives them) and warnings: files that aren't UTF-8 or no JSON object, and
    other formats than ``FORMAT``, which are read all the same."""
    files = _in_folder(read_files(spark, path, name), "")
    parsed = F.from_json("text", f"struct<format: string, source: string, title: string, pages: int, chunk_words: int, blocks: {BLOCK}, chunks: {CHUNK}>")
    object_ = F.coalesce(F.ltrim("text").startswith("{") & F.try_parse_json("text").isNotNull(), F.lit(False))
    known = files.withColumn("problem", F.coalesce("problem", F.when(~object_, "no JSON object"))).withColumn("d", F.when(F.col("problem").isNull(), parsed))
    good = known.where("problem is null")
    other = good.where(~F.coalesce(F.col("d.format"), F.lit("")).eqNullSafe(FORMAT))
    blocks = good.select("doc_id", F.posexplode("d.blocks").alias("pos", "b")).select("doc_id", (F.col("pos") + 1).alias("block_no"), "b.*")
    docs = good.select("doc_id", *[f"d.{x}" for x in ("format", "source", "title", "pages", "chunk_words", "chunks")])
    return docs, blocks, _told(known.where("problem is not null"), "concat('cannot read: ', problem)").unionByName(_told(other, f"concat('format ', coalesce(d.format, 'none'), ' instead of {FORMAT}')"))


def glossary_rows(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """``file, text`` of glossary files to their cells: each file has its own header; empty lines and those that start with a #
    don't count; a quoted cell goes on over line ends."""
    for batch in batches:
        out: list[tuple] = []
        for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            lines = [line for line in text.splitlines() if line.strip() and not line.lstrip().startswith("#")]
            try:
                out += [(file, k, *(row.get(x) for x in ("en", "vi", "domain", "note")), None) for k, row in enumerate(csv.DictReader(lines))]
            except csv.Error as error:
                out.append((file, 0, None, None, None, None, str(error)))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(schema.types)], schema=schema)


def read_glossaries(spark: SparkSession, path: str | Sequence[str], source: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``en, vi, domain, note, source, row`` of glossary files in the order of their names and lines (``source`` defaults to the
    file's name), and warnings (``file, message``) on files that aren't UTF-8 or no table.  Rows without a term or a variant
    don't count.  A glossary is small: its rows are numbered in one task."""
    files = read_files(spark, path, "*") if isinstance(path, str) else [read_files(spark, p, "*") for p in path]
    if isinstance(files, list):
        found = files[0]
        for more in files[1:]:
            found = found.unionByName(more)
        files = found
    raw = in_arrow(files.where("text is not null").select("file", "text"), glossary_rows, "file string, pos int, en string, vi string, domain string, note string, problem string")
    placed = D.parse_glossary(raw.where("problem is null").select("en", "vi", "domain", "note", "file", "pos"), source, "file", "pos")
    rows = placed.withColumn("row", F.row_number().over(Window.orderBy("file", "pos")).cast("bigint")).drop("file", "pos")
    warnings = files.where("problem is not null").select("file", F.concat(F.lit("cannot read: "), "problem").alias("message")).unionByName(
        raw.where("problem is not null").select("file", F.concat(F.lit("cannot read: "), "problem").alias("message")))
    return rows, warnings


def glossary_paths(user: str | None = None, listed: str = "", extra: Sequence[str] = (), folder: str | None = None, environment: str = "TESSERA_GLOSSARY") -> list[str]:
    """Where glossaries are looked for, the weakest first: the shipped or user's own, those that the environment names (or
    ``listed``, in the same form), further ones, and that of a work folder."""
    named = (listed or os.environ.get(environment, "")).split(os.pathsep)
    return [*filter(None, [user]), *filter(None, map(str.strip, named)), *extra, *([f"{folder}/glossary.csv"] if folder else [])]


pyspark.cloudpickle.register_pickle_by_value(sys.modules[__name__])
