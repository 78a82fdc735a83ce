"""Work folders that can be resumed: each run writes its tables first and its manifest last.

``path/<table>/run=<n>`` holds what run ``n`` wrote, ``path/manifest/run=<n>`` a row for each document that it finished.
Readers see the documents of the manifests alone, each as its latest run left it: a run that was stopped isn't seen, and
when a document is done again nothing of its former run stays in sight.  A run that is repeated overwrites its own folders
(the writer replaces only the partitions that it writes), so what is left over from a stopped attempt goes.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import blocks as B
from tessera.operators import chunks
from tessera.sources import documents as D
from tessera.sources.shared import joined

TABLES = ("pages", "blocks", "chunks", "chunk_files", "documents")


def _write(frame: DataFrame, path: str, name: str, run: int) -> DataFrame:
    where = f"{path}/{name}/run={run}"
    frame.write.mode("overwrite").parquet(where)
    return frame.sparkSession.read.schema(frame.schema).parquet(where)


def write_run(docs: DataFrame, blocks: DataFrame, path: str, run: int, target: int = 1200, pages: DataFrame | None = None) -> DataFrame:
    """Writes ``pages`` (``doc_id, page, text``, if given), blocks with their chunks, chunk summaries, chunk files and a row for
    each document (``title``, ``source``, its text as lines, and ``json``), and then the manifest, which it gives:
    ``doc_id, n_blocks, n_chunks, words, problem``.

    ``docs(doc_id)``: the documents of the run; one without blocks is finished with the problem ``no text``.  Repeated ids
    are one document, so is a null id; a run without documents writes an empty manifest.  ``blocks`` is computed twice at
    most; what follows reads what was written."""
    if pages is not None:
        _write(pages, path, "pages", run)
    planned = _write(chunks.plan_chunks(blocks, target), path, "blocks", run)
    summaries = _write(chunks.summarise(planned), path, "chunks", run)
    _write(chunks.chunk_files(planned), path, "chunk_files", run)
    described = joined(B.titles(planned), D.source_text(planned).withColumnRenamed("text", "source"), ["doc_id"])
    listed = summaries.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk_no", "id", "file", "translation", "words", "keep_only", "heading"))).alias("chunks"))
    whole = joined(described, listed, ["doc_id"])
    json = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), "title", F.lit(target).alias("chunk_words"), F.transform("chunks", lambda c: c.dropFields("chunk_no")).alias("chunks")))
    _write(whole.select("doc_id", "title", F.coalesce("source", F.lit("")).alias("source"), json.alias("json")), path, "documents", run)
    counted = planned.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.count_distinct("chunk_no").alias("n_chunks"), F.sum("words").alias("words"))
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("bigint").alias(name)
    problem = F.when(F.col("n_blocks").isNull(), "no text").alias("problem")
    return _write(joined(docs.select("doc_id").distinct(), counted, ["doc_id"]).select("doc_id", zero("n_blocks"), zero("n_chunks"), zero("words"), problem), path, "manifest", run)


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """``doc_id, run`` and what the latest run that finished each document says of it; None if none has finished."""
    try:
        found = spark.read.parquet(f"{path}/manifest")
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    rest = [c for c in found.columns if c not in ("doc_id", "run")]
    latest = found.groupBy("doc_id").agg(F.max_by(F.struct("run", *rest), "run").alias("m"))
    return latest.select("doc_id", F.col("m.run").alias("run"), *[F.col(f"m.{c}").alias(c) for c in rest])


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One of ``TABLES``: the rows of each finished document from its latest run."""
    known = manifest(spark, path)
    if known is None:
        raise FileNotFoundError(f"no run has finished below {path}")
    return joined(spark.read.parquet(f"{path}/{name}"), known.select("doc_id", "run"), ["doc_id", "run"], "left_semi").drop("run")


def not_done(docs: DataFrame, path: str) -> DataFrame:
    """The rows of ``docs`` whose document no run has finished; nothing of a stopped run counts."""
    known = manifest(docs.sparkSession, path)
    return docs if known is None else joined(docs, known.select("doc_id"), ["doc_id"], "left_anti")


def extract(docs: DataFrame, path: str, run: int, target: int = 1200, markdown: bool = False) -> DataFrame:
    """From ``docs(doc_id, text)`` to a work folder, leaving out what is done; gives the run's manifest."""
    from tessera.operators import layout

    left = not_done(docs.select("doc_id", "text"), path)
    found = layout.drop_furniture(D.lines(left, markdown=markdown))
    return write_run(left, B.build_blocks(found), path, run, target, D.pages(left))
