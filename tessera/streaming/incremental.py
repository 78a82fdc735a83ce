"""Documents as they arrive: the streaming side of picking up unfinished work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import blocks, chunks, layout
from tessera.sources import documents

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def stream_documents(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """Tables of documents that appear below ``path``, at most ``files`` a batch."""
    return spark.readStream.schema(DOCS).option("maxFilesPerTrigger", files).parquet(path)


def plan_batch(docs: DataFrame, target: int = 1200) -> DataFrame:
    """Lines to blocks to planned chunks of a batch of documents."""
    found = layout.drop_furniture(documents.lines(docs))
    return chunks.plan_chunks(blocks.build_blocks(found), target)


def start(docs: DataFrame, out: str, checkpoint: str, target: int = 1200) -> StreamingQuery:
    """Appends planned blocks below ``out``; a batch that is run again after a failure overwrites its own folder, so each
    document is planned once."""

    def write(batch: DataFrame, number: int) -> None:
        plan_batch(batch, target).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
