"""What several operators share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts write it.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared(spark: SparkSession) -> SparkSession:
    """The session with a folder for checkpoints: the cluster's own, or one under the temporary folder if none is named
    and all runs on one machine.  On a cluster a folder must be named, for executors don't see each other's."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (context.master or "").split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "tessera-checkpoints"))
    return spark


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """Column names that ``frame`` doesn't have, made from ``names``."""
    taken = {name.lower() for name in frame.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def held(frame: DataFrame) -> DataFrame:
    """``frame`` written to the shared checkpoint folder, so that what follows reads it and doesn't compute it again."""
    shared(frame.sparkSession)
    return frame.checkpoint()


def folder(spark: SparkSession, name: str) -> str:
    """A new path for ``name`` below the shared checkpoint folder."""
    return f"{shared(spark).sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame) -> DataFrame:
    """``frame`` written as a compressed table to the shared checkpoint folder, and read from there."""
    path = folder(frame.sparkSession, "table")
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def text_of(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def digest(text: Column) -> Column:
    """128 bits of SHA-256 as 32 hexadecimal digits."""
    return F.substring(F.sha2(text, 256), 1, 32)
