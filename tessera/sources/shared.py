"""What several operators share: the folder for intermediate tables, joins in which nulls are equal, Arrow functions."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


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


def held(frame: DataFrame) -> DataFrame:
    """``frame`` written to the shared checkpoint folder, so that what follows reads it and doesn't compute it again."""
    shared(frame.sparkSession)
    return frame.checkpoint()


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join by ``keys`` in which nulls are equal; the columns of ``left`` and the others of ``right``."""
    named = right.select(*[F.col(k).alias(f"{k}_of") for k in keys], *[c for c in right.columns if c not in keys])
    test = F.lit(True)
    for k in keys:
        test = test & F.col(k).eqNullSafe(F.col(f"{k}_of"))
    return left.join(named, test, how).drop(*[f"{k}_of" for k in keys])


def in_arrow(frame: DataFrame, run: Callable, schema: str, *arguments) -> DataFrame:
    """``frame.mapInArrow`` with a function of the batches, the Arrow form of ``schema`` and ``arguments``."""
    fields = to_arrow_schema(StructType.fromDDL(schema))
    return frame.mapInArrow(lambda batches: run(batches, fields, *arguments), schema)
