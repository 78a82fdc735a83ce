"""The first few of many entries by group, kept while counting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_few(frame: DataFrame, keys: list[str], order: list[str], value: Column, most: int, name: str) -> DataFrame:
    """``keys, <name>, n_<name>``: of each group the first ``most`` values by ``order`` (and then by value), and how many rows
    it has.

    Ranks up to a bound are cut before the shuffle as well as after it, so a task keeps ``most`` rows of a group, whatever the
    group's size; counts are partial aggregates.  Nulls among ``keys`` are groups of their own; null values are left out of
    both; an empty table gives an empty one."""
    fields = [f"o{k}" for k in range(len(order))]
    rows = frame.select(*keys, *[F.col(x).alias(f) for x, f in zip(order, fields)], value.alias("v")).where("v is not null")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*fields, "v"))).where(F.col("rank") <= most)
    listed = ranked.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rank", "v"))).alias("r"))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(*[F.col(k).alias(f"{k}_of") for k in keys], "n")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_of"))
    return listed.join(counts, same).select(*keys, F.transform("r", lambda x: x["v"]).alias(name), F.col("n").alias(f"n_{name}"))
