"""Mixing sources to target weights by weighted sampling without replacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import WORD, held, text_of

#: Signs that mark up junk rather than prose; the quality weight of a text is the share of its characters that are none.
JUNK = "#$%&*|<>{}[]^~_=\\@+/!"


def quality(text: Column) -> Column:
    """A weight above 0 and up to 1."""
    return (F.char_length(F.translate(text, JUNK, "")) + F.lit(1.0)) / (F.char_length(text) + F.lit(1.0))


def targets(sizes: DataFrame, weights: Sequence[int], most_epochs: int) -> DataFrame:
    """``source, source_size`` with ``target``: sources by code point, null last, take the weights in turn and share the
    sum of all sizes; no target is above ``most_epochs`` times its source's size, and the excess goes to the others by
    weight.  Level filling: in the order of size by weight, a source is at its limit if an even share of what those
    before leave is above it; the first that isn't sets the share of all that follow."""
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("most", F.col("source_size") * most_epochs)
    order = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    filled = (
        ranked.withColumn("left", F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("sharing", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("free", F.col("most") * F.col("sharing") > F.col("left") * F.col("weight"))
    )
    first = F.min(F.when(F.col("free"), F.struct(F.col("most") / F.col("weight"), F.col("rank"), "left", "sharing").alias("x"))).over(Window.partitionBy())
    level = filled.withColumn("first", first)
    share = F.col("first.left") * F.col("weight") / F.col("first.sharing")
    return level.select("source", "source_size", "n_rows", F.least(F.col("most").cast("double"), F.coalesce(share, F.col("most").cast("double"))).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: Sequence[int] = (5, 2, 1), most_epochs: int = 3, bucket_rows: int = 1_000, few_sources: int = 10_000) -> DataFrame:
    """How often a mixture takes each document.

    A source takes all its documents as many whole times as its target holds its size.  For the rest it takes documents
    in the order of Efraimidis-Spirakis keys, -ln(u) / quality with u from a hash of the id, as far as the middle of a
    document stays below the rest.  The prefix sums have two levels, so that no task sorts a whole source: keys fall into
    as many buckets as the source has ``bucket_rows``, the buckets' sums show in which one the rest ends, and only that
    one is sorted.  The plan has one row for each source, and is broadcast up to ``few_sources`` and joined beyond.

    Returns ``id, size, source, source_size, target, copies, taken`` for each row.  A null or empty text has size 0 and
    takes nothing; null sources are one source, the last; null ids share one key; ties of keys go by id, then size;
    repeated rows may each be taken; where nothing is left, documents of size 0 aren't taken again.  Ids alone make the keys, so reruns agree.  Empty tables give empty ones.
    """
    text = text_of(text_col)
    uniform = (F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    sized = held(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), (-F.ln(uniform) / quality(text)).alias("key")))
    plan = held(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows")), weights, most_epochs))
    small = plan.count() <= few_sources

    def by_source(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnRenamed("source", "of_source")
        return left.join(F.broadcast(right) if small else right, F.col("source").eqNullSafe(F.col("of_source")), "left").drop("of_source")

    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.select("source", "source_size", "target", epochs.alias("epochs"), (F.col("target") - epochs * F.col("source_size")).alias("rest"), F.ceil(F.col("n_rows") / bucket_rows).alias("buckets"))
    placed = by_source(sized, plan).withColumn("bucket", F.floor((1 - F.exp(-F.col("key"))) * F.col("buckets")))
    sums = placed.groupBy("source", "bucket", "rest").agg(F.sum("size").alias("bucket_size"))
    upto = F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket"))
    ends = (
        sums.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("bucket_size"))
        .where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("upto")))
        .groupBy("source").agg(F.min(F.struct("bucket", "before")).alias("end"))
        .select("source", F.col("end.bucket").alias("end_bucket"), F.col("end.before").alias("before"))
    )
    placed = by_source(placed, ends)
    at_end = F.col("bucket") == F.col("end_bucket")
    whole = placed.where(~F.coalesce(at_end, F.lit(False))).withColumn("more", F.coalesce(F.col("bucket") < F.col("end_bucket"), F.col("rest") > 0))
    order = Window.partitionBy("source").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    part = placed.where(at_end).withColumn("more", F.col("before") + F.sum("size").over(order) - F.col("size") / 2 <= F.col("rest"))
    copies = F.col("epochs") + (F.col("more") & (F.col("rest") > 0)).cast("long")
    return whole.unionByName(part).select(
        F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))
