"""Work chunks of blocks, and their Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import word_count
from tessera.operators import greedy
from tessera.sources.shared import held, in_arrow, joined


def plan_chunks(blocks: DataFrame, target: int = 1200, stretch: int = 4096) -> DataFrame:
    """``blocks`` with ``words`` and ``chunk_no``: in order, a chunk is closed before a heading once it holds half of
    ``target`` words, before a block that would take it above five quarters, and where references begin.  Kept blocks
    weigh nothing, and so do null texts.  A null ``doc_id`` is a document of its own; blocks that repeat a number follow
    each other in any order; an empty table gives an empty one.

    A document is read in order with nothing held but the running weight (``tessera.operators.greedy``).  Documents with
    block numbers of ``stretch`` or more, which are counted first, are cut into stretches that are dealt to all tasks; a
    row for each tells what it does to any weight held before it.  ``blocks`` is computed twice, so hold what is costly.
    """
    taken = {"held0", "chunk0", "referred0", "stretch", "head", "reference"} & set(blocks.columns)
    if taken:
        raise ValueError(f"blocks may not have columns {sorted(taken)}")
    columns, kind = [c for c in blocks.columns if c not in ("words", "chunk_no")], blocks.schema["doc_id"].dataType.simpleString()
    keys = ["doc_id", "stretch"]
    words = F.when(F.col("keep"), 0).otherwise(F.coalesce(word_count(F.col("text")), F.lit(0))).cast("int")
    known = lambda test: F.coalesce(test, F.lit(False))
    cut = blocks.select(F.floor(F.col("block_no") / stretch).cast("bigint").alias("stretch"), words.alias("words"), known(F.col("type") == "heading").alias("head"), known(F.col("type") == "reference").alias("reference"), *columns)
    long = held(blocks.groupBy("doc_id").agg(F.max("block_no").alias("most")).where(F.col("most") >= stretch).select("doc_id"))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.select(*columns).schema], "words int, chunk_no int"])

    def numbered(frame: DataFrame) -> DataFrame:
        return in_arrow(frame.select(F.col("doc_id").alias("of"), "stretch", "words", "head", "reference", "held0", "chunk0", "referred0", *columns), greedy.number, schema, target)

    start = {"held0": F.lit(0).cast("bigint"), "chunk0": F.lit(0).cast("bigint"), "referred0": F.lit(False)}
    if long.isEmpty():
        return numbered(cut.withColumn("stretch", F.lit(0).cast("bigint")).repartition("doc_id").sortWithinPartitions("doc_id", "block_no").withColumns(start))
    short = joined(cut, long, ["doc_id"], "left_anti").withColumn("stretch", F.lit(0).cast("bigint")).repartition("doc_id").sortWithinPartitions("doc_id", "block_no").withColumns(start)
    dealt = held(joined(cut, long, ["doc_id"], "left_semi").repartition(*keys).sortWithinPartitions(*keys, "block_no"))
    summaries = in_arrow(dealt.select(*keys, "words", "head", "reference"), greedy.summarise, f"doc_id {kind}, stretch bigint, {greedy.SUMMARY}", target)
    entered = held(in_arrow(summaries.repartition("doc_id").sortWithinPartitions(*keys), greedy.carry, f"doc_id {kind}, stretch bigint, {greedy.ENTERED}", target))
    return numbered(short).unionByName(numbered(joined(dealt, entered, keys).sortWithinPartitions(*keys, "block_no")))


def summarise(planned: DataFrame) -> DataFrame:
    """A row for each chunk: ``id, file, translation, blocks, words, keep_only, heading``; the heading is the chunk's
    first, or else the section that its first block stands in.  A null ``doc_id`` is a document of its own; repeated blocks are
    listed as often; an empty plan gives no chunk."""
    number = F.lpad(F.col("chunk_no").cast("string"), 2, "0")
    number = F.when(F.col("chunk_no") > 99, F.col("chunk_no").cast("string")).otherwise(number)
    heading = F.min_by(F.when(F.col("type") == "heading", F.col("text")), F.when(F.col("type") == "heading", F.col("block_no")))
    grouped = planned.groupBy("doc_id", "chunk_no").agg(
        F.sort_array(F.collect_list(F.struct("block_no", "id"))).alias("b"), F.sum("words").cast("int").alias("words"), F.bool_and("keep").alias("keep_only"),
        F.coalesce(heading, F.min_by("section", "block_no"), F.lit("")).alias("heading"))
    return grouped.select("doc_id", "chunk_no", F.concat(F.lit("chunk-"), number).alias("id"), F.concat(F.lit("chunks/chunk-"), number, F.lit(".en.md")).alias("file"),
                          F.concat(F.lit("translations/chunk-"), number, F.lit(".vi.md")).alias("translation"), F.col("b.id").alias("blocks"), "words", "keep_only", "heading")


def block_markdown(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``markdown``: a marker line with id, type, level, keep sign and page, and the text."""
    kind = F.when(F.col("type") == "heading", F.concat_ws(" ", "type", F.col("level").cast("string"))).otherwise(F.col("type"))
    fields = F.filter(F.array(F.col("id"), kind, F.when(F.col("keep"), F.lit("keep")), F.concat(F.lit("p"), F.col("page").cast("string"))), lambda x: x.isNotNull())
    return blocks.withColumn("markdown", F.concat(F.lit("<!-- "), F.array_join(fields, " | "), F.lit(" -->\n"), "text", F.lit("\n")))


def chunk_files(planned: DataFrame) -> DataFrame:
    """``doc_id, file, content`` of every chunk: a header comment and the blocks' Markdown, of those with a text.  Null ids,
    repeats and empty plans as for ``summarise``."""
    chunks = summarise(planned)
    bodies = block_markdown(planned).groupBy("doc_id", "chunk_no").agg(F.sort_array(F.collect_list(F.struct("block_no", "markdown"))).alias("b"))
    header = F.concat(F.lit("<!-- "), "id", F.lit(" | "), F.size("blocks").cast("string"), F.lit(" blocks | ~"), F.col("words").cast("string"), F.lit(" words to translate | "),
                      F.replace(F.left("heading", F.lit(80)), F.lit("--"), F.lit("-")), F.lit(" -->\n"))
    return joined(chunks, bodies, ["doc_id", "chunk_no"], "inner").select("doc_id", "file", F.concat(header, F.lit("\n"), F.array_join("b.markdown", "\n")).alias("content"))


def report(blocks: DataFrame) -> DataFrame:
    """Blocks and words by type, commonest first; null texts have no words, a null id is a document."""
    return blocks.groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"), F.sum(word_count(F.col("text"))).alias("words")).orderBy("doc_id", F.desc("n"), "type")


def outline(blocks: DataFrame, most: int = 14) -> DataFrame:
    """The first headings of each document."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("block_no"))
    return blocks.where("type = 'heading'").withColumn("rank", rank).where(F.col("rank") <= most).select("doc_id", "rank", "level", "text")
