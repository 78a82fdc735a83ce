"""I-Match fingerprints of documents over randomised lexicon subsets, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import held, text_of

#: Random orders of the lexicon, and the shares of 1,024 that the nested subsets of each keep: 40 subsets, fixed for all texts.
ORDERS, SHARES = 8, (512, 128, 32, 8, 2)
#: Slots of the lexicon's table; each has a list of the terms that want it.
SLOTS = 1 << 18


def _terms(text: Column) -> Column:
    """The distinct terms (runs of letters and digits in lower case) of a text as 64-bit hashes."""
    return F.array_distinct(F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda t: t != ""), lambda t: F.xxhash64(t)))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is made once, also where ``use`` has it in a function of array elements."""
    return F.element_at(F.transform(F.array(value), use), 1)


def lexicon(docs: DataFrame, text_col: str, low: float, high: float) -> DataFrame:
    """One row with ``slots``, the table of the terms whose inverse document frequency is in the band: those in at least
    ``low`` and at most ``high`` of all documents.  A document has few hundred terms, so at most that number divided by
    ``low`` are in the band however large the corpus, and the table has all of them.  Slots without terms are null."""
    n_docs = docs.count()
    counted = docs.select(F.explode(_terms(text_of(text_col))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    band = counted.where((F.col("n") >= max(2, low * n_docs)) & (F.col("n") <= max(2, high * n_docs)))
    slots = band.groupBy(F.pmod("term", F.lit(SLOTS)).alias("slot")).agg(F.sort_array(F.collect_list("term")).alias("terms"))
    table = docs.sparkSession.range(SLOTS).withColumnRenamed("id", "slot").join(slots, "slot", "left")
    return table.agg(F.sort_array(F.collect_list(F.struct("slot", "terms"))).alias("s")).select(F.col("s.terms").alias("slots"))


def _mark(terms: Column) -> Column:
    """31 bits for a sorted list of terms, 0 for none."""
    return F.when(F.size(terms) > 0, F.shiftrightunsigned(F.xxhash64(terms), 33)).otherwise(F.lit(0)).cast("int")


def _marks(terms: Column, order: Column, shares: tuple[int, ...] = SHARES) -> Column:
    """The marks of the subsets of an order; a term's place in it are ten of its own bits."""
    if not shares:
        return F.array().cast("array<int>")
    place = lambda t: F.call_function("shiftrightunsigned", t, order * 10).bitwiseAND(F.lit(1023))
    return _let(F.filter(terms, lambda t: place(t) < shares[0]), lambda kept: F.concat(F.array(_mark(kept)), _marks(kept, order, shares[1:])))


def fingerprint(text: Column, slots: Column) -> Column:
    """The marks of a text: of all its terms in the band, and of those that each randomised subset of the lexicon keeps, in
    sorted order.  The subsets are the same for all texts; there are large ones, in which short texts have terms, and
    small ones, in which long texts have few.  Texts without a term in the band use all their terms."""
    in_band = lambda terms: F.filter(terms, lambda t: F.array_contains(slots[F.pmod(t, F.lit(SLOTS)).cast("int")], t))
    kept = _let(_terms(text), lambda terms: _let(in_band(terms), lambda band: F.sort_array(F.when(F.size(band) > 0, band).otherwise(terms))))
    half = lambda terms: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(ORDERS // 2 - 1)), lambda j: _marks(terms, j)))
    again = lambda terms: F.sort_array(F.transform(terms, lambda t: F.xxhash64(t)))
    return _let(kept, lambda terms: F.concat(F.array(_mark(terms)), half(terms), _let(again(terms), half)))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal terms; else the share of orders with a subset in which both texts have terms, and the same ones."""
    first = lambda j: j * len(SHARES) + 1
    same = lambda j: F.exists(F.sequence(first(j), first(j) + (len(SHARES) - 1)), lambda k: (a[k] == b[k]) & (a[k] != 0))
    share = F.size(F.filter(F.sequence(F.lit(0), F.lit(ORDERS - 1)), same)) / F.lit(float(ORDERS))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(a[0] == b[0], F.lit(1.0)).otherwise(share))


def next_ids(ids: DataFrame, part_rows: int = 50_000) -> DataFrame:
    """``id, next_id`` for each distinct id: the next by ascending order, and after the last the first.  Ids are dealt
    out by range; the last of a range finds the first of the next one in a table with a row for each range."""
    ids = ids.where(F.col("id").isNotNull()).distinct()
    ranges = max(1, -(-ids.count() // part_rows))
    placed = held(ids.repartitionByRange(ranges, "id").withColumn("part", F.spark_partition_id()))
    heads = placed.groupBy("part").agg(F.min("id").alias("head"))
    after = heads.select(F.col("part").alias("of"), F.coalesce(F.lead("head").over(Window.orderBy("part")), F.min("head").over(Window.partitionBy())).alias("head"))
    within = placed.withColumn("next_id", F.lead("id").over(Window.partitionBy("part").orderBy("id")))
    return within.join(after, F.col("part") == F.col("of")).select("id", F.coalesce("next_id", "head").alias("next_id"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = 0.002, high: float = 0.3) -> DataFrame:
    """Fingerprints of each text and of its edited text: its last quarter of code points (rounded down) replaced by as
    many first ones, or all, of the next document by ascending id (after the last, the first).

    Returns ``id, n_chars, edited_sha256, marks, edited_marks, near_edited, near_next`` for each row; marks are arrays of
    hashes, and the likenesses are shares of the random orders in which they agree.  A null text is an empty one; texts without terms have
    the marks of no terms.  Of rows that repeat an id each has its own result; the next document's text is then the least
    of its rows', and so is its fingerprint.  A row with a null id has no next document: its last quarter goes, and
    ``near_next`` is null.  Other columns aren't looked at; an empty table gives an empty one.

    Texts are dealt out by id once, for both joins; from a next document only the characters that are used move.
    """
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    slots = held(lexicon(docs, text_col, low, high))
    following = held(next_ids(base.select("id")))
    known = base.where(F.col("id").isNotNull())
    sizes = known.select(F.col("id").alias("for_id"), F.char_length("text").alias("n")).distinct()
    wanted = sizes.join(following, F.col("for_id") == F.col("id")).select("for_id", "n", "next_id")
    lent = wanted.join(known, F.col("next_id") == F.col("id")).select("for_id", "n", F.left("text", F.floor(F.col("n") / 4).cast("int")).alias("lent"))
    lent = lent.groupBy("for_id", "n").agg(F.min("lent").alias("lent"))
    n = F.char_length("text")
    joined = known.join(lent, (F.col("id") == F.col("for_id")) & (n >= F.col("n")) & (n <= F.col("n"))).select("id", "text", "lent")
    both = joined.unionByName(base.where(F.col("id").isNull()).withColumn("lent", F.lit("")))
    both = both.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.left("text", n - F.floor(n / 4).cast("int")), "lent"))
    # The table is named once, so the optimiser puts the subquery's value in its place and no row carries it.
    marked = both.withColumn("slots", slots.scalar()).select(
        "id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.transform(F.array("text", "edited"), lambda t: fingerprint(t, F.col("slots"))).alias("two"))
    marked = held(marked).select("id", "n_chars", "edited_sha256", F.col("two")[0].alias("marks"), F.col("two")[1].alias("edited_marks"))
    of_next = following.join(marked.groupBy(F.col("id").alias("next")).agg(F.min("marks").alias("next_marks")), F.col("next_id") == F.col("next")).select(F.col("id").alias("of_id"), "next_marks")
    return marked.join(of_next, F.col("id") == F.col("of_id"), "left").select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", "marks", "edited_marks",
        likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"), likeness(F.col("marks"), F.col("next_marks")).alias("near_next"))
