"""Jaccard similarity join of documents by a blocked sparse product of the document by n-gram incidence.

Documents with equal sets of n-grams are one class, a row of the incidence matrix; n-grams are its columns, and a block
is the columns with the same remainder.  Overlaps are counted in each block and summed over the blocks, and what can't
reach the overlap that its size asks for is discarded:

1. *Census.*  The product with the all-ones vector: in each block, how many of a class's columns another class has too.
   Summed over the blocks, this bounds every overlap of the class; a class that shares less than ``percent`` of its set
   can't link, and goes.
2. *Product.*  Of the classes that stay, each block counts for each column the pairs of its *leader* with its other
   members: a star, as many pairs as members.  The sums over all blocks are overlaps as far as the leader's columns go;
   where they reach the bound, the pair links, and links join classes to components.
3. *Rest.*  A link between components has all its columns in stars that hold both.  So stars within one component go,
   and then classes whose columns in the other stars are too few for any link, as often as that changes something.  The
   members of a star that remain are multiplied in full, each one outside the star's largest component with all others;
   a class is sent only to the first of its stars (in one order for all) without which too few columns would be left.

No pair that links is lost by any step, and no step makes more rows than the matrix has entries.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import shingles
from tessera.llm.common import held
from tessera.llm.components import components

_U, _I = np.uint64, np.int64
#: Candidates for the leader of a column that very many classes share; a class that shares so much of its set leads before others.
CANDIDATES, CENTRAL = 8, 0.98


def _signature(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits for a set."""
    once = shingles._mixed(hashes ^ _U(0x5851F42D4C957F2D))
    sums = np.array([once.sum(dtype=_U), shingles._mixed(once ^ _U(0x2545F4914F6CDD1D)).sum(dtype=_U)], _U)
    return tuple(shingles._mixed(sums + _U(len(hashes))).view(_I).tolist())


def _marked(marks: np.ndarray, hi: int) -> bool:
    bit = hi % (64 * len(marks))
    return bool(int(marks[bit // 64]) >> (bit % 64) & 1)


def _pools(batches: Iterator[pa.RecordBatch], width: int, buffer: int, marks: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct classes of about ``buffer`` n-grams at once: signatures (two columns), sizes, and n-grams one class after
    the other; with ``marks`` only the classes that are marked."""
    shingler = shingles.Shingler(width)
    kept: dict[tuple[int, int], np.ndarray] = {}
    room = buffer

    def pool() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(list(kept), _I).reshape(-1, 2), np.array([len(x) for x in kept.values()], _I), np.concatenate(list(kept.values()))

    for batch in batches:
        for hashes in shingler.sets(batch.column(0)):
            if len(hashes):
                signature = _signature(hashes)
                if signature not in kept and (marks is None or _marked(marks, signature[0])):
                    kept[signature] = hashes
                    room -= len(hashes)
                    if room <= 0:
                        yield pool()
                        kept, room = {}, buffer
    if kept:
        yield pool()


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values (or rows of values) start, and how long they are."""
    new = values[1:] != values[:-1]
    starts = np.flatnonzero(np.r_[True, new if new.ndim == 1 else new.any(1)]) if len(values) else np.zeros(0, _I)
    return starts, np.diff(np.r_[starts, len(values)])


def _rows(found: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([x.tobytes() for _, x in found], pa.binary())], ["block", "part"])


def _profile(width: int):
    """id, size and signature of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = shingles.Shingler(width)
        for batch in batches:
            sets = [(len(x), *(_signature(x) if len(x) else (0, 0))) for x in shingler.sets(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k] for x in sets], pa.int64()) for k in range(3))], ["id", "size", "hi", "lo"])

    return run


def _census_blocks(width: int, n_blocks: int, buffer: int, hot: int):
    """The incidence in blocks.  A column that several classes of a pool have is counted for them here and sent once, so
    that no column brings more rows to a block than there are pools.  A part is int64 numbers: how many classes, n-grams
    of single classes and shared n-grams follow; the classes' signatures, sizes and counts (with 0 but in one block);
    for each class how many n-grams it has here; 32 bits of each n-gram within the block, in pairs.  Blocks below 0 have
    columns of at least ``hot`` classes of a pool: the column, classes, and a leader, the class of the pool that shares most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, sizes, columns in _pools(batches, width, buffer):
            k = len(sizes)
            whose = np.repeat(np.arange(k), sizes)
            order = np.argsort(columns, kind="stable")
            place = columns[order]
            starts, lengths = _runs(place)
            many = lengths > 1
            local = np.bincount(whose[order[np.repeat(many, lengths)]], minlength=k)
            found: list[tuple[int, np.ndarray]] = []
            busy = lengths >= hot
            if busy.any():
                rank = np.empty(k, _I)
                rank[np.lexsort((names[:, 1], names[:, 0], -sizes, -local / sizes))] = np.arange(k)
                first = np.argsort(rank)[np.minimum.reduceat(rank[whose[order[np.repeat(busy, lengths)]]], np.cumsum(lengths[busy]) - lengths[busy])]
                rows = np.column_stack((place[starts[busy]].view(_I), lengths[busy], names[first], (local[first] * 1000) // sizes[first]))
                to = (place[starts[busy]] % _U(n_blocks)).astype(_I)
                found += [(-1 - int(b), rows[to == b]) for b in np.unique(to)]
            ones = np.zeros(len(columns), bool)
            ones[order[starts[~many]]] = True
            single, whose, shared = columns[ones], whose[ones], place[starts[many]]
            keys = []
            for of in (single, shared):
                block = (of % _U(n_blocks)).astype(np.uint16 if n_blocks < 1 << 16 else _I)
                order = np.argsort(block, kind="stable")
                keys.append((order, ((of // _U(n_blocks)) & _U(0xFFFFFFFF)).astype("<u4")[order], np.searchsorted(block[order], np.arange(n_blocks + 1))))
            (order, own_keys, cuts), (_, shared_keys, shared_cuts) = keys
            whose, told = whose[order], names[:, 0] % n_blocks
            for b in range(n_blocks):
                one, two = own_keys[cuts[b] : cuts[b + 1]], shared_keys[shared_cuts[b] : shared_cuts[b + 1]]
                here = np.bincount(whose[cuts[b] : cuts[b + 1]], minlength=k)
                also = np.where(told == b, local, 0)
                who = np.flatnonzero((here > 0) | (also > 0))
                n = len(one) + len(two)
                if n or len(who):
                    packed = np.concatenate((one, two, np.zeros(n % 2, "<u4"))).view(_I)
                    found.append((b, np.concatenate(([len(who), len(one), len(two)], names[who, 0], sizes[who], also[who], here[who], packed))))
            yield _rows(found)

    return run


def _census(n_buckets: int):
    """Of a block: for each class how many of its columns here others have too, packed by buckets of classes as rows of
    signature, size, count, and counts of the pools.  Parts of blocks below 0 go on as they are."""

    def run(block: pa.Table) -> pa.Table:
        number = block.column("block")[0].as_py()
        parts = [np.frombuffer(x, _I) for x in block.column("part").to_pylist()]
        if number < 0:
            return pa.Table.from_batches([_rows([(number, np.concatenate(parts))])])
        names, facts, owners, keys, shared = [], [], [], [], []
        base = 0
        for part in parts:
            k, n, m = part[:3].tolist()
            names.append(part[3 : 3 + k])
            facts.append(np.column_stack((part[3 + k : 3 + 2 * k], part[3 + 2 * k : 3 + 3 * k])))
            owners.append(np.repeat(np.arange(base, base + k, dtype=np.int32), part[3 + 3 * k : 3 + 4 * k]))
            packed = part[3 + 4 * k :].view("<u4")[: n + m]
            keys.append(packed[:n])
            shared.append(packed[n:])
            base += k
        del parts
        classes, first, index = np.unique(np.concatenate(names), return_index=True, return_inverse=True)
        facts = np.concatenate(facts)
        pooled = np.zeros(len(classes), _I)
        np.maximum.at(pooled, index, facts[:, 1])
        # Shared n-grams are entries of nobody, next to which a class's own entry isn't alone.
        nobody = _U(0xFFFFFFFF)
        entries = np.concatenate((np.concatenate(keys), *shared)).astype(_U)
        entries <<= _U(32)
        entries[: sum(map(len, keys))] |= index.astype("<u4")[np.concatenate(owners)]
        entries[sum(map(len, keys)) :] |= nobody
        del keys, owners, shared
        entries.sort()
        entries = entries[np.r_[True, entries[1:] != entries[:-1]]] if len(entries) else entries
        key = (entries >> _U(32)).astype("<u4")
        same = key[1:] == key[:-1]
        entries &= nobody
        common = (np.r_[False, same] | np.r_[same, False])[: len(key)] & (entries != nobody)
        counts = np.bincount(entries[common].astype(_I), minlength=len(classes))
        some = np.flatnonzero((counts > 0) | (pooled > 0))
        rows = np.column_stack((classes[some], facts[first[some], 0], counts[some], pooled[some]))
        to = rows[:, 0] % n_buckets
        return pa.Table.from_batches([_rows([(int(b), rows[to == b]) for b in np.unique(to)])])

    return run


_STAY = "kind int, hi bigint, lo bigint, size bigint, n bigint, at bigint"


def _stay(percent: int, hot_docs: int):
    """Of a bucket of classes: those that share enough columns for a link, (0, signature, null, size, count, null).  Of
    hot columns that ``hot_docs`` classes or more share: (1, leader's signature, its share, classes, column)."""

    def table(kind: int, hi, lo, size, n, at) -> pa.Table:
        return pa.table([pa.array(np.full(len(hi), kind, np.int32)), *(pa.nulls(len(hi), pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (hi, lo, size, n, at))], ["kind", "hi", "lo", "size", "n", "at"])

    def run(bucket: pa.Table) -> pa.Table:
        number = bucket.column("block")[0].as_py()
        rows = np.concatenate([np.frombuffer(x, _I) for x in bucket.column("part").to_pylist()])
        if number < 0:
            rows = rows.reshape(-1, 5)
            rows = rows[np.lexsort((-rows[:, 4], rows[:, 0]))]
            starts, lengths = _runs(rows[:, 0])
            n = np.repeat(np.add.reduceat(rows[:, 1], starts), lengths)
            use = (n >= hot_docs) & (np.arange(len(rows)) - np.repeat(starts, lengths) < CANDIDATES)
            return table(1, rows[use, 2], rows[use, 3], rows[use, 4], n[use], rows[use, 0])
        rows = rows.reshape(-1, 4)
        classes, first, index = np.unique(rows[:, 0], return_index=True, return_inverse=True)
        pooled = np.zeros(len(classes), _I)
        np.maximum.at(pooled, index, rows[:, 3])
        count, size = np.bincount(index, rows[:, 2], len(classes)).astype(_I) + pooled, rows[first, 1]
        use = 100 * count >= percent * size
        return table(0, classes[use], None, size[use], np.minimum(count, size)[use], None)

    return run


def _product_blocks(width: int, n_blocks: int, n_buckets: int, buffer: int, known):
    """The incidence of the marked classes in blocks: numbers of classes and n-grams; signatures, sizes and whether a class
    is marked as central; how many n-grams each has here; the n-grams.  Columns with a known leader are counted here
    and go to no block: parts of blocks below 0 are pairs, as ``_product`` makes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, central, hot, leaders = known.value
        for names, sizes, columns in _pools(batches, width, buffer, wanted):
            k = len(sizes)
            found: list[tuple[int, np.ndarray]] = []
            owner = np.repeat(np.arange(k), sizes)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, columns), len(hot) - 1)
                led = hot[at] == columns
                pairs, n = np.unique(np.column_stack((leaders[at[led]], names[owner[led]])), axis=0, return_counts=True)
                found += [(-1 - b, x) for b, x in _by_bucket(np.column_stack((pairs, np.zeros_like(n), n)), n_buckets)]
                owner, columns = owner[~led], columns[~led]
            block = (columns % _U(n_blocks)).astype(_I)
            order = np.argsort(block, kind="stable")
            columns, owner = columns[order], owner[order]
            cuts = np.searchsorted(block[order], np.arange(n_blocks + 1))
            facts = np.column_stack((names, sizes, [_marked(central, x) for x in names[:, 0].tolist()]))
            for b, lo, hi in zip(range(n_blocks), cuts[:-1], cuts[1:]):
                if hi > lo:
                    here = np.bincount(owner[lo:hi], minlength=k)
                    who = np.flatnonzero(here)
                    found.append((b, np.concatenate(([len(who), hi - lo], facts[who].ravel(), here[who], columns[lo:hi].view(_I)))))
            yield _rows(found)

    return run


def _by_bucket(pairs: np.ndarray, n_buckets: int) -> list[tuple[int, np.ndarray]]:
    """Rows of two signatures, a count of columns in a block, and one of columns with known leaders; they are dealt out by
    pair, so that no class is hot."""
    to = (shingles._mixed(pairs[:, 0].view(_U) + shingles._mixed(pairs[:, 2].view(_U).copy())) % _U(n_buckets)).astype(_I)
    return [(int(b), pairs[to == b]) for b in np.unique(to)]


def _product(n_buckets: int):
    """Of a block: how many columns each class shares with those that lead them (with itself where it leads)."""

    def run(block: pa.Table) -> pa.Table:
        number = block.column("block")[0].as_py()
        parts = [np.frombuffer(x, _I) for x in block.column("part").to_pylist()]
        if number < 0:
            return pa.Table.from_batches([_rows([(-1 - number, np.concatenate(parts))])])
        facts, here, columns = [], [], []
        for part in parts:
            k, n = part[:2].tolist()
            facts.append(part[2 : 2 + 4 * k].reshape(k, 4))
            here.append(part[2 + 4 * k : 2 + 5 * k])
            columns.append(part[2 + 5 * k :].view(_U))
        del parts
        facts, here, columns = np.concatenate(facts), np.concatenate(here), np.concatenate(columns)
        classes, index = np.unique(facts, axis=0, return_inverse=True)
        order = np.lexsort((classes[:, 1], classes[:, 0], -classes[:, 2], -classes[:, 3]))
        rank = np.empty(len(classes), _I)
        rank[order] = np.arange(len(classes))
        owner = np.repeat(rank[index.ravel()], here)
        order_ = np.argsort(owner, kind="stable")
        owner, columns = owner[order_], columns[order_]
        order_ = np.argsort(columns, kind="stable")
        owner, columns = owner[order_], columns[order_]
        new = np.r_[True, (columns[1:] != columns[:-1]) | (owner[1:] != owner[:-1])]
        owner, columns = owner[new], columns[new]
        starts, lengths = _runs(columns)
        inside = np.repeat(lengths > 1, lengths)
        leader = np.repeat(owner[starts], lengths)[inside]
        pairs, n = np.unique(leader * len(classes) + owner[inside], return_counts=True)
        names = classes[order][:, :2]
        found = _by_bucket(np.column_stack((names[pairs // len(classes)], names[pairs % len(classes)], n, np.zeros_like(n))), n_buckets) if len(pairs) else []
        return pa.Table.from_batches([_rows(found)])

    return run


_PAIRS = ["a_hi", "a_lo", "b_hi", "b_lo", "n"]


def _summed(bucket: pa.Table) -> pa.Table:
    """Blocks add up; each pool with a class has counted all its columns with known leaders, so these don't."""
    rows = np.concatenate([np.frombuffer(x, _I) for x in bucket.column("part").to_pylist()]).reshape(-1, 6)
    rows = rows[np.lexsort(rows[:, :4].T)]
    starts, _ = _runs(rows[:, :4])
    return pa.table([*rows[starts, :4].T.copy(), np.add.reduceat(rows[:, 4], starts) + np.maximum.reduceat(rows[:, 5], starts)], _PAIRS)


def _sets(width: int, marks):
    """The sets of the marked classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, sizes, columns in _pools(batches, width, 1 << 20, marks.value):
            cuts = np.cumsum(sizes) - sizes
            yield pa.RecordBatch.from_arrays([pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy()), pa.array([x.tobytes() for x in np.split(columns, cuts[1:])], pa.binary())], ["hi", "lo", "grams"])

    return run


def _multiply(percent: int):
    """Of whole cells: links between components.  Each row that is to be compared has its overlaps with all rows counted,
    column by column; of what links, one link is given for each two components that it joins."""

    def run(bucket: pa.Table) -> pa.Table:
        table = bucket.sort_by([(x, "ascending") for x in ("a_hi", "a_lo", "i", "j")])
        cell = np.column_stack([table[x].to_numpy() for x in ("a_hi", "a_lo", "i", "j")])
        node, label, size, major = (table[x].to_numpy() for x in ("b", "label", "size", "major"))
        left, right = (np.asarray(table[x]) for x in ("compared", "others"))
        grams = [np.frombuffer(x, _U) for x in table["grams"].to_pylist()]
        links: list[tuple[int, int]] = []
        starts, lengths = _runs(cell)
        for at, k in zip(starts, lengths):
            others = at + np.flatnonzero(right[at : at + k])
            columns = np.concatenate([grams[i] for i in others]) if len(others) else np.zeros(0, _U)
            who = np.repeat(np.arange(len(others)), [len(grams[i]) for i in others])
            order = np.argsort(columns, kind="stable")
            columns, who = columns[order], who[order]
            joined: dict[int, int] = {}

            def root(x: int) -> int:
                while x in joined:
                    x = joined[x]
                return x

            for x in at + np.flatnonzero(left[at : at + k]):
                if root(label[x]) == root(major[x]) or not len(others):
                    continue
                a, n = np.searchsorted(columns, grams[x]), np.searchsorted(columns, grams[x], "right")
                n -= a
                met = who[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())]
                overlap = np.bincount(met, minlength=len(others))
                for y in others[overlap * (100 + percent) >= percent * (size[x] + size[others])]:
                    one, two = root(label[x]), root(label[y])
                    if one != two:
                        joined[one] = two
                        links.append((node[x], node[y]))
        pairs = np.array(links, _I).reshape(-1, 2)
        return pa.table([pairs[:, 0].copy(), pairs[:, 1].copy()], ["a", "b"])

    return run


def _marks(hi: DataFrame, most_words: int) -> np.ndarray:
    """A bitmap with a bit for each ``hi``, of 16 to 32 bits a row up to ``64 * most_words`` bits."""
    words = min(most_words, 1 << max(8, (hi.count() // 4).bit_length()))
    bit = F.pmod(F.col("hi"), F.lit(64 * words))
    found = hi.groupBy(F.floor(bit / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(hi, 64) as int))")).alias("bits")).toPandas()
    marks = np.zeros(words, _I)
    marks[found["word"].to_numpy(_I)] = found["bits"].to_numpy(_I)
    return marks.view(_U)


def _unsettled(rows: DataFrame, percent: int, rounds: int = 3) -> DataFrame:
    """The rows (a star, its member ``b`` with size, label and count) that a link between labels can need."""
    star, last = ["a_hi", "a_lo"], None
    for _ in range(rounds):
        mixed = rows.groupBy(*star).agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
        rows = rows.join(mixed.select(*(F.expr(f"~{x}").alias(f"m{x}") for x in star)), [F.expr(f"~{x}") == F.col(f"m{x}") for x in star], "left_semi")
        able = rows.groupBy("b").agg(F.sum("n").alias("all"), F.max("size").alias("most")).where(F.col("all") * 100 >= F.col("most") * percent)
        rows = held(rows.join(able.select(F.expr("~b").alias("able")), F.expr("~b") == F.col("able"), "left_semi"))
        n = rows.count()
        if n in (0, last):
            break
        last = n
    return rows


def _cells(rows: DataFrame, percent: int, cell_rows: int) -> DataFrame:
    """A row for each cell that a member has to be in.  Members outside a star's largest component (``compared``) meet all
    (``others``); where either are more than ``cell_rows``, they are cut up, and each part of the ones meets each part of the others."""
    star = ["a_hi", "a_lo"]
    sizes = rows.groupBy(*star).agg(F.count(F.lit(1)).alias("members")).select(*(F.expr(f"~{x}").alias(f"s{x}") for x in star), "members")
    sized = rows.join(sizes, [F.expr(f"~{x}") == F.col(f"s{x}") for x in star])
    rest = Window.partitionBy("b").orderBy("members", *star).rowsBetween(0, Window.unboundedFollowing)
    sent = sized.withColumn("left", F.sum("n").over(rest)).where(F.col("left") * 100 >= F.col("size") * percent).select(*star, "b", "size", "label")
    by_label = sent.groupBy(*star, "label").agg(F.count(F.lit(1)).alias("n"))
    shape = by_label.groupBy(*star).agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.max(F.struct("n", "label")).alias("top"))
    parts = lambda n: F.ceil(n / F.lit(cell_rows)).cast("int")
    shape = shape.where("`all` > most").select(*(F.expr(f"~{x}").alias(f"s{x}") for x in star), parts(F.col("all")).alias("all_parts"), parts(F.col("all") - F.col("most")).alias("out_parts"), F.col("top.label").alias("major"))
    known = sent.join(shape, [F.expr(f"~{x}") == F.col(f"s{x}") for x in star])
    to = lambda n: F.pmod(F.xxhash64("b"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = [*star, "b", "size", "label", "major"]
    others = known.select(*kept, to("all_parts").alias("j"), every("out_parts").alias("i"), F.lit(False).alias("compared"), F.lit(True).alias("others"))
    outside = known.where("label <> major").select(*kept, every("all_parts").alias("j"), to("out_parts").alias("i"), F.lit(True).alias("compared"), F.lit(False).alias("others"))
    return others.unionByName(outside).groupBy(*kept, "i", "j").agg(F.max("compared").alias("compared"), F.max("others").alias("others"))


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75, block_entries: int = 4_000_000,
               buffer: int = 1_000_000, cell_rows: int = 8_192, cell_entries: int = 1_000_000, hot_docs: int = 1_000, most_hot: int = 1 << 16, most_words: int = 1 << 22) -> DataFrame:
    """Documents by component of the links of Jaccard similarity of at least ``percent`` / 100 between their sets of
    ``width``-word shingles.

    Bounds of memory, by none of which a link is lost: ``block_entries`` of the incidence matrix that a block has on
    average; ``buffer``, n-grams that a task holds at once; ``cell_rows`` on either side of a cell, and ``cell_entries``
    that a task of cells has on average; ``most_hot`` columns, the commonest with ``hot_docs`` classes or more, that are
    counted where the texts are and sent to no block (their leaders are broadcast); ``64 * most_words`` bits of the bitmap
    that spares classes no step needs.  Sets are sets of 64-bit hashes, and a class of equal sets is known by 128 bits.

    Returns ``id, n_shingles, component_id`` for each row: the smallest id that links lead to.  Null and empty texts
    have no shingle and link with nothing; with fewer than ``width`` words all words are one shingle.  Repeated rows
    and texts share a component; null ids are passed over for its name.  Other columns aren't looked at; an empty
    table gives an empty one.
    """
    spark = docs.sparkSession
    text, broadcast = docs.select(text_col), spark.sparkContext.broadcast
    id_type = docs.schema[id_col].dataType.simpleString()
    found = held(docs.select(id_col, text_col).mapInArrow(_profile(width), f"id {id_type}, size bigint, hi bigint, lo bigint"))
    n_blocks = max(8, (found.agg(F.sum("size")).first()[0] or 0) // block_entries + 1)
    blocks = text.mapInArrow(_census_blocks(width, n_blocks, buffer, 16), "block bigint, part binary")
    counted = blocks.groupBy("block").applyInArrow(_census(n_blocks), "block bigint, part binary")
    census = held(counted.groupBy("block").applyInArrow(_stay(percent, hot_docs), _STAY))
    classes = found.where("size > 0").groupBy("hi", "lo").agg(F.max("size").alias("size"))
    stay = census.where("kind = 0").select(F.expr("~hi").alias("key"), "n")
    stay = held(classes.join(stay, F.expr("~hi") == F.col("key")).where(F.col("n") * 100 >= F.col("size") * percent).select(F.monotonically_increasing_id().alias("b"), "hi", "lo", "size", "n"))
    central = F.col("n") >= F.col("size") * CENTRAL
    hot = (
        census.where("kind = 1").select(F.col("hi").alias("c_hi"), F.col("lo").alias("c_lo"), F.col("n").alias("docs"), "at")
        .join(stay, (F.col("c_hi") == F.col("hi")) & (F.col("c_lo") == F.col("lo")))
        .groupBy("at").agg(F.max("docs").alias("docs"), F.max(F.struct(central.alias("central"), "size", "hi", "lo")).alias("best"))
        .orderBy(F.desc("docs"), "at").limit(most_hot).select("at", "best.hi", "best.lo")
    ).toPandas()
    columns = hot["at"].to_numpy(_I).view(_U)
    order = np.argsort(columns)
    known = broadcast((_marks(stay.select("hi"), most_words), _marks(stay.where(central).select("hi"), most_words), columns[order], hot[["hi", "lo"]].to_numpy(_I)[order]))
    n_blocks = max(8, (stay.agg(F.sum("size")).first()[0] or 0) // block_entries + 1)
    blocks = text.mapInArrow(_product_blocks(width, n_blocks, n_blocks, buffer, known), "block bigint, part binary")
    product = blocks.groupBy("block").applyInArrow(_product(n_blocks), "block bigint, part binary").groupBy("block").applyInArrow(_summed, ", ".join(f"{x} bigint" for x in _PAIRS))
    members = product.join(stay.select("b", F.col("hi").alias("b_hi"), F.col("lo").alias("b_lo"), "size"), ["b_hi", "b_lo"])
    leaders = stay.select(F.col("b").alias("a"), F.col("hi").alias("a_hi"), F.col("lo").alias("a_lo"), F.col("size").alias("a_size"))
    stars = held(members.join(leaders, ["a_hi", "a_lo"], "left").select("a_hi", "a_lo", "a", "b", "size", "a_size", "n"))
    links = held(stars.where((F.col("a") != F.col("b")) & (F.col("n") * (100 + percent) >= (F.col("size") + F.col("a_size")) * percent)).select("a", "b"))
    labels = components(links)
    near = labels.select(F.col("node").alias("of"), "label")
    labelled = stars.join(near, F.col("b") == F.col("of"), "left").select("a_hi", "a_lo", "b", "size", "n", F.coalesce("label", "b").alias("label"))
    rows = _unsettled(labelled, percent)
    cells = held(_cells(rows, percent, cell_rows))
    if not cells.isEmpty():
        wanted = stay.join(cells.select(F.col("b").alias("of")).distinct(), F.col("b") == F.col("of"), "left_semi").select("b", "hi", "lo")
        marks = broadcast(_marks(wanted, most_words))
        sets = text.mapInArrow(_sets(width, marks), "hi bigint, lo bigint, grams binary").dropDuplicates(["hi", "lo"])
        sets = sets.join(wanted.select(F.col("b").alias("of"), F.col("hi").alias("w_hi"), F.col("lo").alias("w_lo")), (F.col("hi") == F.col("w_hi")) & (F.col("lo") == F.col("w_lo"))).select("of", "grams")
        n_buckets = max(8, cells.agg(F.sum("size")).first()[0] // cell_entries + 1)
        placed = cells.join(sets, F.col("b") == F.col("of")).drop("of").withColumn("bucket", F.pmod(F.xxhash64("a_hi", "a_lo", "i", "j"), F.lit(n_buckets)))
        links = held(links.unionByName(placed.groupBy("bucket").applyInArrow(_multiply(percent), "a bigint, b bigint")))
        labels = components(links)
    named = stay.join(labels.select(F.col("node").alias("of"), "label"), F.col("b") == F.col("of")).select(F.col("hi").alias("l_hi"), F.col("lo").alias("l_lo"), "label")
    # A document belongs to its component's label, or else to its class.
    known = found.join(named, (F.col("hi") == F.col("l_hi")) & (F.col("lo") == F.col("l_lo")), "left")
    placed = held(known.select("id", "size", F.when(F.col("size") > 0, F.concat_ws(":", F.coalesce("label", "hi"), F.when(F.col("label").isNull(), F.col("lo")))).alias("of")))
    least = placed.where("of is not null").groupBy("of").agg(F.min("id").alias("component_id")).select(F.concat(F.lit("="), "of").alias("key"), "component_id")
    return placed.withColumn("mine", F.concat(F.lit("="), "of")).join(least, F.col("mine") == F.col("key"), "left").select(
        F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


pyspark.cloudpickle.register_pickle_by_value(shingles)
pyspark.cloudpickle.register_pickle_by_value(sys.modules[__name__])
