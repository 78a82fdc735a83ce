"""Alignment of two tokenizers' tokens by the byte offsets where tokens of both end.

Each tokenizer's token ends are bits over the bytes of the texts; the conjunction of both bitsets has the shared cuts.  A
directory of population counts answers how many tokens end up to a cut (rank), which turns a cut into a range of either
side's tokens; the tokens between two cuts are a group, and every pair within a group is a link.  All texts of a small
batch share one bitset, as every text's end is a cut.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import held, written

#: Texts of these signs are split alike by all libraries, whatever edition of Unicode they follow; and the longest run
#: without a break that the quicker library is given.
_STABLE = re.compile(r"[\t\n\r -~¡-ɏΑ-ΡΣ-ώЀ-ҁ‐-‧‰-⁞₠-€、-〃ぁ-ゖァ-ヺ一-龥가-힣]*")
_LONG_RUN = re.compile(r"\S{512}|\s{512}")


def byte_alphabet() -> dict[str, int]:
    """The printable sign by which byte-level vocabularies write each byte: a printable one of Latin-1 stands for itself,
    the others follow from U+0100 on in the order of bytes."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteLevel:
    """A byte-level tokenizer given as JSON; ``bytes_of`` has the bytes of every id.

    With ``pattern``, the tokenizer's own split pattern, texts of stable signs go to a quicker library that takes the
    same vocabulary as ranks; all others go to the tokenizer itself."""

    def __init__(self, content: bytes, pattern: str | None = None):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content.decode())
        self.tokenizer.encode_special_tokens = True
        alphabet, vocabulary = byte_alphabet(), json.loads(content)["model"]["vocab"]
        self.bytes_of: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.bytes_of[i] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
        special = {t["content"] for t in json.loads(content)["added_tokens"]}
        ranks = {self.bytes_of[i]: i for entry, i in vocabulary.items() if entry not in special}
        self.quick = pattern and tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        quick = [bool(self.quick) and _STABLE.fullmatch(t) is not None and _LONG_RUN.search(t) is None for t in texts]
        slow = iter(self.tokenizer.encode_batch_fast([t for t, q in zip(texts, quick) if not q], add_special_tokens=False))
        return [self.quick.encode_ordinary(t) if q else next(slow).ids for t, q in zip(texts, quick)]


class Pieces:
    """A sentence-piece model; ``bytes_of`` has the bytes of every id, with U+2581 as a space."""

    def __init__(self, content: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=content)
        name = self.model.id_to_piece
        self.bytes_of = [bytes([int(name(i)[3:5], 16)]) if self.model.is_byte(i) else name(i).replace("▁", " ").encode() for i in range(self.model.vocab_size())]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def bitset(ends: np.ndarray, size: int) -> np.ndarray:
    """64-bit words in which the offsets ``ends``, up to ``size``, are set."""
    flags = np.zeros((size // 64 + 1) * 64, np.uint8)
    flags[ends] = 1
    return np.packbits(flags, bitorder="little").view("<u8")


def select(words: np.ndarray) -> np.ndarray:
    """The offsets that are set, in order."""
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def rank(words: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many offsets up to each of ``cuts``, itself included, are set."""
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
    upto = (np.uint64(2) << (cuts & 63).astype(np.uint64)) - np.uint64(1)
    return before[cuts >> 6] + np.bitwise_count(words[cuts >> 6] & upto)


class Aligner:
    """Aligns batches of texts. ``dense``: groups of more links than this are expanded by their distinct ids."""

    def __init__(self, a, b, dense: int = 4096):
        self.a, self.b, self.dense = a, b, dense
        self.size_a, self.size_b = (np.array(list(map(len, x.bytes_of)), np.int64) for x in (a, b))
        n = len(a.bytes_of)
        # A token's decimal digits and the sign after it, by 2 * id + (last of its group), ids of B after those of A.
        self.signs = [f"{i}{s}" for i in range(n) for s in ",|"] + [f"{i}{s}" for i in range(len(b.bytes_of)) for s in ",;"]

    def align(self, texts: list[str]) -> dict[str, list]:
        """Columns by name, an entry for each of ``texts``."""
        spaced = [" " + t for t in texts]
        ids_a, ids_b = self.a.encode(spaced), self.b.encode(texts)
        whole = [t.encode() for t in spaced]
        fits = [
            bool(t) and b"".join(map(self.a.bytes_of.__getitem__, x)) == w and b"".join(map(self.b.bytes_of.__getitem__, y)) == w
            for t, x, y, w in zip(texts, ids_a, ids_b, whole)
        ]
        at = [k for k, fit in enumerate(fits) if fit]
        nothing = np.zeros(0, np.int64)
        out = {name: [0] * len(texts) for name in ("n_a", "n_b", "n_groups", "n_links")} | {"groups_sha256": [""] * len(texts), "groups": [""] * len(texts)}
        out |= {name: [nothing] * len(texts) for name in ("a", "b", "times")}
        if not at:
            return out
        x, y = (np.concatenate([np.array(ids[k], np.int64) for k in at]) for ids in (ids_a, ids_b))
        ends_x, ends_y = np.cumsum(self.size_a[x]), np.cumsum(self.size_b[y])
        size = int(ends_x[-1])
        bits_x, bits_y = bitset(ends_x, size), bitset(ends_y, size)
        cuts = select(bits_x & bits_y)
        hi_x, hi_y = rank(bits_x, cuts), rank(bits_y, cuts)
        lo_x, lo_y = (np.concatenate([[0], hi[:-1]]) for hi in (hi_x, hi_y))
        # The groups of text k are those from first[k] to first[k + 1].
        text_ends = np.cumsum([len(whole[k]) for k in at])
        first = np.concatenate([[0], np.searchsorted(cuts, text_ends) + 1])
        n_x, n_y = hi_x - lo_x, hi_y - lo_y
        links = np.add.reduceat(n_x * n_y, first[:-1])
        signs = self._signs(x, y, hi_x, hi_y, lo_x, lo_y)
        bounds = np.concatenate([[0], hi_x + hi_y])[first]
        keys, times = self._links(x, y, lo_x, lo_y, n_x, n_y, np.repeat(np.arange(len(at)), np.diff(first)))
        width = len(self.a.bytes_of) * len(self.b.bytes_of)
        parts = np.searchsorted(keys, np.arange(len(at) + 1) * width)
        pair_a, pair_b = np.divmod(keys % width, len(self.b.bytes_of))
        for j, k in enumerate(at):
            out["n_a"][k], out["n_b"][k], out["n_groups"][k], out["n_links"][k] = len(ids_a[k]), len(ids_b[k]), int(first[j + 1] - first[j]), int(links[j])
            text = "".join(map(self.signs.__getitem__, signs[bounds[j] : bounds[j + 1]].tolist()))[:-1]
            out["groups_sha256"][k] = hashlib.sha256(text.encode()).hexdigest()
            out["groups"][k] = text
            for name, column in (("a", pair_a), ("b", pair_b), ("times", times)):
                out[name][k] = column[parts[j] : parts[j + 1]]
        return out

    def _signs(self, x, y, hi_x, hi_y, lo_x, lo_y) -> np.ndarray:
        """Entries of ``self.signs``: for each group its tokens of A, then those of B."""
        made = np.empty(len(x) + len(y), np.int64)
        last_x, last_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
        last_x[hi_x - 1] = last_y[hi_y - 1] = 1
        made[np.arange(len(x)) + np.repeat(lo_y, hi_x - lo_x)] = 2 * x + last_x
        made[np.arange(len(y)) + np.repeat(hi_x, hi_y - lo_y)] = 2 * (len(self.a.bytes_of) + y) + last_y
        return made

    def _links(self, x, y, lo_x, lo_y, n_x, n_y, text) -> tuple[np.ndarray, np.ndarray]:
        """The distinct linked id pairs of each text, as sorted keys (text, id of A, id of B), and how often each is linked."""
        width, wide = len(self.a.bytes_of) * len(self.b.bytes_of), len(self.b.bytes_of)
        n = n_x * n_y
        few = np.flatnonzero(n <= self.dense)
        g = np.repeat(few, n[few])
        within = np.arange(len(g)) - np.repeat(np.cumsum(n[few]) - n[few], n[few])
        step, rest = np.divmod(within, n_y[g])
        keys = [text[g] * width + x[lo_x[g] + step] * wide + y[lo_y[g] + rest]]
        times = [np.ones(len(g), np.int64)]
        for k in np.flatnonzero(n > self.dense):
            (u, c), (v, d) = np.unique(x[lo_x[k] : lo_x[k] + n_x[k]], return_counts=True), np.unique(y[lo_y[k] : lo_y[k] + n_y[k]], return_counts=True)
            keys.append((text[k] * width + u[:, None] * wide + v).ravel())
            times.append((c[:, None] * d).ravel())
        key, time = np.concatenate(keys), np.concatenate(times)
        order = np.argsort(key, kind="stable")
        key, time = key[order], time[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return key[starts], np.add.reduceat(time, starts)


def align(docs: DataFrame, a: bytes, b: bytes, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False, row_col: str | None = None) -> DataFrame:
    """A row for each row of ``docs``: the id, ``n_a, n_b, n_groups, n_links, groups_sha256``, and ``a, b, times``: the
    distinct linked id pairs and how many of the row's links each makes; with ``with_groups`` also ``groups``, as
    ``a1,a2|b1;a3|b2,b3``, of which ``groups_sha256`` is the digest.

    ``a`` is the content of a byte-level tokenizer (JSON; ``pattern`` as for ``ByteLevel``), which sees a space before
    the text, ``b`` that of a sentence-piece model, which adds one.  Rows whose text is null or empty, or whose tokens'
    bytes aren't the text's on both sides, have zeros, empty lists and an empty ``groups_sha256``.  Repeated rows give
    repeated results and a null id stays null; an empty table gives an empty one; of the other columns only ``row_col``,
    a long, is looked at and passed on.  There is no shuffle; both contents are broadcast, of fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast((a, b, pattern))
    names = [*[row_col] * (row_col is not None), id_col]
    kinds = {"n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "a": pa.list_(pa.int32()), "b": pa.list_(pa.int32()), "times": pa.list_(pa.int64())}
    if with_groups:
        kinds["groups"] = pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        aligner = None
        for batch in batches:
            aligner = aligner or Aligner(ByteLevel(shared.value[0], shared.value[2]), Pieces(shared.value[1]))
            lo = 0
            while lo < batch.num_rows:
                # As many texts as hold about a million signs together.
                texts: list[str] = []
                length = 0
                while lo + len(texts) < batch.num_rows and length < 1 << 20:
                    texts.append(batch.column(batch.num_columns - 1)[lo + len(texts)].as_py() or "")
                    length += len(texts[-1])
                found = aligner.align(texts)
                columns = [pa.array(found[name], kind) for name, kind in kinds.items()]
                part = batch.slice(lo, len(texts))
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(len(names))], *columns], [*names, *kinds])
                lo += len(texts)

    types = [f"`{name}` {docs.schema[name].dataType.simpleString()}" for name in names]
    schema = ", ".join([*types, "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, a array<int>, b array<int>, times array<bigint>", *["groups string"] * with_groups])
    return docs.select(*names, text_col).mapInArrow(run, schema)


def link_counts(aligned: DataFrame) -> DataFrame:
    """``a, b, n, best``: how many rows of ``aligned`` hold each id pair linked, and whether no pair of the same ``a`` has
    more.  A row is one document.  Counts are summed where the rows are first; the highest counts are a row for each id of
    A's vocabulary at most, which is why they may be broadcast."""
    pairs = aligned.select(F.explode(F.arrays_zip("a", "b")).alias("pair")).groupBy("pair.a", "pair.b").agg(F.count(F.lit(1)).alias("n"))
    counts = held(pairs)
    highest = counts.groupBy(F.col("a").alias("of")).agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(highest), F.col("a") == F.col("of")).select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def weigh(docs: DataFrame, a: bytes, b: bytes, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", common: int = 1 << 18) -> DataFrame:
    """``align`` without its lists, and with ``n_best`` and ``count_sum``: the links whose pair has its ``a``'s highest
    count in ``link_counts`` over all of ``docs``, and the sum of the counts of all links.

    The tokens are made once; what they give is written to the shared folder.  The commonest pairs, ``common`` of them at
    most, are broadcast as sorted arrays (17 bytes a pair) and looked up where the rows are, so that no pair that very
    many rows hold is ever a key of a shuffle.  The others, each held by fewer rows than any of those, are joined by a
    shuffle and summed by row.
    """
    spark = docs.sparkSession
    row = "row" if id_col.lower() != "row" else "row_"
    parts = written(align(docs.select(F.monotonically_increasing_id().alias(row), F.col(id_col), F.col(text_col).alias("text_" if id_col == "text" else "text")), a, b, pattern, id_col, "text_" if id_col == "text" else "text", row_col=row))
    counts = held(link_counts(parts))
    top = counts.orderBy(F.desc("n")).limit(common + 1).toPandas()
    # Where there are more pairs than may be broadcast, the broadcast ones are those above the last one's count.
    least = int(top["n"].min()) if len(top) > common else 0
    top = top[top["n"] > least]
    codes = top["a"].to_numpy(np.int64) << 32 | top["b"].to_numpy(np.int64)
    order = np.argsort(codes)
    table = spark.sparkContext.broadcast((codes[order], top["n"].to_numpy(np.int64)[order], top["best"].to_numpy(np.int64)[order]))
    kept = [id_col, "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def look_up(batch: pa.RecordBatch):
        """Codes and times of a batch's pairs, their rows' offsets, places in the table, and whether they are there."""
        column = lambda name: batch.column(batch.schema.get_field_index(name))
        values = lambda name: column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        code, times = values("a") << 32 | values("b"), values("times")
        bounds = np.concatenate([[0], np.cumsum(column("a").value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        place = np.minimum(np.searchsorted(table.value[0], code), max(len(table.value[0]) - 1, 0))
        there = table.value[0][place] == code if len(table.value[0]) else np.zeros(len(code), bool)
        return code, times, bounds, place, there

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, times, bounds, place, there = look_up(batch)
            sums = []
            for values in (table.value[2], table.value[1]):
                worth = np.where(there, times * values[place], 0) if len(values) else np.zeros(len(times), np.int64)
                upto = np.concatenate([[0], np.cumsum(worth)])
                sums.append(pa.array(upto[bounds[1:]] - upto[bounds[:-1]], pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *sums], [*batch.schema.names[:-3], "n_best", "count_sum"])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, times, bounds, _, there = look_up(batch)
            rows = np.repeat(batch.column(0).to_numpy(), np.diff(bounds))[~there]
            code = code[~there]
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array((code >> 32).astype(np.int32)), pa.array((code & 0xFFFFFFFF).astype(np.int32)), pa.array(times[~there])], ["of", "a", "b", "times"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema if f.name not in ("a", "b", "times"))
    scored = parts.mapInArrow(score, f"{types}, n_best bigint, count_sum bigint")
    if not least:
        return scored.select(*kept, "n_best", "count_sum")
    others = parts.select(row, "a", "b", "times").mapInArrow(rest, "of bigint, a int, b int, times bigint").join(counts.where(F.col("n") <= least).hint("shuffle_merge"), ["a", "b"])
    sums = others.groupBy("of").agg(F.sum(F.col("times") * F.col("best").cast("int")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    both = scored.join(sums, F.col(row) == F.col("of"), "left")
    return both.select(*kept, *[(F.col(x) + F.coalesce(y, F.lit(0))).alias(x) for x, y in (("n_best", "more_best"), ("count_sum", "more_sum"))])


pyspark.cloudpickle.register_pickle_by_value(sys.modules[__name__])
