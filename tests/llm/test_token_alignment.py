"""Alignment of two tokenizers against plain loops over their tokens."""

import collections
import hashlib
import os
import random

import numpy as np
import public_tokenizers as P
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tessera.llm import queries, token_alignment

A, B = queries.ranks("byte_bpe_50k.json"), queries.ranks("piece_bpe_32k.model")
TABLES = "/root/testdata/sf0.001"
TEXTS = [
    None, "", " ", "\n", "hello world", "hello world", "  two  spaces\tand tabs\r\n", "<|endoftext|> in </s> a text <unk>", "çà et là 🙂 ünïcode 漢字かな ไทย",
    "sign ▁ of a space", "a" * 3000, "\x00 nul \x07", "don't we'll 1234567 3.14e-5", "͸ẞ   x", "word " * 2000, "🙂" * 200, "x́" * 50, "�",
]


def brute(texts):
    tokenizer, pieces = Tokenizer.from_str(A.decode()), SentencePieceProcessor(model_proto=B)
    tokenizer.encode_special_tokens = True
    shown = [b for b in range(256) if chr(b).isprintable() and chr(b) != " " and b != 173]
    alphabet = {chr(b): b for b in shown}
    for b in range(256):
        if b not in shown:
            alphabet[chr(256 + len(alphabet) - len(shown))] = b
    rows, links = [], []
    for text in texts:
        ids_a, ids_b = tokenizer.encode(" " + (text or ""), add_special_tokens=False).ids, pieces.encode(text or "")
        bytes_a = [bytes(alphabet[c] for c in tokenizer.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(pieces.id_to_piece(i)[1:-1], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            rows.append((0, 0, 0, 0, ""))
            links.append(collections.Counter())
            continue
        groups, x, y, i, j, at_a, at_b = [], [], [], 0, 0, 0, 0
        while i < len(ids_a) or j < len(ids_b):
            if at_a <= at_b and i < len(ids_a):
                x.append(ids_a[i])
                at_a += len(bytes_a[i])
                i += 1
            else:
                y.append(ids_b[j])
                at_b += len(bytes_b[j])
                j += 1
            if at_a == at_b and x and y:
                groups.append((x, y))
                x, y = [], []
        pairs = collections.Counter((a, b) for x, y in groups for a in x for b in y)
        listed = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((len(ids_a), len(ids_b), len(groups), sum(pairs.values()), hashlib.sha256(listed.encode()).hexdigest()))
        links.append(pairs)
    count = collections.Counter(pair for pairs in links for pair in pairs)
    most = collections.Counter()
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    return [(*row, sum(k for p, k in pairs.items() if count[p] == most[p[0]]), sum(k * count[p] for p, k in pairs.items())) for row, pairs in zip(rows, links)]


@pytest.mark.parametrize("common", [1 << 18, 40, 1])
def test_awkward_rows(spark, common):
    """All pairs looked up, some of them, and almost none; ids null and repeated; other columns of inner names."""
    rng = random.Random(6)
    texts = TEXTS + ["".join(rng.choice("ab \n.é漢🙂1<>|") for _ in range(rng.randrange(60))) for _ in range(60)]
    ids = [None if k % 7 == 0 else k // 2 for k in range(len(texts))]
    docs = spark.createDataFrame([(i, t, 1, "r", 2, 3, 4) for i, t in zip(ids, texts)], "doc_id long, text string, row int, a string, b int, n int, of int").repartition(3)
    found = token_alignment.weigh(docs, A, B, P.PATTERN, common=common).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, found), key=key) == sorted([(i, *row) for i, row in zip(ids, brute(texts))], key=key)
    assert token_alignment.weigh(docs.where("false"), A, B, P.PATTERN).count() == 0


def test_groups_are_given(spark):
    docs = spark.createDataFrame([(1, "hello naïve worlds"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in token_alignment.align(docs, A, B, with_groups=True).collect()}
    tokenizer, pieces = Tokenizer.from_str(A.decode()), SentencePieceProcessor(model_proto=B)
    sides = [g.split("|") for g in rows[1].groups.split(";")]
    assert [int(i) for a, _ in sides for i in a.split(",")] == tokenizer.encode(" hello naïve worlds").ids
    assert [int(i) for _, b in sides for i in b.split(",")] == pieces.encode("hello naïve worlds")
    assert len(rows[1].a) == len(rows[1].b) == len(rows[1].times) and rows[2].groups == "" and rows[2].a == []


def test_dense_groups():
    """Groups of many links are expanded by distinct ids, with the same result."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab🙂漢") for _ in range(300)) for _ in range(20)]
    tokenizers = token_alignment.ByteLevel(A), token_alignment.Pieces(B)
    one, other = token_alignment.Aligner(*tokenizers).align(texts), token_alignment.Aligner(*tokenizers, dense=0).align(texts)
    assert all(np.array_equal(np.concatenate(one[x]), np.concatenate(other[x])) for x in ("a", "b", "times")) and one["n_links"] == other["n_links"]


def test_bitsets():
    rng = np.random.default_rng(3)
    for size in (1, 63, 64, 65, 1000):
        ends = np.unique(rng.integers(1, size + 1, size))
        words = token_alignment.bitset(ends, size)
        cuts = np.arange(size + 1)
        assert np.array_equal(token_alignment.select(words), ends) and np.array_equal(token_alignment.rank(words, cuts), [np.count_nonzero(ends <= c) for c in cuts])


def test_quick_library_gives_the_same_ids():
    """Over random texts of all stable signs, and others."""
    codec, rng = token_alignment.ByteLevel(A, P.PATTERN), random.Random(9)
    signs = [chr(c) for c in range(9, 0xD7FF) if token_alignment._STABLE.fullmatch(chr(c))]
    texts = ["".join(rng.choice(signs if rng.random() < 0.5 else "ab 's\n1.'ll éß") for _ in range(rng.randrange(80))) for _ in range(3000)]
    texts += ["".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(40)) for _ in range(300)]
    assert codec.encode(texts) == [x.ids for x in codec.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the generated tables")
def test_query_on_the_whole_table(spark):
    docs = queries.table(spark, TABLES, "documents").collect()
    found = {r.doc_id: tuple(r)[1:] for r in queries.op13_token_alignment(spark, TABLES).collect()}
    assert found == {r.doc_id: row for r, row in zip(docs, brute([r.text for r in docs]))}
