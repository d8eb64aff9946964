"""Byte-level BPE against the tokenizer's own library, and round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from partloom.llm import bpe

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "\n\n\t ", "a", "don't WE'LL 1234567 x² ½", "naïve 中文字 кириллица 🙂🙂 é", "=" * 700, "x" * 5000, "ab" * 300, " " * 900 + "z", "a\x1cb\x1f c\x85d e　 f", "<|endoftext|> \x00\x00", "the the  the   the\r\n"]
SPACED = [f"a{x}b{y} c{x}{y}d {x}" for x in (" ", "  ", " \n", "\n ", "\x1c ", " \xa0", "\t", "   ") for y in ("", " ", "'s ", "\n\n")]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks()


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_merge_and_split(ranks, library):
    r = random.Random(3)
    cut = bpe.splitter()
    some = ["ab", "a", " ", "\n", "é", "1", "===", "the", "ing", "中文", "\x1d", "\xa0", "'s", "🙂"]
    for _ in range(800):
        text = "".join(r.choice(some) * r.randint(1, 4) for _ in range(r.randint(1, 40)))
        assert [i for w in cut.findall(text) for i in bpe.merge(w.encode(), ranks)] == library.encode_ordinary(text)


def test_pieces_of_letters_need_no_search():
    cut, quick = bpe.splitter().findall, bpe.piece_words(public_tokenizers.PATTERN)
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]):
        if c.isalpha():
            assert cut(f" {c}") == [f" {c}"], hex(ord(c))
    for piece in ["word", "word.", "wörd,", "don't", "x's", "a1", "1.", ".", "..", "a..", "é!", "中文。", "a\nb", "n't", "'s", "\xaa", "x²"]:
        assert list(quick(piece)) == cut(" " + piece)


def test_fold_is_merge(spark, ranks):
    r = random.Random(4)
    words = [b"a", b"\xff\xfe", "é".encode(), b"=" * 300, *(bytes(r.choice(b"abcdeinrst\xc3\xa9") for _ in range(r.randint(1, 60))) for _ in range(400))]
    frame = spark.createDataFrame([(bytearray(w),) for w in words], "w binary").repartition(4)
    for row in frame.select("w", bpe.fold(F.col("w"), ranks).alias("ids")).collect():
        assert row.ids == bpe.merge(bytes(row.w), ranks)


def test_equal_ranks_and_chains(spark):
    """A merge may make a pair of lower rank than its own: the next occurrence has to wait."""
    ranks = {bytes([i]): i + 10 for i in range(256)} | {b"xy": 5, b"xyx": 1, b"yx": 9}
    for word in (b"xyxyxy", b"yxyxyx", b"xxyyxx", b"xyxy"):
        assert spark.createDataFrame([(bytearray(word),)], "w binary").select(bpe.fold(F.col("w"), ranks)).first()[0] == bpe.merge(word, ranks)
    assert bpe.merge(b"xyxyxy", ranks) == [1, 121 + 10, 5]


def test_encode_texts(spark, ranks, library):
    rows = [(i, t, "q") for i, t in enumerate([*TEXTS, *SPACED])] + [(None, "no id", "q"), (3, TEXTS[5], "q"), (3, TEXTS[5], "q")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, encoded string").repartition(3)
    found, name = bpe.encode(frame, ["doc_id", "text", "encoded"], unit=4000)
    assert name != "encoded"
    got = found.select("*", bpe.decode(F.col(name)["ids"], ranks).alias("back")).collect()
    assert len(got) == len(rows)
    for row in got:
        ids = library.encode_ordinary(row.text or "")
        assert row[name]["ids"] == ids and bytes(row[name]["packed"]) == np.array(ids, "<u4").tobytes() and bytes(row.back) == (row.text or "").encode() and row.encoded == "q"
    assert bpe.encode(frame.limit(0))[0].count() == 0


def test_decode_odd_lists(spark, ranks):
    frame = spark.createDataFrame([([],), (None,), ([1, None, 10**9, 2],)], "ids array<int>")
    pieces = {i: t for t, i in ranks.items()}
    got = [r[0] if r[0] is None else bytes(r[0]) for r in frame.select(bpe.decode(F.col("ids"), ranks)).collect()]
    assert got == [b"", None, pieces[1] + pieces[2]]


def test_query(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for d, t in docs:
        ids = library.encode_ordinary(t or "")
        want.append((d, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())))
    assert sorted(map(tuple, bpe.op12_bpe(spark, SF).collect())) == sorted(want)
