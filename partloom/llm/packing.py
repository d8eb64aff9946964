"""Packing of tokenised documents into windows by Karmarkar-Karp multiway differencing.

Each document's ids are cut into whole windows, which stand alone, and a rest in pieces of at most ``PIECE`` ids.
Pieces gather in groups of about ``GROUP`` windows; a group is dealt into windows of nearly equal length: every piece
starts as a partial partition, and the two partial partitions of the largest imbalance are merged again and again,
the fullest windows of one on the emptiest of the other.  If a window would exceed the capacity, the group is dealt
again with one window more.  A group closes when its total leaves between 0.7 and 1.5 % of its windows free, which
differencing can nearly always meet.  Groups form inside a partition: no shuffle, and memory is bounded by a group and
the longest document.

Defined results: null and empty texts hold only the end id; repeated rows are packed each; an empty table gives no
rows; ``sequence_id`` holds the partition number in its high bits, so a task that runs again repeats its result."""

from __future__ import annotations

import heapq
import os
import unicodedata
import zlib
from collections.abc import Iterable
from itertools import chain, count, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import common

WINDOW = 4096
PIECE = 1024
GROUP = 64
END_ID = 2
FREE = (0.007, 0.015)
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
CACHE, WORDS = 1 << 18, 1 << 19


#: fixed values: the tokenizer's own split of a normalised text into words, each of which ends with one closing token
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
JOINED = 256


def numbered(known: dict, keys: Iterable, size: int) -> tuple[np.ndarray, list]:
    """The number of every key, and the keys met for the first time; ``known`` numbers keys in the order of their coming."""
    before = len(known)
    at = np.fromiter(map(known.setdefault, keys, count(before)), np.int64, size)
    new = list(islice(known, before, None))
    if new:
        given = np.fromiter(islice(known.values(), before, None), np.int64, len(new))
        known.update(zip(new, range(before, before + len(new)), strict=True))
        fresh = at >= before
        at[fresh] = before + np.searchsorted(given, at[fresh])
    return at, new


def words_of(chunk: str) -> list[str] | tuple[str, ...]:
    if chunk.isalpha():
        return (chunk,)
    if chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():
        return chunk[:-1], chunk[-1]
    return PIECES.findall(chunk)


class _Lists:
    """Numbered lists of token ids in one flat array."""

    def __init__(self):
        self.flat = np.empty(1 << 16, np.uint16)
        self.size, self.begin = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int64)
        self.used = self.number = 0

    def add(self, sizes: np.ndarray, ids: np.ndarray) -> None:
        n = self.number + len(sizes)
        while n > len(self.size):
            self.size, self.begin = (np.concatenate((x, np.zeros_like(x))) for x in (self.size, self.begin))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
        if len(ids) and int(ids.max()) > np.iinfo(self.flat.dtype).max:
            self.flat = self.flat.astype(np.uint32)
        self.flat[self.used : self.used + len(ids)] = ids
        self.size[self.number : n] = sizes
        self.begin[self.number : n] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.number = n

    def get(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids) of the lists ``at``, one after the other."""
        n = self.size[at].astype(np.int64)
        place = np.repeat(self.begin[at] - (np.cumsum(n) - n), n)
        place += np.arange(len(place))
        return n, self.flat[place]


class Encoder:
    """Token ids of whole texts.  The tokenizer splits a text into words and never joins characters across them, so the
    ids of a text are those of its chunks between blanks in turn, and a chunk's those of its words.  Chunks and words met
    keep their ids, until ``CACHE`` chunks or ``WORDS`` words are known.  New words go to the tokenizer many in a string: each ends with exactly one
    closing token, which is checked; a string where the numbers differ goes word by word.  Chunks that normalisation may
    change, and texts that spell a special token in any case, go to the tokenizer whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # chunks spell no special token: spares the search in each
        self.plain = None
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        words = self.tokenizer.get_vocab()
        self.closing = np.zeros(max(words.values()) + 1, bool)
        self.closing[[i for w, i in words.items() if w.endswith("</w>")]] = True
        self.chunks, self.chunk_ids = {}, _Lists()
        self.words, self.word_ids = {}, _Lists()

    def _whole(self, text: bytes) -> np.ndarray:
        if self.plain is None:
            from tokenizers import Tokenizer

            self.plain = Tokenizer.from_file(self.path)
        return np.array(self.plain.encode(text.decode(), add_special_tokens=False).ids, np.uint32)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_words(self, words: list[str]) -> None:
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        for group, ids in zip(groups, self._ids([" ".join(g) for g in groups]), strict=True):
            ids = np.array(ids, np.int64)
            last = np.flatnonzero(self.closing[ids])
            if len(last) == len(group) and last[-1] == len(ids) - 1:
                self.word_ids.add(np.diff(np.concatenate(([-1], last))), ids)
            else:
                own = self._ids(group)
                self.word_ids.add(np.fromiter(map(len, own), np.int64, len(own)), np.fromiter(chain.from_iterable(own), np.int64))

    def _learn(self, chunks: list[bytes]) -> None:
        """Give chunks met for the first time their ids."""
        new = [c.decode() for c in chunks]
        whole = [i for i, c in enumerate(new) if not c.isascii() and not unicodedata.is_normalized("NFC", c)]
        split = list(map(words_of, new))
        for i in whole:
            split[i] = ()
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        at, words = numbered(self.words, chain.from_iterable(split), int(sizes.sum()))
        if words:
            self._learn_words(words)
        n, ids = self.word_ids.get(at)
        sums = np.concatenate(([0], np.cumsum(n)))
        ends = np.concatenate(([0], np.cumsum(sizes)))
        sizes = sums[ends[1:]] - sums[ends[:-1]]
        if whole:  # their ids go in between
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            for i, own in zip(whole, self._ids([new[i] for i in whole]), strict=True):
                parts[i], sizes[i] = np.array(own, np.int64), len(own)
            ids = np.concatenate(parts)
        self.chunk_ids.add(sizes, ids)

    def _split(self, text: bytes) -> list[bytes] | None:
        low = text.lower()
        return None if any(x in low for x in (b"\x0b", b"\x0c", b"\x00", *self.special)) else low.split()

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text followed by the end id."""
        if len(self.words) > WORDS:
            self.words, self.word_ids = {}, _Lists()
        if len(self.chunks) > CACHE:
            self.chunks, self.chunk_ids = {}, _Lists()
        split = [self._split(t) for t in texts]
        sizes = np.array([len(chunks or ()) for chunks in split], np.int64)
        at, new = numbered(self.chunks, chain.from_iterable(filter(None, split)), int(sizes.sum()))
        if new:
            self._learn(new)
        end = np.array([END_ID], np.uint32)
        out, begin = [], 0
        for t, chunks, n in zip(texts, split, sizes.tolist(), strict=True):
            ids = self._whole(t) if chunks is None else self.chunk_ids.get(at[begin : begin + n])[1].astype(np.uint32)
            begin += n
            out.append(np.concatenate((ids, end)))
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def difference(sizes: list[int], ways: int) -> list[list[int]]:
    """Karmarkar-Karp: indices of ``sizes`` in ``ways`` sets of nearly equal sums."""
    heap = []
    for i, n in enumerate(sizes):
        sums = np.zeros(ways, np.int64)
        sums[-1] = n
        heap.append((-n, i, sums, [*([[]] * (ways - 1)), [i]]))
    heapq.heapify(heap)
    number = len(sizes)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        merged = a + b[::-1]
        sets = [p + q if p and q else p or q for p, q in zip(x, reversed(y))]
        order = np.argsort(merged, kind="stable")
        merged = merged[order]
        number += 1
        heapq.heappush(heap, (int(merged[0] - merged[-1]), number, merged, [sets[i] for i in order.tolist()]))
    return heap[0][3] if heap else []


def deal_windows(sizes: list[int], window: int) -> list[list[int]]:
    ways = max(1, -(-sum(sizes) // window))
    while True:
        sets = [s for s in difference(sizes, ways) if s]
        if all(sum(sizes[i] for i in s) <= window for s in sets):
            return sets
        ways += 1


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, window: int = WINDOW, piece: int = PIECE, group: int = GROUP, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, on demand, its ids."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.int64()] * 7
    if with_ids:
        names, kinds = [*names, "ids"], [*kinds, pa.list_(pa.int32())]

    def run(batches):
        code = encoder(tokenizer)
        sequence = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        waiting: list[tuple] = []
        total = 0

        def row(doc, start: int, ids: np.ndarray, size: int, number: int, offset: int) -> tuple:
            own = (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), size, number, offset)
            return (*own, ids.astype(np.int32)) if with_ids else own

        def close():
            nonlocal sequence, total
            for members in deal_windows([len(w[2]) for w in waiting], window):
                offset = 0
                for i in members:
                    rows.append(row(*waiting[i], sequence, offset))
                    offset += len(waiting[i][2])
                sequence += 1
            waiting.clear()
            total = 0

        def out():
            done = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows.clear()
            return done

        for batch in common.slices(batches, text):
            ids_of = batch.column(batch.schema.get_field_index(doc_id)).to_pylist()
            for doc, ids in zip(ids_of, code.encode(common.as_bytes(batch.column(batch.schema.get_field_index(text)))), strict=True):
                size = len(ids)
                whole = size - size % window
                for start in range(0, whole, window):
                    rows.append(row(doc, start, ids[start : start + window], size, sequence, 0))
                    sequence += 1
                for start in range(whole, size, piece):
                    part = ids[start : start + piece]
                    waiting.append((doc, start, part, size))
                    total += len(part)
                    windows = -(-total // window)
                    if windows >= group and FREE[0] <= 1 - total / (windows * window) <= FREE[1]:
                        close()
            if rows:
                yield out()
        if waiting:
            close()
        if rows:
            yield out()
        common.release()

    ddl = ", ".join(f"{n} bigint" for n in names[:7]) + (", ids array<int>" if with_ids else "")
    source = docs.select(docs[doc_id].cast("bigint").alias(doc_id), text)
    return source.mapInArrow(run, ddl)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
