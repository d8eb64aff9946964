"""Byte-level BPE encoding and decoding with the ranks of a public tokenizer.

Encoding.  A text is cut by the tokenizer's pattern.  The distinct matches ("words") of all texts, each once, are merged by
Spark's higher-order functions: ``aggregate`` folds over a state of byte pieces and the ranks of adjacent pairs, and every step
joins the leftmost pair of lowest rank; ranks come from a literal map, dealt into small maps by a checksum because Spark
searches a map from its beginning.  A word that is a token by itself is that token, as the library does it.

Documents are dealt into batches of about ``UNIT`` bytes of text (one exchange, compressed).  A batch sends each distinct word that
is no token once; the merged words come back, packed by batch, to those that asked, where texts become ids by look-up.  Look-ups
go by whole pieces between single blanks: no match of the pattern crosses a blank with other characters on both sides, so the
pattern runs once over each distinct piece of a batch.  A word, however frequent, is one entry per batch, rows are spread by
their place and not by a key, and nothing but the ranks (a fixed file) is in a plan or broadcast.  Matches of more than ``LONG`` bytes (a fold's cost grows with the square) and words that a recomputed batch had
not sent are merged beside their text by ``merge``, which gives the same ids in n log n.

Decoding concatenates the binary pieces of the ids in the JVM (as hexadecimal digits, ``unhex`` makes them bytes).

Defined results: a null or empty text has no ids and decodes to no bytes; special tokens' strings are ordinary text; every row is
encoded by itself, so repeated rows, ties and null ids change nothing; an empty table stays empty; decoding skips null ids and
ids outside the vocabulary; null ids lists decode to null; other columns pass through if named in ``keep``, whatever their names."""

from __future__ import annotations

import base64
import heapq
import json
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import common
from .rounds import deal, unpacked

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LONG, UNIT, MAPS, NONE = 512, 32 << 20, 1 << 15, 2**31 - 1
#: merged words packed at a time
PACK = 1 << 18
#: the library's white space is Unicode's; Python's has the separators 28 to 31 too
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def read_ranks(path: str = RANKS) -> dict[bytes, int]:
    """Token bytes to rank; every single byte must be a token."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}
    if missing := [i for i in range(256) if bytes([i]) not in ranks]:
        raise ValueError(f"{path} lacks the bytes {missing}")
    return ranks


def splitter(pattern: str = public_tokenizers.PATTERN) -> regex.Pattern:
    """The pattern with the library's notion of white space."""
    inside = regex.sub(r"\[\^([^\]]*)\\s([^\]]*)\]", lambda m: f"[^{m[1]}{SPACE}{m[2]}]", pattern)
    return regex.compile(inside.replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word of any length: pairs wait in a heap by rank and place, pieces are a linked list."""
    if word in ranks:
        return [ranks[word]]
    size = len(word)
    end, before, alive = list(range(1, size + 1)), list(range(-1, size - 1)), bytearray(b"\1") * size
    heap = [(r, i, i + 2) for i in range(size - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= size or end[j] != stop:
            continue  # one of the two pieces has changed since
        alive[j], end[i] = 0, stop
        if stop < size:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (k := before[i]) >= 0 and (r := ranks.get(word[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    return [ranks[word[i : end[i]]] for i in range(size) if alive[i]]


def rank_maps(ranks: dict[bytes, int]) -> Column:
    """The literal rank map: an array of ``MAPS`` maps from hexadecimal digits to rank, a token lying in the one that its
    checksum names."""
    dealt: list[dict[str, int]] = [{} for _ in range(MAPS)]
    for token, rank in ranks.items():
        dealt[zlib.crc32(token) % MAPS][token.hex().upper()] = rank
    return F.from_json(F.lit(json.dumps(dealt, separators=(",", ":"))), "array<map<string,int>>")


def _let(value: Column, then) -> Column:
    return F.get(F.transform(F.array(value), then), F.lit(0))


def fold(word: Column, ranks: dict[bytes, int]) -> Column:
    """Ids of a word (binary, not empty) by a fold of ranked merges over its byte array."""

    def ids(maps: Column) -> Column:
        rank = lambda b: F.try_element_at(F.get(maps, F.crc32(b) % MAPS), F.hex(b))
        known = lambda b: F.coalesce(rank(b), F.lit(NONE))
        size = F.octet_length(word)
        cut = lambda starts, i, j: F.substring(word, F.get(starts, i), F.get(starts, j) - F.get(starts, i))  # noqa: E731  nothing beyond the ends

        def join_at(state: Column, k: Column) -> Column:
            starts, pairs = state["starts"], state["pairs"]
            # ``flatten`` puts arrays together at less cost than ``concat``
            beside = F.array(known(cut(starts, k - 3, k)), known(cut(starts, k - 2, k + 1)))
            fewer = F.flatten(F.array(F.slice(starts, F.lit(1), k - 1), F.slice(starts, k + 1, size)))
            return F.struct(fewer.alias("starts"), F.flatten(F.array(F.slice(pairs, F.lit(1), k - 2), beside, F.slice(pairs, k + 2, size))).alias("pairs"))

        def step(state: Column, _: Column) -> Column:
            lowest = F.array_min(state["pairs"])
            return F.when(lowest < NONE, _let(F.array_position(state["pairs"], lowest).cast("int"), lambda k: join_at(state, k))).otherwise(state)

        # where pieces begin, up to the end; ranks of pairs, between two that are none
        none = F.array(F.lit(NONE))
        begin = F.struct(
            F.sequence(F.lit(1), size + 1).alias("starts"), F.concat(none, F.transform(F.sequence(F.lit(1), size - 1), lambda i: known(F.substring(word, i, F.lit(2)))), none).alias("pairs"),
        )
        pieces = lambda starts: F.transform(F.slice(starts, F.lit(1), F.size(starts) - 1), lambda a, i: rank(F.substring(word, a, F.get(starts, i + 1) - a)))
        folded = F.aggregate(F.sequence(F.lit(1), size - 1), begin, step, lambda state: pieces(state["starts"]))
        return _let(rank(word), lambda own: F.when(own.isNotNull(), F.array(own)).otherwise(folded))

    return _let(rank_maps(ranks), ids)


#: blanks between two characters that are no white space (of Python, which has more of it than the library)
BLANK, ODD = re.compile(r"(?<=\S) (?=\S)"), re.compile(r" (?:(?<=\s )|\s|\Z)")


def pieces(text: str) -> list[str]:
    """A text without the blanks at which no match goes on."""
    return BLANK.split(text) if text[:1] == " " or ODD.search(text) else text.split(" ")


def piece_words(pattern: str):
    """The function that cuts a piece with a blank before it.  Most pieces are letters, or letters and one mark, which the default
    pattern leaves whole: they need no search."""
    cut = splitter(pattern).findall
    if pattern != public_tokenizers.PATTERN:
        return lambda piece: cut(" " + piece)

    def words(piece: str):
        if piece.isalpha():
            return (" " + piece,)
        head, mark = piece[:-1], piece[-1:]
        if mark and mark in ".,;:!?" and head.isalpha():
            return " " + head, mark
        return cut(" " + piece)

    return words


class _Words(dict):
    """Words to ids as bytes; what is not there is merged on first use."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> bytes:
        ids = np.array(merge(word.encode(), self.ranks), "<i4").tobytes()
        if len(word) <= LONG:
            self[word] = ids
        return ids


class _Pieces(dict):
    """Pieces behind a blank to ids as bytes."""

    def __init__(self, words: _Words, pattern: str):
        super().__init__()
        self.words, self.cut, self.cut_first = words, piece_words(pattern), splitter(pattern).findall

    def __missing__(self, piece: str) -> bytes:
        ids = b"".join(map(self.words.__getitem__, self.cut(piece)))
        if len(piece) <= LONG:
            self[piece] = ids
        return ids

    def text(self, text: str) -> bytes:
        first, *rest = pieces(text)
        return b"".join([*map(self.words.__getitem__, self.cut_first(first)), *map(self.__getitem__, rest)])


def _packed(batches):
    """``batches, word, ids`` -> ``batch, words``: the merged words of each batch as compressed Arrow streams."""
    held: list[pa.RecordBatch] = []

    def flush():
        table = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        sizes = pc.list_value_length(table.column("batches")).combine_chunks().to_numpy()
        batch = table.column("batches").combine_chunks().flatten().to_numpy()
        order = np.argsort(batch, kind="stable")
        rows, batch = np.repeat(np.arange(len(sizes)), sizes)[order], batch[order]
        lead = np.flatnonzero(np.concatenate(([True], batch[1:] != batch[:-1]))).tolist()
        words, blobs = table.select(["word", "ids"]), []
        for a, b in zip(lead, [*lead[1:], len(rows)]):
            part, sink = words.take(pa.array(rows[a:b])).sort_by("word"), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(part)
            blobs.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(batch[lead], pa.int32()), pa.array(blobs, pa.binary())], names=["batch", "words"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= PACK:
            yield flush()
    if held:
        yield flush()
    common.release()


def encode(docs: DataFrame, keep: list[str] | None = None, text: str = "text", path: str = RANKS, pattern: str = public_tokenizers.PATTERN, unit: int = UNIT) -> tuple[DataFrame, str]:
    """``keep`` columns and a struct of ``ids`` (an array) and ``packed`` (the same as little-endian 32-bit integers); its name, which
    clashes with none of them, is returned too."""
    keep = ["doc_id"] if keep is None else keep
    name, ranks = common.free_name(keep, "encoded"), read_ranks(path)
    own = [f"k{i}" for i in range(len(keep))]
    names = [*own, "_ids", "_packed"]
    base = docs.select(*[F.col(c).alias(k) for k, c in zip(own, keep, strict=True)], F.monotonically_increasing_id().alias("_place"), F.col(text).alias("_text"))
    batches = max(8, math.ceil(common.text_bytes(docs, text) / unit))
    kept = to_arrow_schema(base.select(*own).schema)

    def words(table: pa.Table) -> pa.Table:
        first, rest, found = set(), set(), set()
        for part in unpacked(table, "_text"):
            for value in part.column("_text").to_pylist():
                lead, *more = pieces(value or "")
                first.add(lead)
                rest.update(more)
        cut_first, cut = splitter(pattern).findall, piece_words(pattern)
        for piece in first:
            found.update(cut_first(piece))
        for piece in rest:
            found.update(cut(piece))
        sent = sorted(b for w in found if len(b := w.encode()) <= LONG and b not in ranks)
        number = table.column("batch")[0].as_py() if table.num_rows else 0
        return pa.table({"batch": pa.array([number] * len(sent), pa.int32()), "word": pa.array(sent, pa.binary())})

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        known = _Words(ranks)
        for blob in right.column("words"):
            for part in pa.ipc.open_stream(blob.as_buffer()):
                ids = part.column("ids")
                flat, at = ids.flatten().to_numpy().astype("<i4").tobytes(), np.concatenate(([0], np.cumsum(ids.value_lengths().to_numpy()))) * 4
                known.update((w.decode(), flat[a:b]) for w, a, b in zip(part.column("word").to_pylist(), at.tolist(), at[1:].tolist()))
        encoder, parts = _Pieces(known, pattern), []
        for part in unpacked(left, "_text") if left.num_rows else ():
            blobs = [encoder.text(value or "") for value in part.column("_text").to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(b) // 4 for b in blobs]))).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(blobs), "<i4"), pa.int32())
            parts.append(pa.table([*(part.column(k) for k in own), pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(blobs, pa.binary())], names=names))
        nothing = pa.table([*(pa.array([], f.type) for f in kept), pa.array([], pa.list_(pa.int32())), pa.array([], pa.binary())], names=names)
        return pa.concat_tables([p.cast(nothing.schema) for p in parts]) if parts else nothing

    groups = deal(base, batches, "_place", "_text").groupBy("batch")
    asked = groups.applyInArrow(common.released(words), "batch int, word binary")
    merged = asked.groupBy("word").agg(F.collect_list("batch").alias("batches")).select("batches", "word", fold(F.col("word"), ranks).alias("ids"))
    told = merged.mapInArrow(_packed, "batch int, words binary")
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in base.select(*own).schema)
    found = groups.cogroup(told.groupBy("batch")).applyInArrow(common.released_pair(look_up), schema + "_ids array<int>, _packed binary")
    return found.select(*[F.col(k).alias(c) for k, c in zip(own, keep, strict=True)], F.struct(F.col("_ids").alias("ids"), F.col("_packed").alias("packed")).alias(name)), name


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of a list of ids: their pieces, one after the other."""
    digits = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        digits[rank] = token.hex()
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(F.split(F.lit(",".join(digits)), ","), i)), ""))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, name = encode(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    s = F.col(name)
    return found.select("doc_id", F.size(s["ids"]).cast("bigint").alias("n_tokens"), F.sha2(s["packed"], 256).alias("ids_sha256"), F.sha2(decode(s["ids"], read_ranks()), 256).alias("decoded_sha256"))
