"""Removal of passages that repeat across documents, by fixed-block anchors.

Any window of ``WINDOW`` words holds a whole block of ``BLOCK = (WINDOW + 1) // 2`` words of its text's fixed grid.  So
(1) the non-overlapping blocks of every document are indexed and every rolling block of every document probes the
index; (2) an anchor found in more than one document is extended: the windows around each of its places are hashed
and compared across documents, so that overlapping equal windows make up the maximal exact repeats; (3) a word inside
a window that also starts in a document of a smaller id is removed.  Each step is one exchange of ``rounds``: batches
send distinct keys, buckets answer, and nothing gathers the places of a frequent passage in one task.

Anchors are compared on at least 38 bits, which can only add candidates; windows on 64 bits of one word hash and 32 of
another, independent one.

Defined results: null and empty texts have no words; a document of fewer than ``WINDOW`` words loses nothing; windows are
judged on the input; rows with the same ``doc_id`` (an integer) count as one document and never remove each other's words,
and so do rows without an id, which come after all others; other columns pass through in ``keep``, whatever their names."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import common
from .rounds import batch_number, by_bucket, deal, joined, message, senders, unpacked
from .wordnum import Words, covered, grams, member

WINDOW = 13
PART = 2 << 20
NO_ID = (1 << 63) - 1


def _parts(table: pa.Table):
    """(ids, Words, rows) of about 2 MB of text each."""
    for batch in unpacked(table, "_text", PART):
        yield pc.fill_null(batch.column("_id"), NO_ID).to_numpy(), Words(common.as_bytes(batch.column("_text"))), batch


def _valid(words: Words, n: int) -> np.ndarray:
    """Places where n words of one text begin."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.int64)
    return np.flatnonzero(np.arange(m) + n <= words.last()[:m])


def _second(words: Words, n: int, at: np.ndarray) -> np.ndarray:
    """32 bits of the windows at ``at``, from word hashes of the other family."""
    if not len(at):
        return np.empty(0, np.uint32)
    h = words.hashes(1)
    total = np.zeros(len(at), np.uint64)
    for j in range(n):
        total = (total + h[at + j]) * np.uint64(0xDA942042E4DD58B5)
        total ^= total >> np.uint64(29)
    return (total >> np.uint64(32)).astype(np.uint32)


def _runs(mask: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, end) of the maximal runs of marked words; places count from their text's first word."""
    edge = np.concatenate(([False], mask, [False]))
    begin, end = np.flatnonzero(~edge[:-1] & edge[1:]), np.flatnonzero(edge[:-1] & ~edge[1:])
    cuts = first[1:-1]  # a run does not go on into the next text
    inner = cuts[mask[np.minimum(cuts, len(mask) - 1)] & mask[np.maximum(cuts, 1) - 1] & (cuts > 0) & (cuts < len(mask))] if len(mask) else cuts[:0]
    begin, end = np.sort(np.concatenate((begin, np.unique(inner)))), np.sort(np.concatenate((end, np.unique(inner))))
    text = np.searchsorted(first, begin, side="right") - 1
    return text, begin - first[text], end - first[text]


def _anchor_keys(ids: np.ndarray, words: Words, block: int):
    """(place, key, aligned) of every rolling block."""
    at = _valid(words, block)
    keys = grams(words.hashes(), block)[at] if len(at) else np.empty(0, np.uint64)
    begin = np.repeat(words.first[:-1], words.counts)[at]
    return at, keys, (at - begin) % block == 0


def _low(keys: np.ndarray, bucket: int, buckets: int) -> np.ndarray:
    """30 bits of each key inside its bucket's range."""
    width = (1 << 64) // buckets + 1
    inside = keys - np.uint64((bucket * width) & ((1 << 64) - 1))
    return (inside >> np.uint64(max(0, width.bit_length() - 30))).astype(np.uint32)


def remove_repeats(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """``keep`` columns and a struct column (its name is returned) of n_words, n_removed, starts and ends (word spans of the
    removed passages) and kept (the words kept, joined by one space; null stays empty)."""
    keep = [doc_id] if keep is None else keep
    name = common.free_name(keep)
    block = (window + 1) // 2
    buckets = batch_number(docs, text)
    base = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(doc_id).cast("bigint").alias("_id"), F.col(text).alias("_text"))
    dealt = deal(base, buckets, "_id", "_text")

    names = [*[f"k{i}" for i in range(len(keep))], "n_words", "n_removed", "starts", "ends", "kept"]
    kinds = [*to_arrow_schema(base.select(*[f"k{i}" for i in range(len(keep))]).schema).types, pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()]

    def probe(table: pa.Table) -> pa.Table:
        """Distinct rolling-block keys with two flags: aligned somewhere, in two or more documents of this batch."""
        keys, flags, owners = [], [], []
        for ids, words, _ in _parts(table):
            at, k, aligned = _anchor_keys(ids, words, block)
            keys.append(k)
            flags.append(aligned)
            owners.append(ids[words.doc_of()[at]])
        key, flag, owner = (np.concatenate(x) if x else np.empty(0) for x in (keys, flags, owners))
        order = np.argsort(key, kind="stable")
        key, flag, owner = key[order], flag[order], owner[order]
        if not len(key):
            return message([], 0, data=[])
        lead = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        many = np.maximum.reduceat(owner, lead) != np.minimum.reduceat(owner, lead)
        aligned = np.logical_or.reduceat(flag, lead)
        key = key[lead]
        marks = aligned.astype(np.uint32) * 2 + many
        full, bounds = by_bucket(key, buckets)
        data = [(_low(key[bounds[b] : bounds[b + 1]], int(b), buckets) * np.uint32(4) + marks[bounds[b] : bounds[b + 1]]).tobytes() for b in full]
        return message(full.tolist(), table.column("batch")[0].as_py(), data=data)

    def match(table: pa.Table) -> pa.Table:
        """Tell each batch which of its keys are aligned somewhere and lie in two or more documents."""
        values, sender = joined(table, "data", np.uint32), senders(table, "data", 4)
        order = np.argsort(values >> 2, kind="stable")
        low = (values >> 2)[order]
        lead = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        marks = np.bitwise_or.reduceat(values[order] & 3, lead)
        n = np.diff(np.concatenate((lead, [len(low)])))
        shared = (marks >= 2) & ((n > 1) | (marks & 1 == 1))
        hit = np.zeros(len(low), bool)
        hit[order] = np.repeat(shared, n)
        values, sender = values[hit] >> 2, sender[hit]
        bounds = np.searchsorted(sender, np.arange(table.num_rows + 1))
        rows = [i for i in range(table.num_rows) if bounds[i + 1] > bounds[i]]
        batch = table.column("batch").to_numpy()
        return pa.table({"bucket": table.column("bucket").take(pa.array(rows, pa.int64())), "batch": pa.array(batch[rows], pa.int32()), "data": pa.array([np.sort(values[bounds[i] : bounds[i + 1]]).astype(np.uint32).tobytes() for i in rows], pa.binary())})

    def anchored(table: pa.Table, answers: pa.Table):
        """Windows around the anchors: (ids, words, places, keys, checks) part by part."""
        told: list[np.ndarray] = []
        for b, data in zip(answers.column("bucket").to_pylist(), answers.column("data").to_pylist(), strict=True):
            told.append((np.uint64(b) << np.uint64(32)) + np.frombuffer(data, np.uint32).astype(np.uint64))
        shared = np.sort(np.concatenate(told)) if told else np.empty(0, np.uint64)
        width = np.uint64((1 << 64) // buckets + 1)
        shift = np.uint64(max(0, int(width).bit_length() - 30))
        for ids, words, _ in _parts(table):
            at, keys, _ = _anchor_keys(ids, words, block)
            b = keys // width
            place = ((b << np.uint64(32)) + ((keys - b * width) >> shift)) if len(keys) else keys
            found, _ = member(place, shared)
            near = np.zeros(len(words), bool)
            for back in range(window - block + 1):
                begin = at[found] - back
                near[begin[begin >= 0]] = True
            valid = _valid(words, window)
            valid = valid[near[valid]]
            h = words.hashes() if len(valid) else np.empty(0, np.uint64)
            keys = grams(h, window)[valid] if len(valid) else np.empty(0, np.uint64)
            yield ids, words, valid, keys, _second(words, window, valid)

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        """Distinct candidate windows of the batch with the smallest and largest id they start in."""
        found = [(k, c, ids[words.doc_of()[at]]) for ids, words, at, k, c in anchored(left, right) if len(at)] if left.num_rows and right.num_rows else []
        if not found:
            return message([], 0, data=[])
        key, check, owner = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((check, key))
        key, check, owner = key[order], check[order], owner[order]
        lead = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (check[1:] != check[:-1]))))
        low, high = np.minimum.reduceat(owner, lead), np.maximum.reduceat(owner, lead)
        key, check = key[lead], check[lead]
        full, bounds = by_bucket(key, buckets)
        cuts = [slice(bounds[b], bounds[b + 1]) for b in full]
        data = [key[c].tobytes() + low[c].tobytes() + high[c].tobytes() + check[c].tobytes() for c in cuts]
        return message(full.tolist(), left.column("batch")[0].as_py(), data=data)

    def unpack(data: bytes) -> tuple[np.ndarray, ...]:
        n = len(data) // 28
        return np.frombuffer(data, np.uint64, n), np.frombuffer(data, np.int64, n, 8 * n), np.frombuffer(data, np.int64, n, 16 * n), np.frombuffer(data, np.uint32, n, 24 * n)

    def first_owner(table: pa.Table) -> pa.Table:
        """Smallest id of each window over the corpus, for batches that hold it in a larger one."""
        parts = [unpack(x) for x in table.column("data").to_pylist()]
        key, low, high, check = (np.concatenate(x) for x in zip(*parts, strict=True))
        sender = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        order = np.lexsort((check, key))
        lead = np.concatenate(([True], (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])))
        least = np.empty(len(key), np.int64)
        least[order] = np.minimum.reduceat(low[order], np.flatnonzero(lead))[np.cumsum(lead) - 1]
        hit = least < high
        key, check, least, sender = key[hit], check[hit], least[hit], sender[hit]
        bounds = np.searchsorted(sender, np.arange(table.num_rows + 1))
        rows = [i for i in range(table.num_rows) if bounds[i + 1] > bounds[i]]
        cuts = [slice(bounds[i], bounds[i + 1]) for i in rows]
        batch = table.column("batch").to_numpy()
        return pa.table({"bucket": table.column("bucket").take(pa.array(rows, pa.int64())), "batch": pa.array(batch[rows], pa.int32()), "data": pa.array([key[c].tobytes() + least[c].tobytes() + least[c].tobytes() + check[c].tobytes() for c in cuts], pa.binary())})

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        """Cover the removed words and join the rest."""
        parts = [unpack(x) for x in right.column("data").to_pylist()]
        key, least, _, check = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.uint64), np.empty(0, np.int64), None, np.empty(0, np.uint32))
        order = np.lexsort((check, key))
        key, least, check = key[order], least[order], check[order]
        lead = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        single = len(lead) == len(key)
        tables = [pa.table({n: pa.array([], t) for n, t in zip(names, kinds, strict=True)})]
        for ids, words, rows in _parts(left):
            gone = np.zeros(len(words), bool)
            at = _valid(words, window)
            if len(key) and len(at):
                k = grams(words.hashes(), window)[at]
                found, place = member(k, key)
                at, place = at[found], place[found]
                c = _second(words, window, at)
                owner = ids[words.doc_of()[at]]
                ok = (check[place] == c) & (least[place] < owner)
                if not single:  # two windows of one 64-bit key: look through the run
                    for i in np.flatnonzero(check[place] != c).tolist():
                        j = int(np.searchsorted(key, k[found][i]))
                        while j < len(key) and key[j] == k[found][i]:
                            ok[i] |= check[j] == c[i] and least[j] < owner[i]
                            j += 1
                gone = covered(at[ok], window, len(words))
            sums = np.concatenate(([0], np.cumsum(gone)))
            lost = sums[words.first[1:]] - sums[words.first[:-1]]
            kept = []
            for d, n in enumerate(lost.tolist()):
                a, b = int(words.first[d]), int(words.first[d + 1])
                if n == 0:
                    kept.append(b" ".join(words.data[words.start[a] : words.end[b - 1]].split()) if b > a else b"")
                else:
                    own = words.data[words.start[a] : words.end[b - 1]].split()
                    kept.append(b" ".join([own[i] for i in np.flatnonzero(~gone[a:b]).tolist()]))
            columns = [rows.column(f"k{i}") for i in range(len(keep))]
            text_out = pa.array(kept, pa.binary()).cast(pa.string())
            of, begin, end = _runs(gone, words.first)
            bounds = pa.array(np.searchsorted(of, np.arange(len(words.counts) + 1)), pa.int32())
            spans = [pa.ListArray.from_arrays(bounds, pa.array(x, pa.int64())) for x in (begin, end)]
            tables.append(pa.table([*columns, pa.array(words.counts, pa.int64()), pa.array(lost, pa.int64()), *spans, text_out], names=names))
        return pa.concat_tables(tables)

    wire = "bucket int, batch int, data binary"
    groups = dealt.groupBy("batch")
    asked = groups.applyInArrow(common.released(probe), wire)
    answers = asked.groupBy("bucket").applyInArrow(common.released(match), wire)
    windows = groups.cogroup(answers.groupBy("batch")).applyInArrow(common.released_pair(extend), wire)
    owners = windows.groupBy("bucket").applyInArrow(common.released(first_owner), wire)
    kept = base.select(*[f"k{i}" for i in range(len(keep))]).schema
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in kept)
    out = groups.cogroup(owners.groupBy("batch")).applyInArrow(common.released_pair(finish), schema + "n_words bigint, n_removed bigint, starts array<bigint>, ends array<bigint>, kept string")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.struct("n_words", "n_removed", "starts", "ends", "kept").alias(name)), name


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, name = remove_repeats(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    s = F.col(name)
    return found.select("doc_id", s["n_words"].alias("n_words"), s["n_removed"].alias("n_removed"), F.sha2(s["kept"].cast("binary"), 256).alias("kept_sha256"))


def brute_force(docs: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple[int, int, int, str]]:
    import re

    least: dict[tuple, int] = {}
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    for d, w in split:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            least[key] = min(d, least.get(key, d))
    out = []
    for d, w in split:
        gone = {i + j for i in range(len(w) - window + 1) if least[tuple(w[i : i + window])] < d for j in range(window)}
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return out


def sql(window: int = WINDOW) -> str:
    blanks = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
    return f"""
WITH w AS (SELECT doc_id, list_filter(string_split(translate(coalesce(text, ''), {blanks}, '     '), ' '), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + {window - 1}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {window - 2})) AS i FROM w)),
low AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS m FROM win),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM low, (SELECT unnest(range({window})) AS j) WHERE m < doc_id),
lost AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN n IS NULL THEN array_to_string(ws, ' ') ELSE coalesce(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(ps, i)), ' '), '') END) AS kept_sha256
FROM w LEFT JOIN lost USING (doc_id)"""
