"""Benchmark decontamination by winnowing.

Of every span of ``SPAN`` benchmark words (an item with fewer words counts as one span of its own length m) and of
every document the same fingerprints are kept: hashes of k-word runs, k = (m + 1) // 2, of which each sliding window
of m - k + 1 runs keeps its smallest (the rightmost on ties).  Two texts that share m words share a whole window and
so its fingerprint.  Document fingerprints are joined with those of the benchmark inside the scan, and each hit is
extended word by word, on the words themselves, to the longest shared run; runs of m words or more are leaks.

The benchmark is the small side.  It is broadcast in blocks of at most ``BLOCK_BYTES`` of text; a larger benchmark
takes one pass over the documents per block, with a reliable checkpoint between passes.  There is no shuffle.

Defined results: null or empty text has no words and is clean; an item without words is ignored; items with equal
words are all reported; repeated rows are judged one by one; an empty benchmark leaves every document clean; other
columns of the documents pass through untouched."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .wordnum import ALNUM, Words, grams, member

SPAN = 10
BLOCK_BYTES = 32 << 20


def words_of(texts: list[bytes]) -> Words:
    return Words([t.lower() for t in texts], ALNUM)


def winnow(hashes: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, values) of the fingerprints for shared spans of ``length`` words."""
    k = (length + 1) // 2
    window = length - k + 1
    runs = grams(hashes, k)
    n = len(runs) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    best, where = runs[:n].copy(), np.zeros(n, np.int8)
    for j in range(1, window):
        other = runs[j : j + n]
        take = other <= best
        np.copyto(best, other, where=take)
        where[take] = j
    at = np.flatnonzero(np.arange(n) + length <= last[:n])
    place = at + where[at]
    if len(place):
        place = place[np.concatenate(([True], place[1:] != place[:-1]))]
    return place, runs[place]


class Index:
    """Fingerprints of one block of the benchmark."""

    def __init__(self, items: list[tuple[object, bytes]], span: int = SPAN):
        ids: dict[tuple[bytes, ...], list] = defaultdict(list)
        texts = words_of([t for _, t in items])
        for d, (item, _) in enumerate(items):
            own = tuple(texts.word(i) for i in range(texts.first[d], texts.first[d + 1]))
            if own:
                ids[own].append(item)
        self.items = list(ids)
        self.ids = [sorted(map(str, x)) for x in ids.values()]
        self.need = [min(span, len(x)) for x in self.items]
        self.tables: dict[int, tuple[np.ndarray, list[list[tuple[int, int]]]]] = {}
        found: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for j, own in enumerate(self.items):
            w = Words([b" ".join(own)], ALNUM)
            for place, value in zip(*(x.tolist() for x in winnow(w.hashes(), w.last(), self.need[j])), strict=True):
                found[self.need[j]][value].append((j, place))
        for length, by in found.items():
            keys = np.array(sorted(by), np.uint64)
            self.tables[length] = keys, [by[int(x)] for x in keys]

    def leaks(self, texts: Words) -> dict[int, tuple[list[tuple[int, int]], set[int]]]:
        """For each text with leaks: word spans relative to the text, and the items found."""
        out: dict[int, tuple[list, set]] = {}
        hashes, last = texts.hashes(), texts.last()
        for length, (keys, entries) in self.tables.items():
            place, values = winnow(hashes, last, length)
            hit, at = member(values, keys)
            done: dict[tuple[int, int], int] = {}
            for p, e in zip(place[hit].tolist(), at[hit].tolist(), strict=True):
                hi = int(last[p])
                d = int(np.searchsorted(texts.first, p, side="right")) - 1
                lo = int(texts.first[d])
                for j, q in entries[e]:
                    if done.get((j, p - q), -1) > p:
                        continue
                    own = self.items[j]
                    right = 0
                    while p + right < hi and q + right < len(own) and texts.word(p + right) == own[q + right]:
                        right += 1
                    left = 0
                    while right and p - left > lo and q > left and texts.word(p - left - 1) == own[q - left - 1]:
                        left += 1
                    done[j, p - q] = p + max(right, 1)
                    if left + right >= self.need[j]:
                        spans, items = out.setdefault(d, ([], set()))
                        spans.append((p - left - lo, p + right - lo))
                        items.add(j)
        return out


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame, limit: int) -> list[DataFrame]:
    """The benchmark in parts of about ``limit`` bytes of text, by a hash of the id."""
    size = common.text_bytes(benchmark)
    n = -(-size // limit) or 1
    part = F.pmod(F.xxhash64(F.col("item_id").cast("string")), F.lit(n))
    return [benchmark.where(part == i) if n > 1 else benchmark for i in range(n)]


def find_leaks(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, span: int = SPAN, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, str]:
    """``keep`` columns of ``docs`` and one struct column, whose name is returned too: n_words, n_hit, n_items,
    item_ids (sorted as strings), starts and ends (merged word spans)."""
    keep = ["doc_id"] if keep is None else keep
    spark = docs.sparkSession
    parts = blocks(benchmark.select("item_id", "text"), block_bytes)
    state, reads = docs, ["text"]
    fields = "n_words bigint, n_hit bigint, n_items bigint, item_ids array<string>, starts array<bigint>, ends array<bigint>"
    name = ""
    for number, part in enumerate(parts):
        items = [(r["item_id"], (r["text"] or "").encode()) for r in part.collect()]
        shared = spark.sparkContext.broadcast(Index(items, span))
        final = number == len(parts) - 1
        before = name

        def make(shared=shared, before=before):
            def work(batch: pa.RecordBatch) -> list[pa.Array]:
                index = shared.value
                texts = words_of(common.as_bytes(batch.column(batch.schema.get_field_index("text"))))
                found = index.leaks(texts)
                old = batch.column(batch.schema.get_field_index(before)).to_pylist() if before else None
                rows = []
                for d, n in enumerate(texts.counts.tolist()):
                    spans, numbers = found.get(d, ((), ()))
                    ids = [x for j in numbers for x in index.ids[j]]
                    spans = list(spans)
                    if old and old[d]["item_ids"]:
                        ids += old[d]["item_ids"]
                        spans += zip(old[d]["starts"], old[d]["ends"], strict=True)
                    spans = merge(spans)
                    rows.append((n, sum(b - a for a, b in spans), len(ids), sorted(ids), [a for a, _ in spans], [b for _, b in spans]))
                kinds = [pa.int64()] * 3 + [pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]
                return [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]

            return work

        held = keep if final else list(dict.fromkeys([*keep, "text"]))
        state, name = common.annotate(state, make, fields, held, [*([before] if before else []), *reads])
        if not final:
            state = common.cut(state)
    return state, name


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, name = find_leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    s = F.col(name)
    return state.select("doc_id", s["n_words"].alias("n_words"), s["n_hit"].alias("n_hit"), s["n_items"].alias("n_items"),
                        F.sha2(F.array_join(s["item_ids"], ","), 256).alias("items_sha256"), (s["n_hit"] > 0).alias("contaminated"))


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], span: int = SPAN) -> list[tuple]:
    """The contract word for word, for small inputs in tests."""
    import re

    def words(t: str | None) -> list[str]:
        low = "".join(c.lower() if c.isascii() else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    windows: dict[tuple, set] = defaultdict(set)
    for item, t in items:
        w = words(t)
        m = min(span, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            windows[tuple(w[i : i + m])].add(str(item))
    sizes = {len(x) for x in windows}
    out = []
    for doc, t in docs:
        w, hit, ids = words(t), set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if found := windows.get(tuple(w[i : i + m])):
                    ids |= found
                    hit |= set(range(i, i + m))
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


def sql(span: int = SPAN) -> str:
    """The query in DuckDB SQL."""
    words = lambda t: f"regexp_extract_all(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
    return f"""
WITH d AS (SELECT doc_id, {words('text')} AS ws FROM documents),
b AS (SELECT item_id, ws, least({span}, len(ws)) AS m FROM (SELECT item_id, {words('text')} AS ws FROM benchmark) WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - m + 2)) AS i FROM b)),
sizes AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS g FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, sizes)),
hit AS (SELECT doc_id, i, dw.m, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.m = bw.m),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(item.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, pos.n IS NOT NULL AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN item USING (doc_id)"""
