"""SimHash near-duplicates with sharded BK-trees.

A text's fingerprint has a bit set if more than half of its word shingles' XXH64 values (seed 42) have it.  Equal
fingerprints are merged first (a partial aggregation), so copies cost nothing further.  Two fingerprints within
``radius`` bits agree on at least two of ``radius + 2`` bit blocks; each pair of blocks names a shard, and a link is
found in any shard the two share.  In each shard a BK-tree holds the fingerprints (children keyed by their Hamming
distance to the parent), and every member searches it, following only edges within the radius of its own distance.
All trees of a partition are built and searched level by level as arrays.

A shard of more than ``SHARD_ROWS`` members is dealt into sub-shards by a hash; each tree is then sent to every
sub-shard's members (one work unit per pair of sub-shards), so no unit outgrows memory and no link is lost.  A shard
reports a spanning forest of its links rather than all pairs; components come from star contraction.

Defined results: null, empty and white-space texts have fingerprint zero and link to each other; a text of fewer than
``words`` words is one shingle; repeated rows and ties keep their own rows; an empty table gives an empty table; other
columns pass through in ``keep``."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

SHARD_ROWS = 4096
PAIRS = 1 << 20


def fingerprint(text: bytes, words: int) -> int:
    """64-bit SimHash of one text, as a signed integer."""
    w = text.lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for begin in range(0, n, 1 << 16):
        stop = min(n, begin + (1 << 16))
        h = np.fromiter((digest(b" ".join(w[i : i + words]), 42) for i in range(begin, stop)), np.uint64, stop - begin)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 4, keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """``keep`` columns and a struct column (its name is returned) with the field ``fp``."""

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = common.as_bytes(batch.column(batch.schema.get_field_index("text")))
            return [pa.array([fingerprint(t, words) for t in texts], pa.int64())]

        return work

    return common.annotate(docs, make, "fp bigint", keep, ["text"])


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(first bit, width) of radius + 2 blocks."""
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _shard_keys(fp: Column, radius: int) -> Column:
    """Shard keys of a fingerprint: a pair number in the high bits, the two blocks' bits below it."""
    keys = []
    for number, ((a, m), (b, n)) in enumerate(combinations(_blocks(radius), 2)):
        x = F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << m) - 1))
        y = F.shiftrightunsigned(fp, b).bitwiseAND(F.lit((1 << n) - 1))
        keys.append(F.lit(number).cast("bigint") * F.lit(1 << (m + n + 1)) + F.shiftleft(x, n).bitwiseOR(y))
    return F.array(*[F.xxhash64(k, F.lit(i)) for i, k in enumerate(keys)])


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Forest:
    """BK-trees of many shards at once.  ``shard`` is sorted; the first member of each shard is its root."""

    def __init__(self, shard: np.ndarray, values: np.ndarray):
        self.values = values
        n = len(values)
        self.root = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if n else np.empty(0, np.int64)
        parents, edges, nodes = [], [], []
        group, members = shard, np.arange(n)
        above = np.full(n, -1)
        while len(members):
            lead = np.concatenate(([True], group[1:] != group[:-1]))
            at = np.cumsum(lead) - 1
            head = members[lead]
            up = above[lead]
            if up[0] >= 0:
                nodes.append(head)
                parents.append(up)
                edges.append(_distance(values[head], values[up]))
            rest = ~lead
            members, own = members[rest], head[at[rest]]
            d = _distance(values[members], values[own])
            key = at[rest] * 65 + d
            order = np.argsort(key, kind="stable")
            members, above, group = members[order], own[order], key[order]
        node = np.concatenate(nodes) if nodes else np.empty(0, np.int64)
        parent = np.concatenate(parents) if parents else node
        edge = np.concatenate(edges) if edges else node
        key = parent * 65 + edge
        order = np.argsort(key, kind="stable")
        self.key, self.child = key[order], node[order]

    def search(self, query: np.ndarray, root: np.ndarray, radius: int):
        """Yield (query index, member index) of all pairs within the radius; ``root`` is each query's tree."""
        for begin in range(0, len(query), SHARD_ROWS * 4):
            q = np.arange(begin, min(len(query), begin + SHARD_ROWS * 4))
            stack = [(q, root[q])]
            while stack:
                q, node = stack.pop()
                d = _distance(query[q], self.values[node])
                near = d <= radius
                if near.any():
                    yield q[near], node[near]
                low = np.searchsorted(self.key, node * 65 + np.maximum(d - radius, 0), side="left")
                n = np.searchsorted(self.key, node * 65 + np.minimum(d + radius, 64), side="right") - low
                some = n > 0
                q, low, n = q[some], low[some], n[some]
                if not len(q):
                    continue
                ends = np.cumsum(n)
                cuts = [0, *np.searchsorted(ends, np.arange(PAIRS, int(ends[-1]), PAIRS)).tolist(), len(q)]
                for a, b in zip(cuts, cuts[1:]):
                    if a < b:
                        m = n[a:b]
                        step = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
                        stack.append((np.repeat(q[a:b], m), self.child[np.repeat(low[a:b], m) + step]))


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union-find over arrays: labels become the smallest index of each set."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _unit_links(unit: np.ndarray, fp: np.ndarray, asks: np.ndarray, tree: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links found in whole work units (sorted by unit)."""
    members = np.flatnonzero(tree)
    forest = Forest(unit[members], fp[members])
    queries = np.flatnonzero(asks)
    has, at = np.zeros(len(queries), bool), np.zeros(len(queries), np.int64)
    if len(members):
        roots = unit[members][forest.root]
        at = np.minimum(np.searchsorted(roots, unit[queries]), len(roots) - 1)
        has = roots[at] == unit[queries]
    queries, at = queries[has], at[has]
    label = np.arange(len(fp))
    for q, m in forest.search(fp[queries], forest.root[at] if len(members) else at, radius):
        _join(label, queries[q], members[m])
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return fp[moved], fp[label[moved]]


def links(prints: DataFrame, radius: int = 4, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Distinct ``prints(fp)`` -> ``(u, v)``: links within the radius, as a spanning forest per shard."""
    shards = prints.select("fp", F.explode(_shard_keys(F.col("fp"), radius)).alias("shard"))
    sizes = shards.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1")
    dealt = shards.join(sizes, "shard").withColumn("parts", F.ceil(F.col("n") / F.lit(shard_rows)).cast("bigint"))
    mine = F.pmod(F.xxhash64("fp"), F.col("parts"))
    pairs = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1), lambda other: F.struct(F.least(other, F.col("mine")).alias("a"), F.greatest(other, F.col("mine")).alias("b")))
    units = dealt.withColumn("mine", mine).select("fp", "mine", "shard", F.explode(pairs).alias("p")).select(
        "fp", F.xxhash64("shard", "p.a", "p.b").alias("unit"), (F.col("mine") == F.col("p.a")).alias("tree"), (F.col("mine") == F.col("p.b")).alias("asks"))

    def work(batch: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        col = lambda k: batch.column(k).to_numpy()
        return tuple(x.view(np.int64) for x in _unit_links(col("unit"), col("fp").view(np.uint64), col("asks"), col("tree"), radius))

    return run_units(units, work, 8 * shard_rows)


def run_units(units: DataFrame, work, limit: int, most: int = 64 << 20) -> DataFrame:
    """``(u, v)``: what ``work`` finds in tables of whole work units (rows of one ``unit``), of about ``limit`` rows or ``most`` bytes."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = size = 0

        def flush(table: pa.Table) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in work(table)], schema=schema)

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            size += batch.nbytes
            if rows >= limit or size >= most:
                whole = pa.Table.from_batches(held).combine_chunks()
                unit = whole.column("unit").to_numpy()
                stop = int(np.searchsorted(unit, unit[-1]))
                if stop:
                    yield flush(whole.slice(0, stop))
                    whole = whole.slice(stop)
                held, rows, size = whole.to_batches(), whole.num_rows, whole.nbytes
        if rows:
            yield flush(pa.Table.from_batches(held))
        held.clear()
        common.release()

    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, keep: list[str] | None = None, shard_rows: int = SHARD_ROWS, doc_id: str = "doc_id") -> tuple[DataFrame, str]:
    """``keep`` columns of ``docs`` and one struct column, whose name is returned too: fp and component, the smallest
    ``doc_id`` that can be reached over links (null ids come last)."""
    keep = [doc_id] if keep is None else keep
    found, name = fingerprints(docs.withColumn(common.free_name(docs.columns, "own"), F.col(doc_id)), words, [*keep, common.free_name(docs.columns, "own")])
    own = common.free_name(docs.columns, "own")
    numbered = found.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(own).alias("id"), F.col(name)["fp"].alias("fp"))
    marked = common.cut(numbered)
    # a node names its fingerprint by the smallest id first, so that the smallest node of a component carries the answer
    node = F.struct(F.isnull("id").alias("no_id"), "id", "fp")
    prints = common.cut(marked.groupBy("fp").agg(F.min(node).alias("node")))
    pairs = links(prints.select("fp"), radius, shard_rows)
    by = lambda c: prints.select(F.col("fp").alias(c), F.col("node").alias(f"{c}_node"))
    roots = components(pairs.join(by("u"), "u").join(by("v"), "v").select(F.col("u_node").alias("u"), F.col("v_node").alias("v")))
    named = prints.join(roots.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("fp", F.coalesce("root", "node")["id"].alias("component"))
    out = marked.join(named, "fp")
    name = common.free_name(keep)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.struct("fp", "component").alias(name)), name


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, name = near_duplicates(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.col(name)["fp"]), 16, "0")).alias("fingerprint"), F.col(name)["component"].alias("component_id"))


def brute_force(docs: list[tuple[int, str | None]], words: int = 4, radius: int = 4) -> list[tuple[int, str, int]]:
    import re

    prints = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        shingles = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    up = list(range(len(docs)))

    def root(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                up[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(d, least.get(root(i), d))
    return [(d, f"{prints[i]:016x}", least[root(i)]) for i, (d, _) in enumerate(docs)]
