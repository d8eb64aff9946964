"""SimHash near-duplicates by similarity: BK-trees name the candidate pairs, exact Jaccard similarity decides.

A text's shingles are its distinct runs of five lower-cased words; its fingerprint is the SimHash of these.  Texts with
the same words are merged first.  A pair of similarity 0.8 differs in 10 of 64 bits on average, too many for shards that
are named by fingerprint bits (for 99 % of such pairs over 21-bit shards, a text would have to lie in 143 of them).  So
shards are named by ``BANDS`` keys of ``ROWS`` shingle minima each: a pair of 0.8 shares none of them with probability
(1 - 0.8^5)^25, about 5 in 100 000; more similar pairs are missed less often.

Links are sought in two rounds.  First every member of a shard within ``RADIUS`` bits of the shard's smallest is compared with
it, on the texts.  Shards
that then still hold several components come again, with their members' shingle sets: a BK-tree of a shard's members is
searched by those outside its largest component, following only edges within ``RADIUS`` bits (wide enough for all but some
one in 3000 pairs of 0.8 of few shingles, fewer of long texts), and what it finds in another component is compared exactly, in the first shard that a pair shares, the nearest
first.  A shard returns a spanning forest of its links, so a dense group never becomes all its pairs; large shards are dealt
into parts, and every part of the members meets every part of the askers.

Defined results: null, empty and white-space texts are one text; a text of fewer than five words is one shingle; of each
group the smallest id stays, null ids last; rows without an id and rows that share one are told apart by their content;
rows equal in every column count as one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .simhash import Forest, run_units
from .wordnum import Words, grams

WORDS = 5
#: least similarity as a fraction
LEAST = (4, 5)
BANDS, ROWS = 25, 5
RADIUS = 22
CHUNK = 1 << 11
PART_ROWS, PART_BYTES = 1 << 12, 16 << 20

_DRAWN = np.random.default_rng(42)
_TIMES = _DRAWN.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)
_PLUS = _DRAWN.integers(0, 1 << 32, BANDS * ROWS, np.uint32)


def shingles(text: bytes) -> set[bytes]:
    w = text.lower().split()
    return {b" ".join(w[i : i + WORDS]) for i in range(max(1, len(w) - WORDS + 1))} if w else set()


def alike(a: set[bytes], b: set[bytes]) -> bool:
    both = len(a & b)
    return both * LEAST[1] >= (len(a) + len(b) - both) * LEAST[0]


def shingle_sets(words: Words) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text; a text of fewer than ``WORDS`` words is one shingle."""
    h = words.hashes()
    return [np.unique(grams(h[a:b], min(WORDS, b - a))) if b > a else h[:0] for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist())]


def sketches(texts: list[bytes]) -> tuple[np.ndarray, list[list[int]]]:
    """(signed fingerprints, ``BANDS`` signed keys each); a text without words has fingerprint zero and no keys."""
    prints, keys = np.zeros(len(texts), np.int64), []
    for d, own in enumerate(shingle_sets(Words([t.lower() for t in texts]))):
        if not len(own):
            keys.append([])
            continue
        ones = np.zeros(64, np.int64)
        least = np.full(BANDS * ROWS, (1 << 32) - 1, np.uint32)
        for begin in range(0, len(own), CHUNK):
            some = own[begin : begin + CHUNK]
            ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            np.minimum(least, (_TIMES[:, None] * (some >> np.uint64(32)).astype(np.uint32) + _PLUS[:, None]).min(axis=1), out=least)
        prints[d] = np.packbits(2 * ones > len(own), bitorder="little").view(np.int64)[0]
        keys.append(np.array([xxhash.xxh64_intdigest(m.tobytes(), k) for k, m in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64).tolist())
    return prints, keys


def _row(columns: list[str]) -> Column:
    """64 bits of a whole row; nulls count by their place."""
    return F.xxhash64(*columns, *[F.isnull(c) for c in columns])


def _alike(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``(u, v)`` whose ``texts(node, text)`` are alike."""

    def run(batches):
        last, held = None, set()
        for batch in common.slices(batches, "a"):
            a, b = common.as_bytes(batch.column("a")), common.as_bytes(batch.column("b"))
            good = []
            for v, x, y in zip(batch.column("v").to_pylist(), a, b):
                if v != last:
                    last, held = v, shingles(y)
                good.append(alike(shingles(x), held))
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    left = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u")
    return left.join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v").select("u", "v", "a", "b").mapInArrow(run, "u bigint, v bigint")


def _open_members(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the shards that hold several components; those outside the largest ask."""
    named = shared.join(roots.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = named.groupBy("band", "root").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.count("*").alias("c")).where("c > 1").select("band", "most")
    return common.cut(named.join(mixed, "band").select(F.col("band").alias("shard"), "node", "root", (F.col("root") != F.col("most")).alias("asks")))


def _with_sets(texts: DataFrame) -> DataFrame:
    """``texts(node, text)`` with fp, bands and the sorted shingle hashes, each as bytes."""

    def run(batches):
        for batch in common.slices(batches, "text"):
            data = common.as_bytes(batch.column("text"))
            prints, keys = sketches(data)
            words = Words([t.lower() for t in data])
            sets = [s.tobytes() for s in shingle_sets(words)]
            bands = [np.array(k, np.int64).tobytes() for k in keys]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(prints), pa.array(bands, pa.binary()), pa.array(sets, pa.binary())], names=["node", "fp", "bands", "shingles"])
        common.release()

    return texts.select("node", "text").mapInArrow(run, "node bigint, fp bigint, bands binary, shingles binary")


def _verify(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links between members of different components, unit by unit."""
    unit = table.column("unit").to_numpy()
    cuts = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1]))).tolist() + [len(unit)]
    found = [_verify_unit(table.slice(a, b - a)) for a, b in zip(cuts, cuts[1:])]
    u, v = (np.concatenate(x) for x in zip(*found))
    return np.maximum(u, v), np.minimum(u, v)


def _verify_unit(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    none = np.empty(0, np.int64)
    shard, node, fp, root, tree = (table.column(k).to_numpy(zero_copy_only=False) for k in ("shard", "node", "fp", "root", "tree"))
    members, queries = np.flatnonzero(tree), np.flatnonzero(~tree)
    if not len(members) or not len(queries):
        return none, none
    values = fp.view(np.uint64)
    forest = Forest(np.zeros(len(members), np.int64), values[members])
    pairs = [(q, m, np.bitwise_count(values[queries[q]] ^ values[members[m]])) for q, m in forest.search(values[queries], np.zeros(len(queries), np.int64), RADIUS)]
    if not pairs:
        return none, none
    q, m, d = (np.concatenate(x) for x in zip(*pairs))
    open_ = root[queries[q]] != root[members[m]]
    bands = np.frombuffer(b"".join(table.column("bands").to_pylist()), np.int64).reshape(-1, BANDS)
    q, m, d = q[open_], m[open_], d[open_]
    first = np.concatenate([np.take_along_axis(bands[queries[a]], (bands[queries[a]] == bands[members[b]]).argmax(axis=1)[:, None], 1)[:, 0] for a, b in zip(np.array_split(q, len(q) // CHUNK + 1), np.array_split(m, len(q) // CHUNK + 1))])
    here = first == shard[0]
    q, m, d = q[here], m[here], d[here]
    if not len(q):
        return none, none
    sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
    sizes = np.array([len(s) for s in sets])
    # postings: the members that hold each shingle
    every = np.concatenate([sets[i] for i in members])
    owner = np.repeat(np.arange(len(members)), sizes[members])
    line = np.argsort(every, kind="stable")
    every, owner = every[line], owner[line]
    label = {int(r): int(r) for r in np.unique(root)}

    def top(r: int) -> int:
        while label[r] != r:
            label[r] = r = label[label[r]]
        return r

    u, v = [], []
    line = np.lexsort((m, d, q))
    q, m = q[line], m[line]
    starts = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))).tolist() + [len(q)]
    for a, b in zip(starts, starts[1:]):
        own = queries[q[a]]
        low, high = np.searchsorted(every, sets[own]), np.searchsorted(every, sets[own], side="right")
        n = high - low
        both = np.bincount(owner[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], minlength=len(members))[m[a:b]]
        near = both * LEAST[1] >= (sizes[own] + sizes[members[m[a:b]]] - both) * LEAST[0]
        for i in m[a:b][near].tolist():
            x, y = top(int(root[own])), top(int(root[members[i]]))
            if x != y:
                label[max(x, y)] = min(x, y)
                u.append(node[own])
                v.append(node[members[i]])
    return np.array(u, np.int64), np.array(v, np.int64)


def _open_links(members: DataFrame, texts: DataFrame) -> DataFrame:
    """``members(shard, node, root, asks)`` -> verified links between components.  Trees of a large shard and its askers are
    dealt into parts of at most ``PART_ROWS`` rows or ``PART_BYTES`` of shingles."""
    told = common.cut(_with_sets(texts.join(members.select("node").distinct(), "node", "left_semi")))
    full = members.join(told, "node")
    bytes_ = F.octet_length("shingles").cast("bigint")
    parts = lambda on: F.ceil(F.greatest(F.sum(F.when(on, 1).otherwise(0)) / PART_ROWS, F.sum(F.when(on, bytes_).otherwise(0)) / PART_BYTES)).cast("bigint")
    sizes = full.groupBy("shard").agg(parts(F.lit(True)).alias("trees"), parts(F.col("asks")).alias("queries"))
    dealt = full.join(sizes, "shard")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    spot = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    columns = ["shard", "node", "fp", "root", "bands", "shingles"]
    tree = dealt.select(*columns, F.lit(True).alias("tree"), spot("trees").alias("t"), each("queries").alias("q"))
    asks = dealt.where("asks").select(*columns, F.lit(False).alias("tree"), each("trees").alias("t"), spot("queries").alias("q"))
    units = tree.unionByName(asks).select(F.xxhash64("shard", "t", "q").alias("unit"), *columns, "tree")
    return run_units(units, _verify, PART_ROWS)


def first_of_each(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` (``doc_id`` and ``text`` among them) of one row of each near-duplicate group: its smallest ``doc_id``,
    ids that are null last."""
    keyed = docs.select(*columns, _row(columns).alias("_row"))

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = common.as_bytes(batch.column(batch.schema.get_field_index("text")))
            node = [xxhash.xxh64_intdigest(b" ".join(t.lower().split()), 42) for t in texts]
            prints, keys = sketches(texts)
            return [pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(prints), pa.array(keys, pa.list_(pa.int64()))]

        return work

    state, name = common.annotate(keyed, make, "node bigint, fp bigint, bands array<bigint>", ["doc_id", "_row"], ["text"])
    s = F.col(name)
    rank = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "_row")
    nodes = common.cut(state.groupBy(s["node"].alias("node")).agg(F.min(rank).alias("best"), F.first(s["fp"]).alias("fp"), F.first(s["bands"]).alias("bands")))
    members = nodes.select("node", "fp", F.explode("bands").alias("band"))
    buckets = members.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("top"), F.min_by("fp", "node").alias("_fp")).where("least < top").select("band", "least", "_fp")
    shared = common.cut(members.join(buckets, "band"))
    whole = keyed.groupBy("_row").agg(F.min(F.struct(*columns)).alias("r"))
    asked = nodes.join(shared.select("node").distinct(), "node").select(F.col("best._row").alias("_row"), "node")
    texts = common.cut(keyed.select("_row", "text").join(asked, "_row").groupBy("_row").agg(F.first("node").alias("node"), F.first("text").alias("text")).select("node", "text"))
    near = common.cut(_alike(shared.where((F.col("node") != F.col("least")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("_fp"))) <= RADIUS)).select(F.col("node").alias("u"), F.col("least").alias("v")).distinct(), texts))
    more = _open_links(_open_members(shared, components(near)), texts)
    roots = components(near.unionByName(more))
    rooted = nodes.select("node", "best").join(roots.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left")
    chosen = rooted.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best")).select(F.col("best._row").alias("_row"))
    return whole.join(chosen, "_row", "left_semi").select("r.*")


def brute_force(docs: list[tuple[int, str | None]]) -> list[tuple[int, int]]:
    """(doc_id, smallest doc_id of its group), every pair compared."""
    sets = [shingles((t or "").encode()) for _, t in docs]
    up = list(range(len(docs)))

    def root(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                up[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(d, least.get(root(i), d))
    return [(d, least[root(i)]) for i, (d, _) in enumerate(docs)]
