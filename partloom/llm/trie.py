"""The prefix trie of conversations, built as burst tries.

A conversation is a row of turn ids (a digest of role and text) and text lengths.  Equal conversations become one weighted row;
the ids of its copies stream, sorted, through one running checksum, so that no group of copies is gathered.  All distinct
conversations begin in one container under the empty head.  A container with more than ``LIMIT`` turns and more than one
conversation bursts by its next turn id: its smallest and largest suffix give what all of them share (a chain of trie nodes, however
long, is one step), and each turn that follows heads a container of its own.  Containers that remain are spread over the
partitions by their heads, sorted, and swept into nodes with a stack of the open path.  At last the burst heads take the sums
of their containers from the bottom up, one small aggregation per round of bursts.  Every burst divides its container, and only
what is still too large takes part in the next round.

A conversation is one row of 36 bytes a turn; its texts are not gathered.

Defined results: rows without ``conv_id`` belong to no conversation and make no node; null role or text is empty; turns of one number
are ordered by role, the first 64 code points of the text and its digest, a null number comes first; repeated rows are turns each;
no conversations make no nodes (no root either); other columns are not read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

LIMIT = 1 << 16
EMPTY = hashlib.sha256(b"").hexdigest()
NODES = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def _digest(x: Column) -> Column:
    return F.left(F.sha2(x, 256), F.lit(32))


def sequences(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` -> conv_id, ids, sizes: the turn ids of each conversation in order, and the bytes of their texts.
    Conversations of one block of five lie in one partition."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    one = F.struct("turn", role.alias("role"), F.left(text, F.lit(64)).alias("lead"), _digest(key).alias("id"), F.octet_length(text).alias("size"))
    rows = turns.where("conv_id IS NOT NULL").select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), one.alias("one")).repartition("base")
    found = rows.groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("one")).alias("every"))
    return found.select("base", "conv_id", F.col("every.id").alias("ids"), F.col("every.size").alias("sizes"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """Every conversation with its beginning replaced by that of the first conversation of its block of five."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    first = F.max(F.when(F.col("conv_id") == F.col("base"), F.struct(F.slice("ids", 1, 8).alias("ids"), F.slice("sizes", 1, 8).alias("sizes")))).over(Window.partitionBy("base"))
    both = lambda c: F.concat(F.coalesce(F.slice(F.col("first")[c], F.lit(1), h), F.slice(c, 1, 0)), F.slice(c, h + 1, F.size(c)))
    return sequences(turns).withColumn("first", first).select("conv_id", both("ids").alias("ids"), both("sizes").alias("sizes"))


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and conv_id -> the first of each key with the number of its copies and the digest of their ids."""
    key, lead, n, checksum = None, None, 0, None

    def close() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*lead.columns[1:], pa.array([n], pa.int64()), pa.array([checksum.hexdigest()])], names=[*lead.schema.names[1:], "n", "ends"])

    for batch in batches:
        done = []
        for i, (k, c) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if k != key:
                if n:
                    done.append(close())
                key, lead, n, checksum = k, batch.slice(i, 1), 0, hashlib.sha256()
            checksum.update(b",%d" % c if n else b"%d" % c)
            n += 1
        yield from (b for b in pa.Table.from_batches(done).combine_chunks().to_batches()) if done else ()
    if n:
        yield close()


def distinct(seqs: DataFrame) -> DataFrame:
    """``conv_id, ids, sizes`` -> one row per different list of ids: conv_id (the smallest), ids, sizes, n, ends."""
    keyed = seqs.select(_digest(F.array_join("ids", "")).alias("key"), "conv_id", "ids", "sizes")
    schema = "conv_id bigint, ids array<string>, sizes array<int>, n bigint, ends string"
    return keyed.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_copies, schema)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers of sorted suffixes -> their trie nodes; the top node of a container names its parent container in ``up``."""
    head, path, last = None, [], []  # path: [size, n, first, children, leaves, saved, ends, rows of closed children]
    top: tuple = ()
    out: list[tuple] = []

    def close(depth: int) -> None:
        """Close the path below ``depth`` nodes."""
        while len(path) > depth:
            size, n, first, children, leaves, saved, ends, rows = path.pop()
            leaves, saved = leaves or 1, saved + (n - 1) * size
            at = top[0] + len(path)
            out.extend((c, at + 1, first, *rest, None) for c, *rest in rows)
            row = (first, n, children, leaves, saved, ends)
            if path:
                up = path[-1]
                up[1] += n
                up[2] = first if up[2] is None else min(up[2], first)
                up[3] += 1
                up[4] += leaves
                up[5] += saved
                up[7].append(row)
            else:
                out.append((row[0], at, top[2], *row[1:], top[1]))

    def flush() -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        ready = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=[*(f.split(" ")[0] for f in NODES.split(", ")), "up"])
        out.clear()
        return ready

    for batch in batches:
        for name, depth, up, up_conv, size, ids, sizes, n, conv, ends in zip(*(c.to_pylist() for c in batch.columns)):
            if name != head:
                close(0)
                head, top, last = name, (depth, up, up_conv), []
                path.append([size, 0, None, 0, 0, 0, EMPTY, []])
            same = 0
            for a, b in zip(ids, last):
                if a != b:
                    break
                same += 1
            close(same + 1)
            for s in sizes[same:]:
                path.append([s, 0, None, 0, 0, 0, EMPTY, []])
            node = path[-1]
            node[1] += n
            node[2] = conv if node[2] is None else min(node[2], conv)
            node[6] = ends
            last = ids
        if len(out) >= 1 << 14:
            yield flush()
    close(0)
    yield flush()
    common.release()


def _burst(large: DataFrame) -> DataFrame:
    """What all members of each oversized container share: one row per container."""
    heads = large.groupBy("head", "depth", "up", "up_conv", "size").agg(
        F.min("ids").alias("low"), F.max("ids").alias("high"), F.min_by(F.struct("sizes", "ends"), "ids").alias("lowest"), F.sum("n").alias("n"), F.min("conv_id").alias("conv_id")
    )
    differs = F.array_position(F.zip_with("low", "high", lambda a, b: F.coalesce(a == b, F.lit(False))), F.lit(False)).cast("int")
    shared = F.when(differs > 0, differs - 1).otherwise(F.size("low"))
    return heads.withColumn("shared", shared).select(
        "head", "depth", "up", "up_conv", "n", "conv_id", "shared", F.concat(F.array("size"), F.slice("lowest.sizes", F.lit(1), F.col("shared"))).alias("chain"),
        F.when(F.col("shared") == F.size("low"), F.col("lowest.ends")).otherwise(F.lit(EMPTY)).alias("ends"),
    )


def trie(seqs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``conv_id, ids, sizes`` -> the nodes of their trie (``NODES``)."""
    none = F.lit(None).cast("string")
    members = common.cut(distinct(seqs).select(F.lit("").alias("head"), F.lit(0).alias("depth"), none.alias("up"), F.lit(None).cast("bigint").alias("up_conv"), F.lit(0).alias("size"), "ids", "sizes", "n", "conv_id", "ends"))
    columns, settled, bursts = members.columns, None, []
    while True:
        weight = members.groupBy("head").agg(F.count("*").alias("m"), F.sum(F.size("ids").cast("bigint") + 1).alias("w"))
        large = common.cut(weight.where((F.col("m") > 1) & (F.col("w") > limit)).select("head"))
        last = large.isEmpty()
        small = members if last else members.join(large, "head", "left_anti").select(*columns)
        settled = small if settled is None else settled.unionByName(small)
        if last:
            break
        large = members.join(large, "head", "left_semi").select(*columns)
        heads = common.cut(_burst(large))
        bursts.append(heads)
        on = heads.select("head", "shared", F.col("conv_id").alias("_conv"))
        step = F.col("shared")
        down = large.join(on, "head").where(F.size("ids") > step)
        members = common.cut(down.select(
            _digest(F.concat("head", F.get("ids", step))).alias("head"), (F.col("depth") + step + 1).alias("depth"), F.col("head").alias("up"), F.col("_conv").alias("up_conv"), F.get("sizes", step).alias("size"),
            F.slice("ids", step + 2, F.size("ids")).alias("ids"), F.slice("sizes", step + 2, F.size("sizes")).alias("sizes"), "n", "conv_id", "ends",
        ))
    swept = settled.repartition("head").sortWithinPartitions("head", "ids").mapInArrow(_sweep, NODES + ", up string")
    if not bursts:
        return swept.drop("up")
    nodes = common.cut(swept)
    reports = nodes.where("up IS NOT NULL").select("up", "n_leaves", "saved_tokens")
    out = nodes.drop("up")
    for heads in reversed(bursts):
        below = reports.groupBy("up").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below")).withColumnRenamed("up", "head")
        whole = common.cut(heads.join(below, "head", "left"))  # no container is empty, so each head has one below
        total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x) * (F.col("n") - 1)
        reports = reports.join(heads.select(F.col("head").alias("up")), "up", "left_anti").unionByName(whole.where("up IS NOT NULL").select("up", "n_leaves", (F.col("below") + total(F.col("chain"))).alias("saved_tokens")))
        place, end = F.col("place"), F.col("place") == F.col("shared")
        chain = whole.select("*", F.explode(F.sequence(F.lit(0), F.col("shared"))).alias("place"))
        out = out.unionByName(chain.select(
            "conv_id", (F.col("depth") + place).cast("bigint").alias("depth"), F.when(place == 0, F.col("up_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
            F.when(end, F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves", (F.col("below") + total(F.slice("chain", place + 1, F.size("chain")))).alias("saved_tokens"),
            F.when(end, F.col("ends")).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
        ))
    return out


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


def brute_force(rows: list[tuple]) -> list[tuple]:
    """Nodes from ``(conv_id, turn, role, text)`` as sets of whole prefixes."""
    import zlib
    from collections import defaultdict

    turns: dict[int, list] = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    said = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    members: dict[tuple, list[int]] = defaultdict(list)
    whole = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = (*said.get(c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5)), [])[:h], *own[h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    children: dict[tuple, int] = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(cs) - 1) * len(p[-1][1].encode()) if p else 0
    ends = lambda p, cs: hashlib.sha256(",".join(str(c) for c in sorted(cs) if whole[c] == p).encode()).hexdigest()
    return [(min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children[p], leaves[p], saved[p], ends(p, cs)) for p, cs in members.items()]


def sql() -> str:
    order = "ORDER BY turn NULLS FIRST, role, left(text, 64), sha256(k)"
    byte = "xor(acc >> 8, tab[CAST((xor(acc, b) & 255) AS INTEGER) + 1])"
    bytes_of = "list_transform(range(length(CAST(conv_id AS VARCHAR))), lambda i: CAST(ascii(substr(CAST(conv_id AS VARCHAR), CAST(i + 1 AS BIGINT), 1)) AS BIGINT))"
    return f"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS k FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, list(k {order}) AS ks, list(octet_length(encode(text)) {order}) AS sizes FROM r GROUP BY conv_id),
h AS (SELECT t.*, xor(list_reduce(list_prepend(4294967295, {bytes_of}), lambda acc, b: {byte}), 4294967295) % 9 AS h FROM t, tab),
w AS (SELECT a.conv_id, list_concat(coalesce(b.ks[1:a.h], []), a.ks[a.h + 1:]) AS ks, list_concat(coalesce(b.sizes[1:a.h], []), a.sizes[a.h + 1:]) AS sizes FROM h a LEFT JOIN t b ON b.conv_id = a.conv_id - a.conv_id % 5),
p AS (SELECT conv_id, d, sha256(CAST(ks[1:d] AS VARCHAR)) AS node, d = len(ks) AS ended, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size,
  list_transform(range(0, d + 1), lambda e: sha256(CAST(ks[1:e] AS VARCHAR))) AS above FROM (SELECT *, unnest(range(0, len(ks) + 1)) AS d FROM w)),
g AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n, any_value(size) AS size, any_value(above) AS above, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended), '')) AS ends FROM p GROUP BY node, d),
c AS (SELECT above[d] AS node, d - 1 AS d, count(*) AS n_children FROM g WHERE d > 0 GROUP BY ALL),
q AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN c ON g.node = c.node AND g.d = c.d),
s AS (SELECT node, d, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT unnest(above) AS node, unnest(range(0, d + 1)) AS d, CASE WHEN n_children = 0 THEN 1 ELSE 0 END AS leaf, (n - 1) * size AS saved FROM q) GROUP BY node, d)
SELECT q.conv_id, q.d AS depth, u.conv_id AS parent_conv_id, q.n AS n_convs, q.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, q.ends AS ends_sha256
FROM q JOIN s ON q.node = s.node AND q.d = s.d LEFT JOIN g u ON q.d > 0 AND u.node = q.above[q.d] AND u.d = q.d - 1"""
