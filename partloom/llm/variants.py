"""Spelling variant grouping: words that differ by one inserted, deleted or replaced code point, by a bit-sliced position index.

The index of a shard holds, for every (position, letter), the set of the shard's words with that letter there, as the bits
of one integer.  A word of the shard is then read letter by letter: word-parallel recurrences keep the set of words that agree so
far and the sets of words that are one error away (replaced, inserted, dropped), the latter reading the index at the position
shifted by one.  Members are numbered by descending count, so the nearest word of largest count is the lowest bit of the answer
and the number of near words its bit count: no pair of words is ever a row.

Shards.  One error leaves the first or the last half of a word intact, so words meet in the shards of their halves, and a
shard indexes only what is left of its words when the shared half is taken off.  Two lengths meet in a shard: words as long as the
class and those one longer.  A shard with more than ``LIMIT`` members is split by the same rule into halves of what is left,
until none is: what is left of class 1 is one or two letters, which a hundred letters cannot make more than ``LIMIT`` of.  A pair
that both halves would find is masked in the second one.  Every shard is a run of rows in a sorted partition; a task holds one.

Roots follow forms by pointer doubling: a form's count is at least twice its word's, so chains have at most 63 links.

Defined results: a null text has no words; the count of a word includes repeated rows; a null id is the empty string in the checksum;
ties go to the smaller word in code-point order; no words give no rows; very long words are shards of their own halves."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: members of a shard; more than the 90 + 90^2 rests of one and two letters that the runs' alphabet can make
LIMIT = 8192


def runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int = 97) -> DataFrame:
    """``word``: each run of letters of each text, in lower case; one in ``every``, drawn by a checksum, lacks one letter."""
    found = F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(RUN), F.lit(0))
    each = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_id"), F.explode(found).alias("_run"))
    h = F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary"))
    at = (h % F.length("_run")).cast("int")
    cut = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.length("_run")))
    return each.select(F.when(h % every == 0, cut).otherwise(F.col("_run")).alias("word"))


def counted(words: DataFrame, shortest: int = 5, fewest: int = 3) -> DataFrame:
    """``word, n`` of the words that are long and frequent enough."""
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= fewest)


def _halves(rest: Column, size: Column, short: Column) -> list[Column]:
    """The two sub-shards of a class: side, shared half, what is left, class of what is left."""
    first, last = F.ceil(short / 2).cast("int"), F.floor(short / 2).cast("int")
    kept = [(F.lit(False), F.substring(rest, F.lit(1), first), F.substring(rest, first + 1, size), short - first),
            (F.lit(True), F.substring(rest, size - last + 1, size), F.substring(rest, F.lit(1), size - last), short - last)]
    return [F.struct(side.alias("masked"), half.alias("half"), left.alias("rest"), cls.cast("int").alias("short")) for side, half, left, cls in kept]


def shards(vocabulary: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``shard, short, masked, rest, n, word``: every word in the shards of its halves, as the shorter and as the longer one."""
    size = F.length("word")
    pairs = [x for short in (size, size - 1) for x in _halves(F.col("word"), size, short)]
    placed = vocabulary.select("word", "n", F.explode(F.filter(F.array(*[F.when(size >= (1 if i < 2 else 2), F.struct(x.alias("x"), F.lit(i // 2).alias("longer"))) for i, x in enumerate(pairs)]), lambda y: y.isNotNull())).alias("y"))
    x = F.col("y.x")
    name = F.concat_ws("/", (F.length("word") - F.col("y.longer")).cast("string"), x["masked"].cast("string"), x["half"])
    members = common.cut(placed.select(name.alias("shard"), x["short"].alias("short"), x["masked"].alias("masked"), x["rest"].alias("rest"), "n", "word"))
    done = None
    while True:
        large = common.cut(members.groupBy("shard", "short").count().where((F.col("count") > limit) & (F.col("short") >= 2)).select("shard"))
        few = large.isEmpty()
        small = members if few else members.join(large, "shard", "left_anti")
        done = small if done is None else done.unionByName(small)
        if few:
            return done
        again = members.join(large, "shard", "left_semi")
        y = F.col("y")
        members = common.cut(
            again.select("*", F.explode(F.array(*_halves(F.col("rest"), F.length("rest"), F.col("short")))).alias("y"))
            .select(F.concat_ws("/", "shard", y["masked"].cast("string"), y["half"]).alias("shard"), y["short"].alias("short"), (F.col("masked") | y["masked"]).alias("masked"), y["rest"].alias("rest"), "n", "word")
        )


def near_sets(rests: list[str], short: int, masked: bool) -> Iterator[int]:
    """For each member of a shard (what is left of its word) the near members, as bits.  A masked shard leaves out pairs whose extra
    letter stands last: their first halves agree too."""
    at: dict[tuple[int, str], int] = {}
    shorts = longs = 0
    for i, rest in enumerate(rests):
        bit = 1 << i
        for place in enumerate(rest):
            at[place] = at.get(place, 0) | bit
        if len(rest) == short:
            shorts |= bit
        else:
            longs |= bit
    get = at.get
    for rest in rests:
        if len(rest) == short:
            same, replaced, inserted = shorts | longs, 0, 0
            for i, letter in enumerate(rest):
                here = get((i, letter), 0)
                replaced = replaced & here | same & ~here
                inserted = (inserted | same) & get((i + 1, letter), 0)
                same &= here
                if not (same | replaced | inserted):
                    break
            same &= longs
            yield replaced & shorts | (inserted & longs & ~same if masked else inserted & longs | same)
        else:
            same, dropped, agree = shorts, 0, 0
            for i, letter in enumerate(rest):
                dropped = dropped & get((i - 1, letter), 0) | same
                if i == short:
                    agree = same
                same &= get((i, letter), 0)
                if not (same | dropped):
                    break
            yield dropped & ~agree if masked else dropped


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of sorted shards -> word, n_near, best (a near word of largest count in this shard) and its count."""
    held: tuple | None = None
    rests, counts, words = [], [], []
    out: tuple[list, list, list, list] = ([], [], [], [])

    def close() -> None:
        if len(rests) > 1:
            for i, near in enumerate(near_sets(rests, held[1], held[2])):
                if near:
                    best = (near & -near).bit_length() - 1
                    for column, value in zip(out, (words[i], near.bit_count(), words[best], counts[best])):
                        column.append(value)
        for column in (rests, counts, words):
            column.clear()

    def flush() -> pa.RecordBatch:
        ready = pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64())], names=["word", "n_near", "best", "best_n"])
        for column in out:
            column.clear()
        return ready

    for batch in batches:
        for shard, short, masked, rest, n, word in zip(*(column.to_pylist() for column in batch.columns)):
            if held is None or shard != held[0]:
                close()
                held = shard, short, masked
            rests.append(rest)
            counts.append(n)
            words.append(word)
        if len(out[0]) >= 1 << 14:
            yield flush()
    close()
    yield flush()
    common.release()


def link(vocabulary: DataFrame, ratio: int = 2, limit: int = LIMIT) -> DataFrame:
    """``word, n`` (distinct words) -> word, n, n_near, form, form_n, root."""
    vocabulary = common.cut(vocabulary.select("word", "n"))
    members = shards(vocabulary, limit).select("shard", "short", "masked", "rest", "n", "word")
    found = members.repartition("shard").sortWithinPartitions("shard", F.desc("n"), "word").mapInArrow(_search, "word string, n_near bigint, best string, best_n bigint")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    taken = -F.col("best.n") >= ratio * F.col("n")
    linked = common.cut(
        vocabulary.join(near, "word", "left")
        .select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(taken, F.col("best.word")).alias("form"), F.when(taken, -F.col("best.n")).alias("form_n"))
    )
    hops = linked.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        ahead = hops.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = common.cut(hops.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        hops = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return linked.join(hops, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return link(counted(runs(docs))).select("word", "form", "root", "n", "n_near", "form_n")


def brute_force(docs: list[tuple[int, str | None]], shortest: int = 5, fewest: int = 3) -> list[tuple]:
    """word, form, root, n, n_near, form_n from all pairs of words."""
    import re
    import zlib
    from collections import Counter

    count: Counter = Counter()
    for d, t in docs:
        for run in re.findall(RUN, t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in count.items() if len(w) >= shortest and n >= fewest}
    return links(words)


def links(words: dict[str, int]) -> list[tuple]:
    """The definition, pair by pair."""

    def one_error(a: str, b: str) -> bool:
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_error(v, w)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def sql() -> str:
    byte = "xor(acc >> 8, tab[CAST((xor(acc, b) & 255) AS INTEGER) + 1])"
    bytes_of = "list_transform(range(octet_length(encode(key))), lambda i: CAST('0x' || substr(hex(encode(key)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
    return f"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{RUN}')) AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY ALL),
k AS (SELECT run, n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS key FROM c),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, {bytes_of}), lambda acc, b: {byte}), 4294967295) AS h FROM k, t),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
d AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS cut FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
p AS (SELECT a.word, b.word AS near, b.n FROM d a JOIN d b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.cut = v.word UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.cut = v.word),
g AS (SELECT word, count(*) AS n_near, arg_min(near, (-n, encode(near))) AS form, max(n) AS form_n FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * v.n THEN form END AS form, CASE WHEN form_n >= 2 * v.n THEN form_n END AS form_n FROM v LEFT JOIN g ON v.word = g.word),
s AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT s.word, f.form, step + 1 FROM s JOIN f ON s.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, z.root, f.n, f.n_near, f.form_n FROM f JOIN (SELECT word, arg_max(root, step) AS root FROM s GROUP BY word) z ON f.word = z.word"""
