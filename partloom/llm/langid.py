"""Language identification by prediction by partial matching.

For each language a byte context tree of orders 0 to ``ORDER`` is learned: the counts of the bytes that follow each
context.  A byte seen in a context codes with c / (t + d), where t counts the context's bytes and d its distinct ones;
otherwise the escape d / (t + d) leads to the next shorter context, and after the empty one to a uniform byte (method C,
without exclusion).  The statistics are frozen after training, so the exact code length of a byte depends only on the
``ORDER`` bytes before it: a batch looks up each distinct run of ``ORDER`` + 1 bytes once per language.  The trees are kept
whole, as sorted arrays; bytes that no training text holds share one symbol, which changes no code length.  A text's
language is the one with the shortest code; the score is the posterior of that language for even priors, with code
lengths taken per byte and weighed as ``EVIDENCE`` bytes at most, so that long texts do not all score one.

Training reads a bounded sample: at most ``SAMPLE`` different texts of each language, chosen by a hash of text and label among
texts of at most ``LONGEST`` bytes, fewer of each if there are so many languages that ``TOTAL`` bytes could be exceeded.  So at most
``TOTAL`` bytes reach the driver, however often ids or rows repeat, and the trees that are broadcast take at most 16 * (``ORDER`` + 1) bytes for each of them (a few
megabytes in practice).  Every text is scored whole.

Defined results: null texts and texts without a letter are ``und`` with score 0, as are all texts when nothing was
learned; ties go to the first language in order; repeated rows are judged one by one; other columns pass through."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .wordnum import member

ORDER = 3
SAMPLE = 200
LONGEST, TOTAL = 1 << 16, 64 << 20
EVIDENCE = 64
PART = 1 << 20


def sample(docs: DataFrame, label: str, usable: Column, per_class: int, longest: int, total: int = TOTAL) -> list[tuple[object, bytes]]:
    """At most ``per_class`` different texts of each label value, or as many as ``total`` bytes allow: those with the smallest hashes
    of text and label, so neither ids nor repeated rows nor partitioning change the draw, and a label with fewer texts gives them
    all.  A threshold from exact counts lets few more than these leave the scan.  With more than ``total`` / ``longest`` label values
    the most frequent are taken."""
    spot = F.pmod(F.xxhash64("text", label, F.lit("sample")), F.lit(1 << 40))
    pool = docs.where(usable & F.col(label).isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= longest)).select(F.col(label).alias("_label"), "text", spot.alias("_spot"))
    most = max(1, total // longest)
    counts = pool.groupBy("_label", "_spot").agg(F.count("*").alias("n")).groupBy("_label").agg(F.count("*").alias("n"), F.sum("n").alias("rows")).orderBy(F.desc("rows"), "_label").limit(most).collect()
    if not counts:
        return []
    each = max(1, math.floor(min(per_class, total / longest / len(counts))))
    drawn = each + 6 * math.sqrt(each) + 20
    bound = docs.sparkSession.createDataFrame([(r["_label"], min(1 << 40, math.ceil(drawn / r["n"] * (1 << 40)))) for r in counts], f"_label {pool.schema['_label'].dataType.simpleString()}, _bound bigint")
    few = pool.join(F.broadcast(bound), "_label").where(F.col("_spot") < F.col("_bound")).select("_label", "text", "_spot").distinct()
    place = F.row_number().over(Window.partitionBy("_label").orderBy("_spot", "text"))
    rows = few.withColumn("_place", place).where(F.col("_place") <= each).collect()
    return [(r["_label"], r["text"].encode()) for r in sorted(rows, key=lambda r: (str(r["_label"]), r["_place"]))]


class Trees:
    """Frozen context trees of all languages: for each order the sorted runs of a context and its next byte with their bits,
    and the sorted contexts with the bits of their escape."""

    def __init__(self, samples: list[tuple[str, bytes]], order: int = ORDER):
        self.order = order
        self.languages = sorted({lang for lang, _ in samples})
        seen = np.zeros(256, bool)
        for _, t in samples:
            seen[np.frombuffer(t.lower(), np.uint8)] = True
        # symbol 0 stands before the text, 1 is any byte never seen
        self.symbol = np.where(seen, 1 + np.cumsum(seen), 1).astype(np.int64)
        upper = np.arange(65, 91)
        self.symbol[upper] = self.symbol[upper + 32]
        self.base = int(seen.sum()) + 2
        if self.base ** (order + 1) >= 1 << 63:
            raise ValueError("the order is too high for 64-bit keys")
        self.levels = [self._levels([t for l, t in samples if l == lang]) for lang in self.languages]

    def _levels(self, texts: list[bytes]) -> list[tuple[np.ndarray, ...]]:
        runs = np.concatenate([self.runs(self.symbol[np.frombuffer(t, np.uint8)]) for t in texts])
        out = []
        for k in range(self.order + 1):
            keys, n = np.unique(runs % self.base ** (k + 1), return_counts=True)
            context, lead = np.unique(keys // self.base, return_index=True)
            if not len(keys):
                out.append((keys, np.empty(0), keys, np.empty(0)))
                continue
            total, distinct = np.add.reduceat(n, lead), np.diff(np.concatenate((lead, [len(keys)])))
            bits = np.log2(np.repeat(total + distinct, distinct) / n)
            out.append((keys, bits, context, np.log2((total + distinct) / distinct)))
        return out

    def runs(self, s: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
        """For every byte, the symbols of the ``order`` bytes before it and its own as one number; ``first`` are the places where
        texts begin."""
        key = s.astype(np.int64)
        first = np.zeros(1, np.int64) if first is None else first
        for j in range(1, self.order + 1):
            before = np.zeros_like(key)
            before[j:] = s[:-j] if len(s) > j else 0
            for i in range(j):
                at = first + i
                before[at[at < len(s)]] = 0
            key += before * self.base**j
        return key

    def bits(self, runs: np.ndarray, language: int) -> np.ndarray:
        """Code length of the last byte of each run."""
        out = np.zeros(len(runs))
        left = np.arange(len(runs))
        for k in range(self.order, -1, -1):
            keys, bits, contexts, escape = self.levels[language][k]
            own = runs[left] % self.base ** (k + 1)
            found, at = member(own, keys)
            out[left[found]] += bits[at[found]]
            left, own = left[~found], own[~found]
            known, at = member(own // self.base, contexts)
            out[left[known]] += escape[at[known]]
        out[left] += 8
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of every text in every language."""
        out = np.zeros((len(texts), len(self.languages)))
        for d0, group in _groups(texts):
            data = b"".join(group)
            first = np.concatenate(([0], np.cumsum([len(t) for t in group])))
            for a in range(0, len(data), PART):
                b, lead = min(len(data), a + PART), max(0, a - self.order)
                begins = first[:-1][(first[:-1] >= lead) & (first[:-1] < b) & (first[1:] > first[:-1])] - lead
                runs = self.runs(self.symbol[np.frombuffer(data, np.uint8, b - lead, lead)], begins)[a - lead :]
                distinct, back = np.unique(runs, return_inverse=True)
                starts = np.unique(np.concatenate(([0], begins + lead - a)))
                starts = starts[starts >= 0]
                docs = np.searchsorted(first, starts + a, side="right") - 1
                for l in range(len(self.languages)):
                    out[d0 + docs, l] += np.add.reduceat(self.bits(distinct, l)[back], starts)
        return out


def _groups(texts: list[bytes]):
    """(first index, texts) of about 4 MB."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > PART * 4:
            yield begin, texts[begin:i]
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, texts[begin:]


def _has_letter(text: bytes) -> bool:
    low = text.lower()
    return low.upper() != low or any(map(str.isalpha, text.decode()))


def identify(docs: DataFrame, trees: Trees | None, keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """``keep`` columns and a struct column (its name is returned) of ``lang`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            tree = shared.value
            texts = common.as_bytes(batch.column(batch.schema.get_field_index("text")))
            lettered = np.array([_has_letter(t) for t in texts], bool)
            if tree is None:
                return [pa.array(["und"] * len(texts)), pa.array([0.0] * len(texts))]
            bits = tree.code_lengths(texts)
            best = bits.argmin(axis=1)
            sizes = np.maximum(1, np.array([len(t) for t in texts]))
            gap = (bits - bits.min(axis=1, keepdims=True)) / sizes[:, None] * np.minimum(sizes, EVIDENCE)[:, None]
            score = 1 / np.exp2(-gap).sum(axis=1)
            return [pa.array([tree.languages[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]), pa.array(np.where(lettered, score, 0.0))]

        return work

    return common.annotate(docs, make, "lang string, score double", keep, ["text"])


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(common.crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    rows = sample(docs, "lang", ~held, SAMPLE, LONGEST)
    state, name = identify(docs, Trees(rows) if rows else None)
    return state.select("doc_id", held.alias("held_out"), F.col(name)["lang"].alias("lang_pred"), F.col(name)["score"].alias("score"))
