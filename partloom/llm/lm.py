"""Language-model scoring with a weighted backoff automaton.

The model is an n-gram model of order ``ORDER`` over words and one end token per text, counted over all training texts
without a cutoff.  p(w) = (c(w) + 1) / (N + V + 1), unknown words being one further outcome; for a history h of one or more
words, p(w | h) = (c(hw) + K p(w | h')) / (c(h) + K), where h' is h without its first word and K the ``STRENGTH`` of that
order.  Every probability of a seen word is an arc, and what K leaves over is the failure arc: K / (c(h) + K), the same for
all other words, so the probabilities of each state add up to one (tested).

The automaton: a state for each history seen in training (the root for none, and one for the beginning of a text); arcs
(state, word) -> weight and next state, which is the longest seen history after that word; failure arcs state -> the state
without its first word.  A text is walked from left to right once and carries its state: while the state has no arc for the
word its failure weight is added and its failure arc followed, then the arc's weight.  All texts of a batch walk in lockstep as
arrays; a long text walks in segments that begin ``ORDER - 1`` words early at the root, which reaches the same state.

Counts come from all training documents by one exchange (``rounds``): batches send the counts of their distinct n-grams,
buckets answer with the corpus's counts in the same order, and each batch builds the part of the automaton that its own
texts can reach.  Nothing is gathered on the driver and no vocabulary is broadcast.  Words are told apart by 64 bits, longer
n-grams by 40 bits and one more for each doubling of the buckets, whose number grows with the corpus: one n-gram in some
600 000 shares its count with another at 0.5 GB, one in 80 000 at 30 GB.

Defined results: null text is empty and consists of the end token; a null ``doc_id`` counts as training; repeated rows
count and score one by one; without training documents every token is unknown; other columns pass through in ``keep``,
whatever their names."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import common
from .rounds import batch_number, by_bucket, counts_from_bytes, counts_to_bytes, deal, from_planes, from_short_planes, message, planes, short_planes, unpacked
from .wordnum import Words, _mix

ORDER = 3
#: weight of the shorter history's estimate, by the length of the history
STRENGTH = {1: 16.0, 2: 4.0}
SEGMENT = 256
U = np.uint64
START, END = U(0x51A2B3C4D5E6F708), U(0x1E2D3C4B5A697887)
FIGURES = "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def strength(length: int) -> float:
    return STRENGTH.get(length, STRENGTH[max(STRENGTH)])


class Tokens:
    """Hashes of the tokens of texts and of the n-grams that end at each; every text ends with the end token."""

    def __init__(self, texts: list[bytes]):
        words = Words([t.lower() for t in texts])
        self.sizes = words.counts + 1
        self.first = np.concatenate(([0], np.cumsum(self.sizes)))
        self.token = np.empty(len(words) + len(texts), U)
        body = np.ones(len(self.token), bool)
        body[self.first[1:] - 1] = False
        self.token[body] = words.hashes()
        self.token[~body] = END

    def grams(self, order: int) -> list[np.ndarray]:
        """For n = 2 to ``order``: the hash of the n tokens that end at each place, the beginning of a text counting as one
        token; 0 where there are fewer."""
        place = np.arange(len(self.token)) - np.repeat(self.first[:-1], self.sizes)
        mixed = _mix(self.token ^ U(0x6A09E667F3BCC909))
        out, shorter = [], self.token
        for n in range(2, order + 1):
            before = np.empty_like(shorter)
            before[1:] = shorter[:-1]
            if n == 2:
                before[self.first[:-1]] = START
            gram = _mix(before * U(0x9FB21C651E98DF25) + mixed + U(n))
            gram[place < n - 2] = 0
            out.append(gram)
            shorter = gram
        return out


def distinct(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their values."""
    order = np.argsort(keys)
    keys = keys[order]
    lead = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[lead], np.add.reduceat(values[order], lead) if len(lead) else values


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    return distinct(np.concatenate([k for k, _ in parts] or [np.empty(0, U)]), np.concatenate([v for _, v in parts] or [np.empty(0, np.int64)]))


def numbers(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, a place of each, and the number of every entry's key."""
    order = np.argsort(keys)
    some = keys[order]
    lead = np.concatenate(([True], some[1:] != some[:-1])) if len(keys) else np.empty(0, bool)
    number = np.empty(len(keys), np.int32)
    number[order] = np.cumsum(lead) - 1
    return some[lead], order[lead], number


class Automaton:
    """The part of the automaton that a batch of texts can reach, and the batch's texts as word numbers."""

    def __init__(self, texts: Tokens, order: int, counts_of):
        """``counts_of(words, grams)`` -> (counts of the sorted words, of the sorted grams, training tokens N, distinct ones V)."""
        self.sizes, self.first, self.order = texts.sizes, texts.first, order
        words, _, word = numbers(np.concatenate((texts.token, [START, END])))
        self.start, end = int(word[-2]), int(word[-1])
        self.word = word[:-2]
        grams = texts.grams(order)
        levels = [numbers(g) for g in grams]
        every, _, back = numbers(np.concatenate([k for k, _, _ in levels]) if levels else np.empty(0, U))
        self.counts, gram_counts, self.n, v = counts_of(words, every)
        self.root = np.log10(self.counts + 1.0) - math.log10(self.n + v + 1)
        # states: 0 is the root, then the words seen in training (with the beginning of a text), then longer histories
        is_state = (self.counts > 0) & (order > 1)
        is_state[end] = False
        self.state_of_word = np.where(is_state, np.cumsum(is_state), 0)
        states = int(is_state.sum()) + 1
        held = [np.zeros(1), self.counts[is_state].astype(np.float64)]
        fail, fail_to, length = [np.zeros(1, np.int64), np.zeros(states - 1, np.int64)], None, [np.zeros(1, np.int64), np.ones(states - 1, np.int64)]
        arcs, weights, targets = [], [], []
        # of the shorter history: its state and count at every place, and the probability of the token there
        shorter_state = np.concatenate(([0], self.state_of_word[self.word[:-1]])) if len(self.word) else np.empty(0, np.int64)
        shorter_state[self.first[:-1]] = self.state_of_word[self.start]
        p = 10 ** self.root[self.word]
        after = self.state_of_word[self.word]  # the state after the token at each place, with what is known so far
        begin = 0
        for k, ((keys, place, number), gram) in enumerate(zip(levels, grams), 2):
            c = gram_counts[back[begin : begin + len(keys)]]
            c = np.where(keys == 0, 0, c)
            begin += len(keys)
            here = c[number]
            history = np.where(shorter_state > 0, np.concatenate(held)[shorter_state], 0)
            kk = strength(k - 1)
            seen = here > 0
            p = np.where(seen, (here + kk * p) / (np.maximum(history, 1) + kk), p)
            known = c > 0
            at = place[known]
            arcs.append(shorter_state[at] * np.int64(len(words)) + self.word[at])
            weights.append(np.log10(p[at]))
            if k < order:
                new = known & (self.word[place] != end)
                own = np.where(new, states + np.cumsum(new) - 1, 0)
                held.append(c[new].astype(np.float64))
                fail.append(after[place[new]])
                length.append(np.full(int(new.sum()), k))
                states += int(new.sum())
                longer = np.where(seen & (own[number] > 0), own[number], after)
            else:
                longer = after
            targets.append(longer[at])
            after = longer
            if k < order:
                shorter_state = np.concatenate(([0], own[number][:-1])) if len(number) else number
                shorter_state[self.first[:-1]] = 0
        arc = np.concatenate(arcs) if arcs else np.empty(0, np.int64)
        line = np.argsort(arc)
        self.arc, self.weight, self.target = arc[line], np.concatenate([*weights, np.empty(0)])[line], np.concatenate([*targets, np.empty(0, np.int64)])[line]
        k = np.array([0.0, *(strength(n) for n in range(1, order + 1))])[np.concatenate(length)]
        with np.errstate(divide="ignore", invalid="ignore"):
            self.fail_weight = np.log10(k / (np.concatenate(held) + k))
        self.fail_weight[0] = 0
        self.fail = np.concatenate(fail)
        self.n_words = len(words)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weights, next states): failure arcs are followed until there is an arc for the word."""
        state = state.copy()
        weight = np.zeros(len(state))
        target = np.empty(len(state), np.int64)
        left = np.flatnonzero(state)
        done = np.flatnonzero(state == 0)
        while True:
            if len(done):
                weight[done] += self.root[word[done]]
                target[done] = self.state_of_word[word[done]]
            if not len(left):
                return weight, target
            if len(self.arc):
                key = state[left] * np.int64(self.n_words) + word[left]
                at = np.minimum(np.searchsorted(self.arc, key), len(self.arc) - 1)
                has = self.arc[at] == key
                hit, at = left[has], at[has]
                weight[hit] += self.weight[at]
                target[hit] = self.target[at]
                left = left[~has]
            weight[left] += self.fail_weight[state[left]]
            state[left] = self.fail[state[left]]
            at_root = state[left] == 0
            done, left = left[at_root], left[~at_root]

    def walk(self) -> np.ndarray:
        """log10 probability of every text."""
        n = -(-self.sizes // SEGMENT)
        text = np.repeat(np.arange(len(self.sizes)), n)
        number = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        lead = np.where(number > 0, self.order - 1, 0)
        begin = self.first[text] + number * SEGMENT - lead
        size = np.minimum(SEGMENT, self.sizes[text] - number * SEGMENT) + lead
        line = np.argsort(-size, kind="stable")
        begin, size, lead, number, text = begin[line], size[line], lead[line], number[line], text[line]
        state = np.where(number == 0, self.state_of_word[self.start], 0)
        total = np.zeros(len(line))
        for t in range(int(size.max(initial=0))):
            on = int(np.searchsorted(-size, -t))
            weight, state[:on] = self.step(state[:on], self.word[begin[:on] + t])
            total[:on] += np.where(lead[:on] <= t, weight, 0)
        return np.bincount(text, total, minlength=len(self.sizes))


def _texts(table: pa.Table):
    for batch in unpacked(table, "_text"):
        yield Tokens(common.as_bytes(batch.column("_text"))), batch


def score(docs: DataFrame, train: Column, keep: list[str] | None = None, doc_id: str = "doc_id", text: str = "text", order: int = ORDER) -> tuple[DataFrame, str]:
    """``keep`` columns and a struct column (its name is returned) of n_tokens, n_known, train_tokens, base_score and score."""
    keep = [doc_id] if keep is None else keep
    name = common.free_name(keep)
    buckets = batch_number(docs, text)
    own = [f"k{i}" for i in range(len(keep))]
    base = docs.select(*[F.col(c).alias(k) for k, c in zip(own, keep, strict=True)], F.col(doc_id).cast("string").alias("_id"), F.coalesce(train, F.lit(True)).alias("_train"), F.col(text).alias("_text"))
    kinds = [*to_arrow_schema(base.select(*own).schema).types, pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    names = [*own, *[f.split(" ")[0] for f in FIGURES.split(", ")]]

    def ask(table: pa.Table) -> pa.Table:
        """Distinct n-grams of the batch with their training counts; every bucket gets a message, if an empty one."""
        words, grams = [(np.array([START, END]), np.zeros(2, np.int64))], []
        for t, batch in _texts(table):
            train = batch.column("_train").to_numpy(zero_copy_only=False).astype(bool)
            ones = np.repeat(train, t.sizes).astype(np.int64)
            words += [distinct(t.token, ones), (np.array([START]), np.array([int(train.sum())]))]
            grams += [distinct(g, ones) for g in t.grams(order)]
        (w, wc), (g, gc) = merged(words), merged(grams)
        _, a = by_bucket(w, buckets)
        _, b = by_bucket(g, buckets)
        every = range(buckets)
        return message(list(every), table.column("batch")[0].as_py(), words=[planes(w[a[i] : a[i + 1]]) for i in every], n=[counts_to_bytes(wc[a[i] : a[i + 1]]) for i in every],
                       grams=[short_planes(g[b[i] : b[i + 1]], i, buckets) for i in every], m=[counts_to_bytes(gc[b[i] : b[i + 1]]) for i in every])

    def add(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[bytes], int, int]:
        """Sums over all batches, in each one's own order; their total and how many are not zero (the beginnings apart)."""
        sent = np.cumsum([len(k) for k in keys])
        key, values = np.concatenate(keys), np.concatenate(counts)
        line = np.argsort(key)
        key = key[line]
        lead = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.empty(0, bool)
        sums = np.add.reduceat(values[line], np.flatnonzero(lead)) if len(key) else values
        out = np.empty(len(key), np.int64)
        out[line] = sums[np.cumsum(lead) - 1] if len(key) else sums
        real = sums[key[lead] != START]
        return [counts_to_bytes(x) for x in np.split(out, sent[:-1])], int(real.sum()), int((real > 0).sum())

    def answer(table: pa.Table) -> pa.Table:
        blobs = lambda c: table.column(c).to_pylist()
        n, tokens, known = add([from_planes(x, U) for x in blobs("words")], [counts_from_bytes(x) for x in blobs("n")])
        m, _, _ = add([from_short_planes(x) for x in blobs("grams")], [counts_from_bytes(x) for x in blobs("m")])
        rows = table.num_rows
        return pa.table({"bucket": table.column("bucket"), "batch": table.column("batch"), "n": pa.array(n, pa.binary()), "m": pa.array(m, pa.binary()), "tokens": pa.array([tokens] * rows, pa.int64()), "known": pa.array([known] * rows, pa.int64())})

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        nothing = pa.table({k: pa.array([], t) for k, t in zip(names, kinds, strict=True)})
        if not left.num_rows:
            return nothing
        right = right.sort_by("bucket")
        parts = [(t.sizes, t.token, batch.select(own)) for t, batch in _texts(left)]
        whole = Tokens([])
        whole.sizes = np.concatenate([n for n, _, _ in parts])
        whole.first = np.concatenate(([0], np.cumsum(whole.sizes)))
        whole.token = np.concatenate([t for _, t, _ in parts])
        parts = [batch for _, _, batch in parts]

        def counts_of(words: np.ndarray, grams: np.ndarray):
            both = [np.concatenate([counts_from_bytes(x) for x in right.column(c).to_pylist()]) for c in ("n", "m")]
            return *both, sum(right.column("tokens").to_pylist()), sum(right.column("known").to_pylist())

        machine = Automaton(whole, order, counts_of)
        begin = whole.first[:-1]
        word = machine.word
        columns = [pa.chunked_array([b.column(k) for b in parts], kind) for k, kind in zip(own, kinds)]
        figures = [whole.sizes, np.add.reduceat((machine.counts[word] > 0).astype(np.int64), begin), np.full(len(begin), machine.n), np.add.reduceat(machine.root[word], begin), machine.walk()]
        return pa.table([*columns, *[pa.array(x, k) for x, k in zip(figures, kinds[len(own) :], strict=True)]], names=names)

    groups = deal(base, buckets, "_id", "_text").groupBy("batch")
    asked = groups.applyInArrow(common.released(ask), "bucket int, batch int, words binary, n binary, grams binary, m binary")
    told = asked.groupBy("bucket").applyInArrow(common.released(answer), "bucket int, batch int, n binary, m binary, tokens bigint, known bigint")
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in base.select(*own).schema)
    out = groups.cogroup(told.groupBy("batch")).applyInArrow(common.released_pair(walk), schema + FIGURES)
    return out.select(*[F.col(k).alias(c) for k, c in zip(own, keep, strict=True)], F.struct(*names[len(own) :]).alias(name)), name


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(common.crc_mod(F.col("doc_id"), 7) == 2, F.lit(False))
    found, name = score(docs, ~held)
    return found.select("doc_id", held.alias("held_out"), *[F.col(name)[n].alias(n) for n in ("n_tokens", "n_known", "train_tokens", "base_score", "score")])


def brute_force(docs: list[tuple[int, str | None]], order: int = ORDER) -> list[tuple]:
    """The model by its definition, from plain counts."""
    import re
    import zlib
    from collections import Counter

    split = [(d, zlib.crc32(str(d).encode()) % 7 == 2, [0, *re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")), None]) for d, t in docs]
    count: Counter = Counter()
    for _, held, w in split:
        if not held:
            count.update(tuple(w[i - k : i + 1]) for i in range(len(w)) for k in range(min(order, i + 1)))
    n = sum(c for k, c in count.items() if len(k) == 1 and k != (0,))
    v = sum(len(k) == 1 and k != (0,) for k in count)

    def p(history: tuple, word) -> float:
        if not history:
            return (count[(word,)] + 1) / (n + v + 1)
        k = strength(len(history))
        return (count[(*history, word)] + k * p(history[1:], word)) / (count[history] + k)

    out = []
    for d, held, w in split:
        one = [math.log10(p((), x)) for x in w[1:]]
        full = [math.log10(p(tuple(w[max(0, i - order + 1) : i]), w[i])) for i in range(1, len(w))]
        out.append((d, held, len(one), sum(count[(x,)] > 0 for x in w[1:]), n, sum(one), sum(full)))
    return out
