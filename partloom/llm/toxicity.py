"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, written in numpy.

A word's input is the sum of its word vector (known words) and the mean vector of its hashed byte 3- and 4-grams, so
unseen forms still have an input.  A text is read in windows of ``WINDOW`` words that overlap by half; both directions
of the network run over each window, attention pools their states and a linear layer gives the window's score.  A text
scores as its worst window, through a logistic calibration.

The network's size is fixed by parameters: vectors of ``DIM``, states of ``HIDDEN`` numbers a direction, ``GRAMS`` hashed
grams, and word vectors for the ``VOCABULARY`` words that most training texts hold (at least two; other words are read by
their grams alone).

Training reads a bounded sample: about ``SAMPLE`` labelled texts of each class, chosen by a hash of the id among texts
of at most ``LONGEST`` bytes, one text for an id.  Only whole texts have labels, so a toxic text's windows are at first all taken as toxic and
later its worst windows only.  Every text is scored whole: all of its windows.

Defined results: null, empty and white-space texts have one empty window and get that window's score; without labels
of both classes every score is 0; labels other than 0 and 1 are not learnt from, an id with both counts as 1; ties and
repeated rows are scored one by one; other columns pass through in ``keep``."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .wordnum import Words, member

WINDOW = 48
STRIDE = WINDOW // 2
SAMPLE = 600
LONGEST = 1 << 18
DIM, HIDDEN, GRAMS, VOCABULARY = 16, 8, 1 << 13, 4000
STEPS, FIRST_STEPS, BATCH, RATE = 170, 70, 256, 0.01


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def byte_grams(words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 3- and 4-grams of the words at ``at``, with end marks: (gram numbers, first gram of each word)."""
    size = words.end[at] - words.start[at] + 2
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) + np.repeat(words.start[at] - 1 - first, size)
    byte = words.buf[place].astype(np.uint32)
    byte[first], byte[first + size - 1] = 60, 62
    left = np.repeat(first + size, size) - np.arange(len(byte))  # bytes from here to the word's end
    wide = np.concatenate((byte, np.zeros(4, np.uint32)))
    n = len(byte)
    three = wide[:n] | wide[1 : n + 1] << np.uint32(8) | wide[2 : n + 2] << np.uint32(16)
    four = three | wide[3 : n + 3] << np.uint32(24)
    both = np.stack((three * np.uint32(2654435761), four * np.uint32(2246822519) + np.uint32(1)), axis=1) >> np.uint32(32 - GRAMS.bit_length() + 1)
    valid = np.stack((left >= 3, left >= 4), axis=1)
    counts = np.add.reduceat(valid.sum(axis=1), first) if len(first) else np.empty(0, np.int64)
    return both[valid].astype(np.int64), np.concatenate(([0], np.cumsum(counts)))[:-1].astype(np.int64)


def windows(counts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, size, text) of all overlapping windows; a text without words has one empty window."""
    n = np.maximum(1, -(-(counts - STRIDE) // STRIDE))
    doc = np.repeat(np.arange(len(counts)), n)
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    size = np.minimum(WINDOW, counts[doc] - step * STRIDE)
    return first[:-1][doc] + step * STRIDE, size, doc


def scatter(index: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sums of the values of each row number."""
    out = np.zeros((rows, values.shape[1]), np.float32)
    order = np.argsort(index, kind="stable")
    index = index[order]
    lead = np.flatnonzero(np.concatenate(([True], index[1:] != index[:-1])))
    out[index[lead]] = np.add.reduceat(values[order], lead, axis=0)
    return out


class Network:
    def __init__(self, known: np.ndarray, seed: int = 7):
        r = np.random.default_rng(seed)
        init = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.known = known  # sorted hashes of the vocabulary; row i + 1 of "word" belongs to entry i
        self.p = {"word": (0.1 * r.standard_normal((len(known) + 1, DIM))).astype(np.float32), "gram": (0.1 * r.standard_normal((GRAMS, DIM))).astype(np.float32),
                  "attend": init(2 * HIDDEN, HIDDEN), "pick": init(HIDDEN), "out": init(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        for way in "fb":
            self.p |= {f"{way}x": init(DIM, 3 * HIDDEN), f"{way}h": init(HIDDEN, 3 * HIDDEN), f"{way}c": np.zeros(3 * HIDDEN, np.float32)}
        self.calibration = (1.0, 0.0)

    def inputs(self, words: Words, at: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Input vectors of distinct words; ``known`` holds their vocabulary rows."""
        if not len(at):
            return np.zeros((0, DIM), np.float32)
        grams, first = byte_grams(words, at)
        sums = np.add.reduceat(self.p["gram"][grams], first, axis=0)
        n = np.diff(np.concatenate((first, [len(grams)])))
        return self.p["word"][known] + sums / n[:, None].astype(np.float32)

    def _run(self, way: str, projected: np.ndarray, mask: np.ndarray, tape: list | None = None) -> np.ndarray:
        """States of one direction; ``projected`` is time first."""
        steps, batch = mask.shape
        h = np.zeros((batch, HIDDEN), np.float32)
        out = np.empty((steps, batch, HIDDEN), np.float32)
        recur = self.p[f"{way}h"]
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            g = h @ recur
            x = projected[t]
            rz = 1 / (1 + np.exp(-(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])))
            r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
            c = g[:, 2 * HIDDEN :]
            new = np.tanh(x[:, 2 * HIDDEN :] + r * c)
            stay = 1 - (1 - z) * mask[t][:, None]
            if tape is not None:
                tape.append((t, h, r, z, c, new, stay))
            h = new + stay * (h - new)
            out[t] = h
        return out

    def logits(self, table: dict[str, np.ndarray], ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """``table`` holds the projected inputs of the distinct words; ``ids`` and ``mask`` are time first."""
        f, b = (self._run(way, table[way][ids], mask) for way in "fb")
        return self._pool(np.concatenate((f, b), axis=2), mask)[0]

    def _pool(self, states: np.ndarray, mask: np.ndarray):
        hidden = np.tanh(states @ self.p["attend"])
        e = hidden @ self.p["pick"] + (mask - 1) * 50
        a = np.exp(e - e.max(axis=0))
        a *= mask
        a /= np.maximum(a.sum(axis=0), 1e-9)
        pooled = np.einsum("tb,tbh->bh", a, states)
        return pooled @ self.p["out"] + self.p["bias"], hidden, a, pooled

    def step(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Loss, gradients of the layers and of the inputs ``x`` (time first)."""
        p, tapes, states = self.p, {}, []
        for way in "fb":
            tapes[way] = []
            states.append(self._run(way, x @ p[f"{way}x"] + p[f"{way}c"], mask, tapes[way]))
        states = np.concatenate(states, axis=2)
        logit, hidden, a, pooled = self._pool(states, mask)
        prob = sigmoid(logit)
        loss = float(-(y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7)).mean())
        d = ((prob - y) / len(y)).astype(np.float32)
        grad = {"bias": np.array([d.sum()]), "out": pooled.T @ d}
        dpool = d[:, None] * p["out"]
        dstates = a[:, :, None] * dpool
        da = np.einsum("tbh,bh->tb", states, dpool)
        de = a * (da - (a * da).sum(axis=0))
        grad["pick"] = np.einsum("tb,tbh->h", de, hidden)
        dh = de[:, :, None] * p["pick"] * (1 - hidden**2)
        grad["attend"] = np.einsum("tbi,tbj->ij", states, dh)
        dstates += dh @ p["attend"].T
        dx = np.zeros_like(x)
        for k, way in enumerate("fb"):
            gh, gp = np.zeros_like(p[f"{way}h"]), np.zeros((*mask.shape, 3 * HIDDEN), np.float32)
            carry = np.zeros((mask.shape[1], HIDDEN), np.float32)
            for t, h, r, z, c, new, stay in reversed(tapes[way]):
                carry = carry + dstates[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                m = mask[t][:, None]
                dnew = carry * (1 - stay) * (1 - new**2)
                dz = carry * (h - new) * m * z * (1 - z)
                dr = dnew * c * r * (1 - r)
                g = np.concatenate((dr, dz, dnew * r), axis=1)
                gp[t] = np.concatenate((dr, dz, dnew), axis=1)
                gh += h.T @ g
                carry = carry * stay + g @ p[f"{way}h"].T
            grad[f"{way}h"] = gh
            grad[f"{way}x"] = np.einsum("tbi,tbj->ij", x, gp)
            grad[f"{way}c"] = gp.sum(axis=(0, 1))
            dx += gp @ p[f"{way}x"].T
        return loss, grad, dx

    def window_logits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(logits, text numbers) of all windows of the texts."""
        hashes = words.hashes()
        distinct, at, ids = np.unique(hashes, return_index=True, return_inverse=True)
        found, place = member(distinct, self.known)
        x = self.inputs(words, at, np.where(found, place + 1, 0))
        zero = np.zeros((1, 3 * HIDDEN), np.float32)
        table = {way: np.concatenate((x @ self.p[f"{way}x"] + self.p[f"{way}c"], zero)).astype(np.float32) for way in "fb"}
        begin, size, doc = windows(words.counts, words.first)
        ids = np.concatenate((ids, [len(distinct)]))
        out = np.empty(len(begin), np.float32)
        order = np.argsort(size, kind="stable")
        for a in range(0, len(order), 1024):
            some = order[a : a + 1024]
            steps = np.arange(max(1, int(size[some].max(initial=0))))[:, None]
            mask = steps < size[some]
            out[some] = self.logits(table, ids[np.where(mask, begin[some] + steps, len(ids) - 1)], mask.astype(np.float32))
        return out, doc

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        words = Words([t.lower() for t in texts])
        logits, doc = self.window_logits(words)
        worst = np.maximum.reduceat(logits, np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))))
        return sigmoid(self.calibration[0] * worst.astype(np.float64) + self.calibration[1])


def train(rows: list[tuple[int, bytes]], steps: int = STEPS, seed: int = 7) -> Network | None:
    """Fit the network to (label, text) rows; None without both classes."""
    labels = np.array([int(y) for y, _ in rows], np.float32)
    if len(set(labels.tolist())) < 2:
        return None
    r = np.random.default_rng(seed)
    words = Words([t.lower() for _, t in rows])
    hashes = words.hashes()
    in_texts: Counter = Counter()
    for d in range(len(rows)):
        in_texts.update(set(hashes[words.first[d] : words.first[d + 1]].tolist()))
    known = np.array(sorted(h for h, n in sorted(in_texts.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY] if n > 1), np.uint64)
    net = Network(known, seed)
    distinct, at, ids = np.unique(hashes, return_index=True, return_inverse=True)
    found, place = member(distinct, known)
    row = np.where(found, place + 1, 0)
    grams, first_gram = byte_grams(words, at)
    n_grams = np.diff(np.concatenate((first_gram, [len(grams)])))
    begin, size, doc = windows(words.counts, words.first)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    turns = 0
    while turns < steps:
        early = turns < FIRST_STEPS
        # later, the worst windows of every text come first, among them those that clean texts score worst on
        key = r.random(len(begin)) if early else 0.3 * r.random(len(begin)) - net.window_logits(words)[0]
        order = np.lexsort((key, doc))
        rank = np.arange(len(order)) - np.repeat(np.searchsorted(doc[order], np.arange(len(rows))), np.bincount(doc, minlength=len(rows)))
        limit = np.where(labels[doc[order]] == 1, 6 if early else 2, 6)
        picked = r.permutation(order[rank < limit])
        for a in range(0, len(picked), BATCH):
            some = picked[a : a + BATCH]
            time = np.arange(max(1, int(size[some].max(initial=0))))[:, None]
            mask = (time < size[some]).astype(np.float32)
            word = ids[np.where(mask > 0, begin[some] + time, 0)]
            used, back = np.unique(word, return_inverse=True)
            back = back.reshape(word.shape)
            own = np.where(r.random(len(used)) < 0.5, 0, row[used])  # half of the words are read by their grams alone
            spread = np.repeat(np.arange(len(used)), n_grams[used])
            which = grams[np.arange(len(spread)) + np.repeat(first_gram[used] - (np.cumsum(n_grams[used]) - n_grams[used]), n_grams[used])]
            sums = np.add.reduceat(net.p["gram"][which], np.cumsum(n_grams[used]) - n_grams[used], axis=0)
            x = (net.p["word"][own] + sums / n_grams[used][:, None].astype(np.float32))[back]
            y = labels[doc[some]] * (0.9 if early else 1.0)
            _, grad, dx = net.step(x.astype(np.float32), mask, y)
            per_word = scatter(back.ravel(), dx.reshape(-1, DIM), len(used))
            grad["word"] = scatter(own, per_word, len(net.p["word"]))
            grad["gram"] = scatter(which, (per_word / n_grams[used][:, None].astype(np.float32))[spread], GRAMS)
            turns += 1
            norm = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
            for k, g in grad.items():
                g = g * min(1.0, 5 / (norm + 1e-9))
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                net.p[k] -= (RATE * (m / (1 - 0.9**turns)) / (np.sqrt(v / (1 - 0.99**turns)) + 1e-6)).astype(np.float32)
    logits, doc = net.window_logits(words)
    worst = np.maximum.reduceat(logits, np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))).astype(np.float64)
    scale, shift = 1.0, 0.0
    for _ in range(200):
        prob = sigmoid(scale * worst + shift)
        weight = np.maximum(prob * (1 - prob), 1e-4)
        gs, gb = ((prob - labels) * worst).mean() + 1e-3 * (scale - 1), (prob - labels).mean()
        scale -= gs / max(float((weight * worst**2).mean()), 0.05)
        shift -= gb / max(float(weight.mean()), 0.05)
    net.calibration = (max(float(scale), 0.05), float(shift))
    return net


def score(docs: DataFrame, net: Network | None, keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """``keep`` columns and a struct column (its name is returned) with the field ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = common.as_bytes(batch.column(batch.schema.get_field_index("text")))
            return [pa.array(shared.value.scores(texts) if shared.value is not None else np.zeros(len(texts)), pa.float64())]

        return work

    return common.annotate(docs, make, "score double", keep, ["text"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = SAMPLE) -> Network | None:
    """Train on labelled documents, one label per id, outside the held-out fold.  The sample is drawn from the labels alone;
    its ids (bounded by ``per_class``) then filter the documents' scan, so no text is shuffled."""
    held = F.coalesce(common.crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    told = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held).groupBy("doc_id").agg(F.max(label).alias("label"))
    counts = {r["label"]: r["n"] for r in told.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col("label") == value, F.lit(min(1.0, per_class / n))).otherwise(share)
    spot = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = {r["doc_id"]: r["label"] for r in told.where(spot < share).collect()}
    texts = docs.where(F.col("doc_id").isin(sorted(drawn)) & F.col("text").isNotNull() & (F.octet_length("text") <= LONGEST)).groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    return train([(drawn[r["doc_id"]], r["text"].encode()) for r in sorted(texts, key=lambda r: (r["doc_id"], r["text"]))])


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    net = fit(docs, common.table(spark, sf_dir, "labels"))
    state, name = score(docs, net)
    held = F.coalesce(common.crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    value = F.col(name)["score"]
    return state.select("doc_id", held.alias("held_out"), value.alias("score"), (value >= 0.5).cast("int").alias("predicted"))
