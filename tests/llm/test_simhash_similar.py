"""The pipeline's near-duplicate stage against every pair compared."""

import random

import corpus_pipeline as P
from partloom.llm import simhash_similar

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n):
    return [r.choice([f"word{i}" for i in range(300)]) for _ in range(n)]


def changed(r, words, n):
    out = list(words)
    for i in r.sample(range(0, len(out), 7), n):
        out[i] = f"new{r.random()}"
    return out


def left(spark, rows):
    return sorted(P.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect(), key=lambda x: (x.doc_id is None, x.doc_id, str(x)))


def test_near_copies_go(spark):
    r = random.Random(4)
    docs, n = [], 0
    for k in (1, 2, 4, 6, 8, 9, 12, 20):  # changed words of 400: similarity 0.98 to 0.6
        base = prose(r, 400)
        for words in (base, changed(r, base, k), changed(r, base, k)):
            docs.append((n, " ".join(words)))
            n += 1
    chain = [prose(r, 300)]
    for _ in range(12):  # neighbours are alike, the ends are not
        chain.append(changed(r, chain[-1], 4))
    docs += [(n + i, " ".join(w)) for i, w in enumerate(chain)]
    docs += [(200, None), (201, ""), (202, "a b"), (203, "A  b"), (204, "a c")]
    want = sorted(d for d, c in simhash_similar.brute_force(docs) if d == c)
    got = left(spark, [(d, t, "en", "s", 1) for d, t in docs])
    assert sorted(x.doc_id for x in got) == want and 1 not in want and 201 not in want and 203 not in want
    assert {10, 13} & set(want) == set() and {22, 23} <= set(want)


def test_most_pairs_of_the_least_similarity_share_a_band():
    r = random.Random(6)
    for _ in range(200):
        base = prose(r, 450)
        other = changed(r, base, 9)
        a, b = " ".join(base).encode(), " ".join(other).encode()
        prints, _ = simhash_similar.sketches([a, b])
        assert bin(int(prints[0] ^ prints[1]) & ((1 << 64) - 1)).count("1") <= simhash_similar.RADIUS
        assert simhash_similar.alike(simhash_similar.shingles(a), simhash_similar.shingles(b))
        assert set(simhash_similar.sketches([a])[1][0]) & set(simhash_similar.sketches([b])[1][0])


def test_documents(spark):
    """Among them 177, which is alike to an earlier text but more than four SimHash bits away."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*P.COLUMNS)
    want = sorted(d for d, c in simhash_similar.brute_force([tuple(r) for r in docs.select("doc_id", "text").collect()]) if d == c)
    assert sorted(x.doc_id for x in P.near_dedup(spark, docs, "").collect()) == want and 177 not in want


def test_null_and_repeated_ids(spark):
    r = random.Random(9)
    texts = [" ".join(prose(r, 60)) for _ in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (None, None), (7, texts[2]), (7, texts[3]), (8, texts[3].upper()), (9, texts[4]), (None, texts[4]), (10, texts[5]), (10, texts[5])]
    got = left(spark, [(d, t, None, "s", 1) for d, t in rows])
    want = [(None, texts[0]), (None, texts[1]), (None, None), (7, texts[2]), (7, texts[3]), (9, texts[4]), (10, texts[5])]
    assert sorted(((x.doc_id, x.text) for x in got), key=str) == sorted(want, key=str)


def star(r, n):
    """A text and copies of it that are alike to it, but not to one another."""
    base = prose(r, 300)
    return [base, *[changed(r, base, 6) for _ in range(n)]]


def test_a_group_may_hang_on_one_member(spark, monkeypatch):
    r = random.Random(12)
    rows = [(i, " ".join(w), "en", "s", 1) for i, w in enumerate([*star(r, 40), *star(r, 3), *[prose(r, 90) for _ in range(5)]])]
    want = sorted(d for d, c in simhash_similar.brute_force([x[:2] for x in rows]) if d == c)
    assert len(want) == 7
    for part in (1 << 12, 3):  # whole shards, and shards dealt into parts
        monkeypatch.setattr(simhash_similar, "PART_ROWS", part)
        assert [x[0] for x in left(spark, rows)] == want
