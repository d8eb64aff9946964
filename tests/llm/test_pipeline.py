"""The pipeline against its stages done plainly, and with planted cases."""

import random

import corpus_pipeline as P
from partloom.llm import decontaminate, quality, simhash_similar

SF = "/root/testdata/sf0.001"


def stage(spark, k, rows, sf=SF):
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS extra")
    return P.STAGES[k][1](spark, frame, sf)


def test_run_equals_plain_stages(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*P.COLUMNS).collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    judged = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).where("_q_kept").collect()
    docs = [(r.doc_id, r._q_cleaned) for r in judged]
    docs = [(d, t) for (d, t), (_, c) in zip(docs, simhash_similar.brute_force(docs)) if d == c]
    import re

    out = []
    least = {}
    split = [(d, t, re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t in docs]
    for d, _, w in split:
        for i in range(len(w) - 12):
            least[tuple(w[i : i + 13])] = min(d, least.get(tuple(w[i : i + 13]), d))
    for d, t, w in split:
        gone = {i + j for i in range(len(w) - 12) if least[tuple(w[i : i + 13])] < d for j in range(13)}
        if len(gone) < len(w) or not gone:
            out.append((d, " ".join(x for i, x in enumerate(w) if i not in gone) if gone else t))
    clean = {r[0]: t for r, (_, t) in zip(decontaminate.brute_force(out, items), out) if not r[5]}
    got = P.run(spark, SF).collect()
    assert {r.doc_id for r in got} == set(clean) and clean
    from tokenizers import Tokenizer

    from partloom.llm import packing

    plain = Tokenizer.from_file(packing.TOKENIZER)
    assert {r.doc_id: r.doc_tokens for r in got} == {d: len(plain.encode(t, add_special_tokens=False).ids) + 1 for d, t in clean.items()}


def prose(r, n):
    return " ".join(r.choice([f"word{i}" for i in range(300)]) for _ in range(n)).capitalize() + "."


def test_planted(spark):
    r = random.Random(8)
    a, b, c = prose(r, 120), prose(r, 120), prose(r, 80)
    near = a.replace(a.split()[60], "other", 1)
    base = [(1, a, "en", "s", 1), (2, a, "en", "s", 1), (3, near, "en", "s", 1), (4, b, "en", "s", 1), (5, None, None, None, None), (6, "", "en", "s", 0), (7, c + "\nAll rights reserved.", "en", None, 5)]
    kept = {x.doc_id: x for x in stage(spark, 0, base).collect()}
    assert set(kept) == {1, 2, 3, 4, 7} and kept[7].text == c and kept[7].n_chars == len(c)
    assert stage(spark, 0, base).columns == P.COLUMNS
    left = sorted(x.doc_id for x in stage(spark, 1, base).collect())
    assert left == [1, 4, 5, 7] or left == [1, 3, 4, 5, 7]
    shared = prose(r, 60)
    cut = {x.doc_id: x.text for x in stage(spark, 2, [(1, f"{a} {shared}", "en", "s", 1), (2, f"{b} {shared} {c}", "en", "s", 1), (3, shared, "en", "s", 1), (4, None, None, None, None)]).collect()}
    assert cut[1] == f"{a} {shared}" and cut[2] == f"{b} {c}" and 3 not in cut and 4 in cut
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    left = sorted(x.doc_id for x in stage(spark, 3, [(1, f"{a} {item} {b}", "en", "s", 1), (2, b, "en", "s", 1), (3, None, None, None, None)]).collect())
    assert left == [2, 3]
    for k in range(5):
        assert stage(spark, k, []).count() == 0


def test_rows_without_ids_and_with_shared_ids_stay(spark):
    """What goes is named; everything else comes out, whatever its id."""
    r = random.Random(11)
    texts = [prose(r, 90) for _ in range(6)]
    rows = [(None, texts[0], "en", "s", 1), (None, texts[1], None, None, None), (7, texts[2], "en", "s", 1), (7, texts[3], "en", "s", 1), (8, texts[4], "en", "s", 1), (None, texts[5] + " " + texts[5][:-1].lower(), "en", "s", 1)]
    repeats = rows[-1]  # half of it is said twice: the quality rules reject it
    left = stage(spark, 0, rows).collect()
    assert sorted(str(x.text) for x in left) == sorted(t for _, t, *_ in rows if t != repeats[1])
    for k in (1, 2, 3):
        assert sorted(((x.doc_id, x.text) for x in stage(spark, k, rows[:5]).collect()), key=str) == sorted(((d, t) for d, t, *_ in rows[:5]), key=str)
    packed = stage(spark, 4, rows[:5]).collect()
    assert len(packed) == 5 and sorted(str(x.doc_id) for x in packed) == ["7", "7", "8", "None", "None"]
    again = stage(spark, 2, [rows[2], rows[2], (9, texts[2], "en", "s", 1)]).collect()
    assert sorted(x.doc_id for x in again) == [7, 7]  # rows of one id never remove each other's words
