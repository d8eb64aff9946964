"""Line-first quality cleaning, in DataFrame functions only.

Every line that has a word is judged by itself: it fails the *punctuation* rule without any sentence end or when
marks make up over a tenth of its characters, the *navigation* rule with three or more stand-alone separators that
make up a fifth of its words, and the *boilerplate* rule with one of the fixed phrases.  Failing lines are removed;
a document that loses more than half of its characters that way is rejected, as is one that fails the base rules
(fewer than ten words, or over a fifth of its words inside five-word windows that occur twice).

One pass over the rows without a shuffle: repeated windows are found by sorting each text's own window hashes
(64 bits), so the cost is n log n in the length of a text, and texts without repeats skip the sort.

Defined results: null and empty texts count as no words, fail the base rules and are not kept; ties and repeated rows
are judged one by one; other columns pass through untouched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MARKS = "#*$%&|<>!=~^_{}[]\\"
SENTENCE_ENDS = ".!?…。"
SEPARATORS = ["|", ">", "»", "•", "·", "/"]
BOILERPLATE = ["all rights reserved", "licensed under", "released under the", "terms of service", "terms of use", "privacy policy", "cookie policy",
               "accept all cookies", "subscribe to our", "sign up for our", "click here to", "skip to main content", "javascript is disabled"]
MIN_WORDS = 10
WINDOW = 5


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), lambda x: x != "")


def repeated_words(hashes: Column, n: int = WINDOW) -> Column:
    """Words inside windows of ``n`` words that occur twice or more, from an array of window hashes."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def again(x: Column, i: Column, every: Column) -> Column:
        return (F.get(every, i - 1)["h"].eqNullSafe(x["h"])) | (F.get(every, i + 1)["h"].eqNullSafe(x["h"]))

    # the sorted pairs travel as the only element of an array, so that the inner function sees them evaluated once
    places = F.flatten(F.transform(F.array(pairs), lambda every: F.transform(F.filter(every, lambda x, i: again(x, i, every)), lambda x: x["i"])))
    start = F.struct(F.lit(0).alias("n"), F.lit(-n).alias("p"))
    swept = F.aggregate(F.sort_array(places), start, lambda a, p: F.struct((a["n"] + F.least(F.lit(n), p - a["p"])).alias("n"), p.alias("p")), lambda a: a["n"])
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(swept).cast("bigint")


def line_fails(line: Column, chars: Column) -> Column:
    marks = F.length(chars) - F.length(without(chars, MARKS))
    unended = F.length(chars) == F.length(without(chars, SENTENCE_ENDS))
    tokens = words(line)
    lone = F.size(F.filter(tokens, lambda x: x.isin(SEPARATORS)))
    crowded = F.when((F.length(chars) - F.length(without(chars, "".join(SEPARATORS)))) < 3, F.lit(False)).otherwise((lone >= 3) & (5 * lone >= F.size(tokens)))
    low = F.lower(line)
    boiler = F.lit(False)
    for phrase in BOILERPLATE:
        boiler = boiler | F.contains(low, F.lit(phrase))
    return (chars != "") & (unended | (10 * marks > F.length(chars)) | crowded | boiler)


def judge(docs: DataFrame, text: str = "text", prefix: str = "_q_") -> DataFrame:
    """``docs`` with the columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept_chars,
    cleaned and kept, each under ``prefix``.  A column that has the name of a result already is replaced by it; all other
    columns pass through, whatever their names."""
    results = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept_chars", "cleaned", "kept"]
    p = prefix
    while any(c.lower().startswith(p.lower()) for c in docs.columns):
        p += "_"
    others = [c for c in docs.columns if c.lower() not in {(prefix + x).lower() for x in results}]
    t = F.coalesce(F.col(text), F.lit(""))
    first = docs.withColumns({
        f"{p}words": words(t),
        f"{p}lines": F.transform(F.split(t, "\n"), lambda x: F.struct(x.alias("line"), without(x, BLANKS).alias("chars"))),
        f"{p}n_symbols": (F.length(t) - F.length(without(t, SYMBOLS))).cast("bigint"),
    })
    second = first.withColumns({
        f"{p}hashes": F.transform(F.col(f"{p}words"), lambda w: F.xxhash64(w)),
        f"{p}n_words": F.size(f"{p}words").cast("bigint"),
        f"{p}full": F.transform(F.filter(f"{p}lines", lambda x: x["chars"] != ""), lambda x: x["line"]),
        f"{p}word_chars": F.aggregate(f"{p}lines", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x["chars"])),
        f"{p}good": F.filter(f"{p}lines", lambda x: ~line_fails(x["line"], x["chars"])),
    }).drop(f"{p}words", f"{p}lines")
    h = F.col(f"{p}hashes")
    index = F.when(F.size(h) >= WINDOW, F.sequence(F.lit(0), F.size(h) - WINDOW)).otherwise(F.array().cast("array<int>"))
    third = second.withColumns({
        f"{p}windows": F.transform(index, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WINDOW)])),
        f"{p}n_dup_lines": (F.size(f"{p}full") - F.size(F.array_distinct(f"{p}full"))).cast("bigint"),
        f"{p}kept_chars": F.aggregate(f"{p}good", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x["chars"])),
        f"{p}cleaned": F.array_join(F.transform(f"{p}good", lambda x: x["line"]), "\n"),
    }).drop(f"{p}hashes", f"{p}full", f"{p}good")
    fourth = third.withColumn(f"{p}n_repeat_words", repeated_words(F.col(f"{p}windows"))).drop(f"{p}windows")
    n = F.col(f"{p}n_words")
    failed = (n < MIN_WORDS) | (100 * F.col(f"{p}n_repeat_words") > 20 * n)
    done = fourth.withColumn(f"{p}base_failed", failed).withColumn(f"{p}kept", ~F.col(f"{p}base_failed") & (2 * F.col(f"{p}kept_chars") >= F.col(f"{p}word_chars")))
    # A filter on the verdict would be pushed through the projections, which writes every expression out in place of its
    # name: arrays would then be made again for each of their elements.  Nothing is pushed through a generator.
    held = done.select(*others, F.explode_outer(F.array(F.struct(*[F.col(p + x).alias(x) for x in results]))).alias(f"{p}all"))
    return held.select(*others, *[F.col(f"{p}all")[x].alias(prefix + x) for x in results])


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return found.select("doc_id", *[F.col(f"_q_{n}").alias(n) for n in names])


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql() -> str:
    """The same table in DuckDB SQL."""
    blanks = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
    strip = lambda x: f"translate({x}, ' '||{blanks}, '')"
    split = lambda x: f"list_filter(string_split(translate({x}, {blanks}, '     '), ' '), lambda w: w <> '')"
    bad = " OR ".join([f"length(c) = length(translate(c, {_quoted(SENTENCE_ENDS)}, ''))", f"10 * (length(c) - length(translate(c, {_quoted(MARKS)}, ''))) > length(c)", "(lone >= 3 AND 5 * lone >= n)", *(f"contains(lower(l), {_quoted(x)})" for x in BOILERPLATE)])
    separators = ", ".join(map(_quoted, SEPARATORS))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, {split('t')} AS ws, {strip('t')} AS joined FROM d),
line AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
told AS (SELECT doc_id, l, {strip('l')} AS c, {split('l')} AS ts FROM line),
counted AS (SELECT doc_id, l, c, len(ts) AS n, len(list_filter(ts, lambda x: x IN ({separators}))) AS lone FROM told WHERE c <> ''),
by_line AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines, sum(CASE WHEN {bad} THEN 0 ELSE length(c) END) AS kept_chars FROM counted GROUP BY doc_id),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM win),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, (SELECT unnest(range(5)) AS j) WHERE k >= 2 GROUP BY doc_id),
base AS (SELECT w.doc_id, len(ws) AS n_words, length(joined) AS word_chars, length(t) - length(translate(t, {_quoted(SYMBOLS)}, '')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, coalesce(kept_chars, 0) AS kept_chars
  FROM w LEFT JOIN by_line USING (doc_id) LEFT JOIN cov USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 20 * n_words) AND 2 * kept_chars >= word_chars AS kept
FROM base"""
