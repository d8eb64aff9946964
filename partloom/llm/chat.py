"""Chat formatting by perspective rotation.

Every participant of a conversation gets the dialogue rendered from their side: their own turns as ``assistant``, the
others' as named users, the ``system`` turns unchanged, and masks that cover their own turns' text and end mark only.

A dialogue is one row, up to ``BLOCK`` turn numbers and ``BLOCK`` rows; a longer one goes on in further rows (``block`` counts
the turn numbers by ``BLOCK``, ``part`` the rows inside a block), whose renderings follow one another, so no conversation, however
long, is gathered whole.  Turns meet the conversation's participants in an equi-join; each turn is rendered once per side,
which is the size of the result.

Inside a rendering, turns come by ``turn`` and, on ties, ``role`` and ``text``.  The marks are written by this operator only: what
looks like the beginning of one in a text or a name is broken by a blank (``< |``), and line ends in a name become blanks.

Defined results: a null or empty role is named ``unknown``; a null text is empty; a row without a conversation id is a
conversation of its own; a null turn comes first; repeated rows are rendered each; a conversation of system turns only has
no perspective and no rows; other columns are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
BLOCK = 128


def safe(text: Column) -> Column:
    """No text can end its turn or begin another."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def rotate(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """``conv_id, turn, role, text`` -> one row per dialogue side (and block and part): conv_id, perspective, block, part,
    n_turns, rendered, and masks: structs of ``start`` and ``end`` (code points of ``rendered``) that count as targets."""
    role = F.coalesce(F.nullif(F.translate("role", "\r\n", "  "), F.lit("")), F.lit("unknown"))
    lone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).otherwise(0)
    conversation = ["conv_id", "lone"]
    clean = turns.select("conv_id", lone.alias("lone"), "turn", role.alias("role"), safe(F.coalesce("text", F.lit(""))).alias("text"))
    clean = clean.withColumn("block", F.floor(F.col("turn") / block))
    order = Window.partitionBy(*conversation, "block").orderBy("turn", "role", "text")
    known = clean.where("conv_id IS NOT NULL")
    placed = known.withColumn("place", F.row_number().over(order) - 1).withColumn("part", F.floor(F.col("place") / block))
    sides = known.where("role <> 'system'").select("conv_id", F.col("role").alias("perspective")).distinct()
    # a row without a conversation id has one side, its own: it meets nothing, so its number is made and read in one place
    single = clean.where("conv_id IS NULL AND role <> 'system'").select("*", F.lit(0).alias("place"), F.lit(0).cast("bigint").alias("part"), F.col("role").alias("perspective"))
    met = placed.join(sides, "conv_id").unionByName(single)
    own = F.col("role") == F.col("perspective")
    speaker = F.when(own, F.lit("assistant")).when(F.col("role") == "system", F.lit("system")).otherwise(F.concat(F.lit("user name="), safe(F.col("role"))))
    head = F.concat(F.lit(BEGIN), speaker, F.lit("\n"))
    said = met.select(*conversation, "perspective", "block", "part", "place", own.alias("own"), F.length(head).alias("head"), F.concat(head, "text", F.lit(END)).alias("piece"))
    side = [*conversation, "perspective", "block", "part"]
    before = F.sum(F.length("piece").cast("bigint")).over(Window.partitionBy(*side).orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    spans = said.withColumn("from", F.coalesce(before, F.lit(0).cast("bigint")))
    span = F.struct((F.col("from") + F.col("head")).alias("start"), (F.col("from") + F.length("piece") - 1).alias("end"))
    every = F.array_sort(F.collect_list(F.struct("place", "piece", "own", span.alias("span"))))
    found = spans.groupBy(*side).agg(every.alias("every"))
    return found.select(
        "conv_id", "perspective", "block", "part", F.size("every").cast("bigint").alias("n_turns"), F.array_join(F.transform("every", lambda x: x["piece"]), "").alias("rendered"),
        F.transform(F.filter("every", lambda x: x["own"]), lambda x: x["span"]).alias("masks"),
    )


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rotate(table(spark, sf_dir, "conversations"))
    masks = F.array_join(F.transform("masks", lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["end"].cast("string"))), ",")
    return found.select("conv_id", "perspective", "block", "part", "n_turns", "rendered", masks.alias("masks"))


def sql() -> str:
    safe = lambda x: f"replace({x}, '<|', '< |')"
    side = "conv_id, lone, perspective, block, part"
    return f"""
WITH c AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () ELSE 0 END AS lone, turn, CAST(floor(turn / {BLOCK}) AS BIGINT) AS block,
  coalesce(nullif(translate(role, chr(13) || chr(10), '  '), ''), 'unknown') AS role, {safe("coalesce(text, '')")} AS text FROM conversations),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id, lone, block ORDER BY turn NULLS FIRST, role, text) - 1 AS place FROM c),
s AS (SELECT DISTINCT conv_id, lone, role AS perspective FROM c WHERE role <> 'system'),
j AS (SELECT p.*, place // {BLOCK} AS part, perspective, role = perspective AS own,
  '<|im_start|>' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || {safe("role")} END || chr(10) AS head
  FROM p JOIN s ON p.conv_id IS NOT DISTINCT FROM s.conv_id AND p.lone = s.lone),
r AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS piece FROM j),
f AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY {side} ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
SELECT conv_id, perspective, block, CAST(part AS BIGINT) AS part, count(*) AS n_turns, string_agg(piece, '' ORDER BY place) AS rendered,
  coalesce(string_agg(CAST(CAST(before + length(head) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(before + length(piece) - 1 AS BIGINT) AS VARCHAR), ',' ORDER BY place) FILTER (own), '') AS masks
FROM f GROUP BY {side}"""
