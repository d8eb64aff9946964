"""Global positions and running sums in two passes, without a task that sees all rows (STM-02, STM-06, LIM-02).

Pass one sorts rows into ranges and writes them; pass two adds to each row's place in its range the number (or the sum) of the rows
in the ranges before.  Only one figure per range reaches the driver.  Rows that are equal in the order are told apart by a hash
of the row, so a key that a third of all rows share is cut into ranges like any other."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def written(df: DataFrame) -> DataFrame:
    """``df`` cut through the checkpoint folder that the session names (a folder of its own in a local session without one)."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="partloom-"))
    return df.checkpoint(eager=True)


def _ranged(df: DataFrame, order: list[Column | str], parts: int | None) -> DataFrame:
    """Rows in sorted ranges with ``_range`` and ``_place`` (from zero in the range)."""
    ties = F.xxhash64(*[F.col(f"`{c}`").cast("string") if d.startswith(("map", "variant")) else F.col(f"`{c}`") for c, d in df.dtypes])
    keyed = df.withColumn("_tie", ties)
    by = [*order, "_tie"]
    ranged = keyed.repartitionByRange(parts, *by) if parts else keyed.repartitionByRange(*by)
    # the generated number holds the partition in its high bits and the row's place in the low 33
    numbered = ranged.sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    return written(numbered.withColumns({"_range": F.shiftright("_id", 33).cast("int"), "_place": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id", "_tie"))


def _before(ranged: DataFrame, figure: Column) -> Column:
    """What the ranges before a row's own hold: a literal of one number per range."""
    sums = {r["_range"]: r["s"] or 0 for r in ranged.groupBy("_range").agg(figure.alias("s")).collect()}
    out, total = [], 0
    for i in range(max(sums, default=-1) + 1):
        out.append(total)
        total += sums.get(i, 0)
    return F.get(F.array(*[F.lit(x) for x in out]) if out else F.array(F.lit(0)), F.col("_range"))


def numbered(df: DataFrame, order: list[Column | str], name: str = "position", parts: int | None = None) -> DataFrame:
    """``df`` with each row's place (from zero) in the global order.  Nulls come first; an empty table stays empty; repeated rows
    get places of their own."""
    ranged = _ranged(df, order, parts)
    return ranged.withColumn(name, (F.col("_place") + _before(ranged, F.count("*"))).cast("bigint")).drop("_range", "_place")


def running(df: DataFrame, order: list[Column | str], value: str, name: str = "running", parts: int | None = None) -> DataFrame:
    """``df`` with the sum of an integer column over all rows up to and with each row; null counts as zero."""
    ranged = _ranged(df, order, parts)
    own = F.sum(F.coalesce(F.col(value), F.lit(0))).over(Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn(name, (own + _before(ranged, F.sum(value))).cast("bigint")).drop("_range", "_place")


def page_of(df: DataFrame, order: list[Column | str], offset: int, limit: int) -> DataFrame:
    """The rows at the places ``offset`` to ``offset + limit``: a window of a run, and the limit is the feature."""
    at = F.col("_at")
    return numbered(df, order, "_at").where((at >= offset) & (at < offset + limit)).drop("_at")


def budgeted(df: DataFrame, order: list[Column | str], budget: int, wanted: Column | None = None) -> DataFrame:
    """A budget of fetches that spans all keys: ``attempt`` numbers the rows that want one (all by default) in order, ``allowed`` is
    true for the first ``budget``, null for rows that want none."""
    wish = F.coalesce(wanted, F.lit(False)) if wanted is not None else F.lit(True)
    out = running(df.withColumn("_wish", wish.cast("int")), order, "_wish", "attempt")
    asked = F.col("_wish") == 1
    return out.withColumns({"attempt": F.when(asked, F.col("attempt")), "allowed": F.when(asked, F.col("attempt") <= budget)}).drop("_wish")
