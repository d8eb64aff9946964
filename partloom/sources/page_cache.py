"""The cache of raw pages: a file per part number with a line that names its source, an age limit and a limit on files (SRC-15, SNK-06).

``<folder>/page=<name>/part-*`` is written by Spark's text sink, one folder per part number, of which only those written anew are
replaced; reading is a scan of binary files that leaves out, before any is opened, what is older than the limit."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip, text

DAYS, FILES = 30, 300
HEAD, TAIL = "<!-- source: ", " -->\n"


def file_name(mpn: str = "mpn") -> Column:
    """A name that every file system takes: other characters than letters, digits, ``-`` and ``.`` become ``_``; two part numbers that
    would share it are told apart by a digest."""
    raw = strip(mpn)
    plain = F.regexp_replace(raw, r"[^A-Za-z0-9.\-]", "_")
    return F.when(plain == raw, plain).otherwise(F.concat(F.substring(plain, 1, 80), F.lit("_"), F.substring(F.sha2(raw, 256), 1, 8)))


def save_pages(pages: DataFrame, folder: str) -> None:
    """``pages(mpn, url, html)``: the page of each part number replaces the one that is there; of several the last url in order.  Rows
    without a part number are left out."""
    last = pages.where(strip("mpn") != "").groupBy(file_name().alias("page")).agg(F.max_by(F.struct(text("url").alias("url"), text("html").alias("html")), F.struct(text("url"), text("html"))).alias("s"))
    body = last.select("page", F.concat(F.lit(HEAD), F.col("s.url"), F.lit(TAIL), F.col("s.html")).alias("value"))
    body.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("lineSep", "\x00").partitionBy("page").text(folder)


def load_pages(spark: SparkSession, folder: str, now: datetime | None = None, days: float = DAYS) -> DataFrame:
    """``page, url, html, modified`` of the pages young enough.  A file without a source line has an empty url."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("basePath", folder)
    since = (now or datetime.now()) - timedelta(days=days)
    reader = reader.option("modifiedAfter", since.strftime("%Y-%m-%dT%H:%M:%S")).option("timeZone", since.astimezone().strftime("%z")[:3] + ":" + since.astimezone().strftime("%z")[3:])
    raw = reader.load(folder)
    body = F.rtrim(F.decode("content", "UTF-8"), F.lit("\x00"))
    headed = body.startswith(HEAD)
    at = F.instr(body, TAIL)
    url = F.trim(F.substring(body, F.lit(len(HEAD) + 1), at - len(HEAD) - 1))
    return raw.select(
        F.col("page").cast("string").alias("page"), F.when(headed & (at > 0), url).otherwise(F.lit("")).alias("url"),
        F.when(headed & (at > 0), F.substring(body, at + len(TAIL), F.length(body))).otherwise(body).alias("html"), F.col("modificationTime").alias("modified"),
    )


def evict(spark: SparkSession, folder: str, most: int = FILES) -> list[str]:
    """Delete all but the newest ``most`` files (of equal age those of the smaller name go first); the names that went.  The listing reads no
    contents; the limit is the feature."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "modificationTime")
    excess = files.count() - most
    if excess <= 0:
        return []
    gone = [r["path"] for r in files.orderBy("modificationTime", "path").limit(excess).collect()]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for name in gone:
        file = path(name).getParent()
        file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(file, True)
    return gone
