"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import sanitize, strip, text
from ..operators.analyze import INPUT

PHRASES = ['4-1/2" Metal Cut-Off Disc P80 5pc', "3/8 CPLG BRS 150#", "LED Downlight 4000K 12W 120V WH", "Trex Transcend Grooved Decking 12'", "Hunter Fan 52\" BZ", "24 in Dishwasher SS BLTIN 44 dBA", "Stikit Sanding Belt 120 grit", "Elec Range 30\" wide BK", "THHN Wire 12-2 Southwire", "Mortar Mix 50 LB", "Drill Bit 1/4 in 10pk", "Post Cap 4x4 Wh"]
SUFFIX = ["-UPC", "-BX", "Z", ""]


#: rows of a task where a row takes tenths of a millisecond or more
ROWS_A_TASK = 5_000


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """The rows, about ``n``, dealt out evenly: a small file, or one of few row groups, would be the work of as few tasks."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS_A_TASK)))


def parts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of ``part``, dealt out (its number of rows stands in the files' footers)."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return dealt(part.select(*columns), part.count())


def catalog_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-column product rows made from ``part`` and ``supplier``: rotating suffixes, phrases and brand cells; dealt out after the join,
    so that all that is done with a row is."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name")
    n = supplier.agg(F.count("*").alias("n")).scalar()
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("p_partkey") % len(xs) + 1).cast("int"))
    rows = part.withColumn("_s", (F.col("p_partkey") % n) + 1)
    met = dealt(rows.join(supplier, F.col("_s") == F.col("s_suppkey"), "left").drop("_s", "s_suppkey"), part.count())
    return met.select(
        F.col("p_partkey").alias("row_id"),
        F.concat(F.lit("PN-"), F.col("p_partkey").cast("string"), pick(SUFFIX)).alias("Mfg_Part_Num"),
        F.concat_ws(" ", F.col("p_name"), F.concat(F.col("p_size").cast("string"), F.lit('"')), pick(PHRASES)).alias("Part_Desc"),
        F.when(F.col("p_partkey") % 5 == 0, F.col("p_brand")).otherwise(F.lit("-- Unbranded --")).alias("E1_Brand"),
        F.lit("-- No Unilog Brand --").alias("Unilog_Brand"),
        F.when(F.col("p_partkey") % 7 == 0, pick(["Kitchen Aid", "Milw", "Freud", "satco"])).otherwise(F.lit("-- No DIB Brand --")).alias("DIB_Brand"),
        F.coalesce("s_name", F.lit("")).alias("Part_Manuf"),
    )


#: the same rows in DuckDB SQL
def catalog_input_sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    pick = lambda xs: f"list_extract([{', '.join(map(q, xs))}], CAST(p_partkey % {len(xs)} AS INT) + 1)"
    return f"""SELECT p_partkey AS row_id, 'PN-' || p_partkey || {pick(SUFFIX)} AS Mfg_Part_Num, p_name || ' ' || p_size || '" ' || {pick(PHRASES)} AS Part_Desc,
CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE '-- Unbranded --' END AS E1_Brand, '-- No Unilog Brand --' AS Unilog_Brand,
CASE WHEN p_partkey % 7 = 0 THEN {pick(['Kitchen Aid', 'Milw', 'Freud', 'satco'])} ELSE '-- No DIB Brand --' END AS DIB_Brand, coalesce(s_name, '') AS Part_Manuf
FROM part LEFT JOIN supplier ON s_suppkey = p_partkey % (SELECT count(*) FROM supplier) + 1"""


def read_csv_rows(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """CSV rows as trimmed strings without blank rows (a byte order mark is tolerated); null becomes ''."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    named = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    kept = columns or named.columns
    clean = named.select(*[strip(F.col(f"`{c}`")).alias(c) if c in named.columns else F.lit("").alias(c) for c in kept])
    return clean.where(F.exists(F.array(*[F.col(f"`{c}`") for c in kept]), lambda x: x != ""))


def rows_from_text(spark: SparkSession, lines: list[str], columns: list[str] = INPUT) -> DataFrame:
    """The same from uploaded text: a header line and data lines, each with its position as ``row_id``."""
    import csv

    parsed = list(csv.reader(lines))
    head = [h.lstrip("﻿").strip() for h in parsed[0]] if parsed else []
    data = [[i, *[(r[head.index(c)] or "").strip() if c in head and head.index(c) < len(r) else "" for c in columns]] for i, r in enumerate(parsed[1:], 1) if any(x.strip() for x in r)]
    return spark.createDataFrame(data, "row_id long, " + ", ".join(f"`{c}` string" for c in columns))


def write_csv_rows(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Sanitised cells in the given column order; missing columns are empty, others are ignored."""
    rows.select(*[sanitize(F.col(f"`{c}`")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in columns]).write.mode("overwrite").option("header", True).csv(path)


def write_provenance(rows: DataFrame, path: str, columns: list[str]) -> None:
    rows.select(*columns).write.mode("overwrite").json(path)


def read_reports(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and corrupt lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched pages with a status; the table holds successful fetches."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").withColumn("status", F.lit(200))


def content_hash(columns: list[str]) -> Column:
    """sha256 over the JSON of the columns in the order of their names."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


def fresh_cache(cache: DataFrame, columns: list[str], now: Column, days: int = 30) -> DataFrame:
    """Cached bundles that are intact and young enough: the hash matches, ``fetched_at`` is there and within the limit."""
    return cache.where((F.col("content_hash") == content_hash(columns)) & F.col("fetched_at").isNotNull() & (F.col("fetched_at") > now - F.make_dt_interval(F.lit(days))))


def taxonomy_union(bundled: DataFrame, official: DataFrame) -> DataFrame:
    """Leaves keyed by classpath: official ones replace bundled ones and keep their place."""
    both = bundled.withColumn("_src", F.lit(0)).unionByName(official.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("classpath")
    ranked = both.withColumn("_first", F.min(F.struct("_src", "ord")).over(w)).withColumn("_rn", F.row_number().over(w.orderBy(F.desc("_src"), F.desc("ord"))))
    return ranked.where("_rn = 1").drop("_rn", "_src").withColumn("ord", F.col("_first.ord")).drop("_first")


def header_row(cells: DataFrame, window: int = 12) -> DataFrame:
    """Workbook cells ``(sheet, row, col, value)`` -> the densest of the first rows of each sheet."""
    dense = cells.where((F.col("row") <= window) & (F.trim(text("value")) != "")).groupBy("sheet", "row").agg(F.count("*").alias("filled"))
    return dense.groupBy("sheet").agg(F.max_by("row", F.struct("filled", (-F.col("row")).alias("r"))).alias("header_row"))


def classify_workbook(headers: Column) -> Column:
    """Kind of a workbook from its header names."""
    has = lambda *names: F.exists(headers, lambda h: F.lower(F.trim(h)).isin(*names))
    return F.when(has("manufacturer name", "brand name"), F.lit("manufacturers")).when(has("allowed value", "lov"), F.lit("lov")).when(has("abbreviation", "uom"), F.lit("uom")).when(has("fraction", "decimal"), F.lit("fractions")).when(has("classpath"), F.lit("taxonomy")).otherwise(F.lit("unknown"))


def llm_gate(brand: Column, n_items: Column, category: Column, desc: Column) -> Column:
    """Rows that a model would be asked about, and the key under which its answer is cached."""
    return F.struct(((brand == "") & (n_items <= 2) & (category != "") & (F.length(desc) >= 8)).alias("ask"), F.substring(F.sha2(F.concat_ws("|", brand, category, desc), 256), 1, 24).alias("cache_key"))
