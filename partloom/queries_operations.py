"""Registered queries of caches, source policies, link discovery, reports and delivery decisions, with DuckDB SQL: each calls the
operator that its docstring names, on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import delivery, evidence, harvest, memory, pages, reports
from .queries import _t, query
from .sources import tables


@query("""SELECT o_orderkey, sha256('{"k":"' || o_orderkey || '","v":"' || o_orderstatus || '"}') AS content_hash FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND CAST(o_orderdate AS TIMESTAMP) > TIMESTAMP '1997-06-01' - INTERVAL 300 DAY""")
def fresh_bundles(spark, sf_dir):
    """SRC-14, SNK-05: cached bundles whose hash fits and that are young enough; spoiled and unstamped ones are none."""
    k = F.col("o_orderkey")
    rows = _t(spark, sf_dir, "orders").select(k, k.cast("string").alias("k"), F.col("o_orderstatus").alias("v"), F.when(k % 7 != 0, F.col("o_orderdate").cast("timestamp")).alias("fetched_at"))
    stamped = rows.withColumn("content_hash", tables.content_hash(["k", "v"])).withColumn("v", F.when(k % 5 == 0, F.lit("spoiled")).otherwise(F.col("v")))
    return tables.fresh_cache(stamped, ["k", "v"], F.lit("1997-06-01 00:00:00").cast("timestamp"), 300).select("o_orderkey", "content_hash")


@query("""WITH x AS (SELECT c_custkey, c_name, c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'b' END AS brand, c_custkey % 4 AS n FROM customer)
SELECT c_custkey, brand = '' AND n <= 2 AND length(c_name) >= 8 AS ask, sha256(brand || '|' || c_mktsegment || '|' || c_name)[1:24] AS cache_key FROM x""")
def model_gate(spark, sf_dir):
    """FIL-13, SRC-20: which rows a model would be asked about, and the key of its answer."""
    brand = F.when(F.col("c_custkey") % 3 == 0, "").otherwise("b")
    return _t(spark, sf_dir, "customer").select("c_custkey", tables.llm_gate(brand, F.col("c_custkey") % 4, F.col("c_mktsegment"), F.col("c_name")).alias("g")).select("c_custkey", "g.ask", "g.cache_key")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_suppkey % 3 = 0 THEN NULL WHEN l_suppkey % 3 = 1 THEN least(0.68, 0.5 + l_partkey % 5 / 10.0) ELSE 0.5 + l_partkey % 5 / 10.0 END::DOUBLE AS confidence FROM lineitem""")
def source_policy(spark, sf_dir):
    """AGG-03: nothing from pages that are not allowed, little trust in those of a fallback."""
    x = _t(spark, sf_dir, "lineitem")
    items = F.array(evidence.item("Size", F.col("l_quantity").cast("string"), url=F.lit("https://p.example"), confidence=0.5 + F.col("l_partkey") % 5 / 10))
    kept = evidence.apply_policy(items, F.col("l_suppkey") % 3 != 0, F.col("l_suppkey") % 3 == 1)
    return x.select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.get(kept, F.lit(0))["confidence"], 6).alias("confidence"))


@query("""WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 429 WHEN 1 THEN 202 ELSE 200 END AS status, CASE WHEN page_id % 7 = 0 THEN '  ' WHEN page_id % 8 = 0 THEN '<p>Verify you are human</p>' || html ELSE html END AS html FROM pages)
SELECT page_id, status IN (202, 429) OR trim(html) = '' OR regexp_matches(lower(html[1:12000]), 'captcha|are you a robot|unusual traffic|verify you are human|challenge-platform') AS challenge FROM p""")
def challenge_pages(spark, sf_dir):
    """FIL-08: pages that ask for a human, by status, emptiness or words."""
    n = F.col("page_id")
    status = F.when(n % 5 == 0, 429).when(n % 5 == 1, 202).otherwise(200)
    html = F.when(n % 7 == 0, "  ").when(n % 8 == 0, F.concat(F.lit("<p>Verify you are human</p>"), "html")).otherwise(F.col("html"))
    return tables.pages(spark, sf_dir).select("page_id", pages.is_challenge(status, html).alias("challenge"))


_SITE = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"


@query(f"""WITH p AS (SELECT page_id, {_SITE} AS site, list_distinct(regexp_extract_all(html, '<a href="(/[^"?#]*)"', 1)) AS links FROM pages)
SELECT page_id, len(list_distinct(list_transform(list_filter(links, lambda h: h LIKE '%e'), lambda h: site || h || '.pdf')))::BIGINT AS n_pdf FROM p""")
def pdf_link_discovery(spark, sf_dir):
    """EXT-12: links of a page whose path ends in ``.pdf``, made absolute; links that end in e are given that ending."""
    made = F.regexp_replace("html", '<a href="(/[^"?#]*e)"', '<a href="$1.PDF"')
    return tables.pages(spark, sf_dir).select("page_id", F.size(pages.pdf_links(made, F.col("url"))).cast("bigint").alias("n_pdf"))


@query("""SELECT count(*)::BIGINT AS descriptions_checked, sum(CASE WHEN regexp_matches(t, '(^|\\s|x)[0-9]+(-[0-9]+/[0-9]+)?(in|mm|cm|ft|dba)\\b', 'i') THEN 1 ELSE 0 END)::BIGINT AS violations FROM
  (SELECT unnest([p_name, p_type || ' ' || p_size || CASE p_partkey % 4 WHEN 0 THEN 'in' WHEN 1 THEN ' in' WHEN 2 THEN 'MM wide' ELSE 'inch' END]) AS t FROM part) WHERE t <> ''""")
def glued_unit_report(spark, sf_dir):
    """AGG-12: units written onto their numbers."""
    k = F.col("p_partkey") % 4
    t = F.concat("p_type", F.lit(" "), F.col("p_size").cast("string"), F.when(k == 0, "in").when(k == 1, " in").when(k == 2, "MM wide").otherwise("inch"))
    return reports.glued_units(_t(spark, sf_dir, "part").select("p_name", t.alias("t")), ["p_name", "t"])


@query("""SELECT count(*)::BIGINT AS populated_rows, round(100.0 * sum(CASE WHEN url LIKE 'http%' AND page_id % 3 <> 0 THEN 1 ELSE 0 END) / count(*), 2)::DOUBLE AS mfr_url_pct, round(100.0 * sum(CASE WHEN page_id % 4 = 1 THEN 1 ELSE 0 END) / count(*), 2)::DOUBLE AS any_ref_url_pct FROM pages""")
def source_coverage_report(spark, sf_dir):
    """AGG-12: shares of rows with a maker's url and with any reference."""
    p = tables.pages(spark, sf_dir).select(F.when(F.col("page_id") % 3 != 0, F.col("url")).otherwise("").alias("m"), F.when(F.col("page_id") % 4 == 1, F.array("url")).otherwise(F.array(F.lit("ftp://x"))).alias("r"))
    return reports.source_coverage(p, "m", "r")


@query("""WITH e AS (SELECT o.o_orderkey, o.o_orderpriority AS category, [o_orderstatus, o_clerk, o_orderpriority] AS want, [o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_clerk END, CASE WHEN o_orderkey % 4 = 0 THEN 'other' ELSE o_orderpriority END] AS have FROM orders o WHERE o_orderkey % 9 <> 0),
s AS (SELECT o_orderkey, category, round(len(list_filter(range(1, 4), lambda i: want[i] = have[i])) / 3.0, 4) AS score FROM e UNION ALL SELECT o_orderkey, o_orderpriority, 0 FROM orders WHERE o_orderkey % 9 = 0)
SELECT category, count(*)::BIGINT AS n, round(avg(score), 4)::DOUBLE AS avg_score, sum(CASE WHEN score >= 0.999 THEN 1 ELSE 0 END)::BIGINT AS perfect FROM s GROUP BY category""".replace("o_clerk", "o_custkey::VARCHAR"))
def ground_truth_scores(spark, sf_dir):
    """AGG-26, JOI-17, AGG-10: rows scored against a reference of three columns, by category; rows without an actual row score none."""
    o = _t(spark, sf_dir, "orders").withColumn("o_custkey", F.col("o_custkey").cast("string"))
    k, columns = F.col("o_orderkey"), ["o_orderstatus", "o_custkey", "o_orderpriority"]
    actual = o.where(k % 9 != 0).select(k, "o_orderstatus", F.when(k % 3 == 0, "").otherwise(F.col("o_custkey")).alias("o_custkey"), F.when(k % 4 == 0, "other").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))
    scores = reports.reference_score(reports.reference_diff(actual, o.select("o_orderkey", *columns), "o_orderkey", columns), "o_orderkey")
    return reports.ground_truth(scores.join(o.select("o_orderkey", F.col("o_orderpriority").alias("category")), "o_orderkey"), "category")


@query("""WITH k AS (SELECT p_partkey % 60 AS g, 'm' || p_partkey % 60 AS mpn, p_partkey AS ord, 'https://maker.example/p/' || p_partkey AS url FROM part), s AS (SELECT mpn, url, ord FROM k WHERE ord % 10 <> 0)
SELECT mpn, url, row_number() OVER (PARTITION BY mpn ORDER BY ord, url)::INT AS ord FROM s QUALIFY row_number() OVER (PARTITION BY mpn ORDER BY ord, url) <= 12""")
def remembered_urls(spark, sf_dir):
    """AGG-18, JOI-18: known urls remembered in two runs, gone ones forgotten, at most twelve a part: a top-k."""
    p = _t(spark, sf_dir, "part").select(F.concat(F.lit("m"), (F.col("p_partkey") % 60).cast("string")).alias("mpn"), F.concat(F.lit("https://maker.example/p/"), F.col("p_partkey").cast("string")).alias("url"), F.col("p_partkey").cast("bigint").alias("ord"))
    half = F.col("ord") < 500
    first = p.where(half & (F.col("ord") % 10 != 0))
    gone = p.where(F.col("ord") % 10 == 0)
    known = memory.forget(first.unionByName(gone.where(half)), gone)
    return memory.remember(known, p.where(~half & (F.col("ord") % 10 != 0))).select("mpn", "url", "ord")


@query(f"""WITH c AS (SELECT user_id AS mpn, event_id AS ord, event_type IN ({", ".join(f"'{x}'" for x in ("error", "signup"))}) AS search FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY mpn, search ORDER BY ord) AS k, count(*) FILTER (search) OVER (PARTITION BY mpn) AS ns, count(*) FILTER (NOT search) OVER (PARTITION BY mpn) AS np FROM c),
s AS (SELECT *, least(np, 8 - least(ns, 2)) AS p FROM r) SELECT mpn, ord FROM s WHERE CASE WHEN search THEN k <= 8 - p ELSE k <= p END""")
def fetch_windows(spark, sf_dir):
    """LIM-03: the first eight urls of a part, two places kept for searches: a top-k."""
    search = F.col("event_type").isin("error", "signup")
    c = _t(spark, sf_dir, "events").select(F.col("user_id").alias("mpn"), F.col("event_id").alias("ord"), F.when(search, F.lit("https://a.com/search?q=1")).otherwise(F.lit("https://a.com/p/1")).alias("url"))
    return delivery.first_fetches(c).select("mpn", "ord")


@query("""WITH n AS (SELECT s_suppkey, 'Maker' || s_suppkey AS name, s_suppkey % 4 AS items, CASE s_suppkey % 5 WHEN 0 THEN 'https://www.maker' || s_suppkey || '.com/product/AB' || s_suppkey WHEN 1 THEN 'https://www.other.com/product/AB' || s_suppkey WHEN 2 THEN 'https://maker' || s_suppkey || '.com/search?q=1'
  WHEN 3 THEN 'https://maker' || s_suppkey || '.com/appliance/x' ELSE '' END AS url FROM supplier)
SELECT name AS brand_key, regexp_replace(regexp_extract(url, '://([^/]*)', 1), '^www\\.', '') AS domain FROM n WHERE items >= 2 AND s_suppkey % 6 <> 0 AND s_suppkey % 5 IN (0, 3) AND (s_suppkey % 5 = 3 OR length('AB' || s_suppkey) >= 3)""")
def brand_proposals(spark, sf_dir):
    """SUP-24, AGG-25: official hosts proposed for brands without one."""
    n = F.col("s_suppkey")
    s = n.cast("string")
    url = F.when(n % 5 == 0, F.concat(F.lit("https://www.maker"), s, F.lit(".com/product/AB"), s)).when(n % 5 == 1, F.concat(F.lit("https://www.other.com/product/AB"), s)).when(n % 5 == 2, F.concat(F.lit("https://maker"), s, F.lit(".com/search?q=1"))).when(n % 5 == 3, F.concat(F.lit("https://maker"), s, F.lit(".com/appliance/x"))).otherwise("")
    name = F.concat(F.lit("Maker"), s)
    records = _t(spark, sf_dir, "supplier").select(name.alias("brand_key"), name.alias("brand_name"), F.lit("").alias("manufacturer_name"), (n % 6 == 0).alias("mapped"), (n % 4).alias("items"), F.concat(F.lit("AB"), s).alias("mpn"), url.alias("mfr_url"))
    return harvest.map_proposals(records).select("brand_key", "domain")


@query("""SELECT c_custkey FROM customer WHERE NOT (c_custkey % 3 = 0 AND c_custkey % 2 = 0)""")
def audit_pending(spark, sf_dir):
    """SUP-25: what a resumed audit still has to ask: rows without hosts so far."""
    c = _t(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("mpn"))
    done = c.where("mpn % 3 = 0").select("mpn", F.when(F.col("mpn") % 2 == 0, F.array(F.lit("h"))).otherwise(F.array().cast("array<string>")).alias("hosts"))
    return harvest.pending_audit(c, done).select("c_custkey")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'error' ELSE c_mktsegment END AS category_id, CASE WHEN c_custkey % 4 = 0 THEN 'review' ELSE 'high' END AS band FROM customer""")
def failed_rows(spark, sf_dir):
    """SUP-18: rows with an error go to review."""
    c = _t(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("category_id"), F.lit("high").alias("band"))
    return delivery.failed_row(c, F.when(F.col("c_custkey") % 4 == 0, F.lit("x")))
