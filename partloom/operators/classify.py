"""Taxonomy scoring and category routing, as expressions over the dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import ABRASIVE_TEMPLATES, FALLBACK, Dims
from ..functions.text import literal, text

APPLIANCE_BRANDS = ["Frigidaire", "Whirlpool", "GE", "KitchenAid", "LG", "Cafe", "Speed Queen", "Samsung", "Sharp", "Beko", "Element", "Amana", "Maytag"]
ABRASIVE_BRANDS = ["Diablo", "Mirka", "3M", "Milwaukee"]


def _leaf_sql(leaf: tuple) -> str:
    """Score of a leaf as SQL over ``x`` (d, low: the text; b, lowb: the brand; words: the brand's words): 2 + 0.05 per character
    of each keyword inside the text, 3 per pattern, brand bonuses; 0 without any of the former hits."""
    _, _, _, keywords, patterns, brands = leaf
    hits = [f"IF(contains(x.low, {literal(k.lower())}), {2.0 + len(k) * 0.05!r}D, 0D)" for k in keywords]
    hits += [f"IF(x.d RLIKE {literal('(?i)' + p)}, 3D, 0D)" for p in patterns]
    bonus = [f"IF(x.b <> '' AND x.lowb = {literal(b.lower())}, 2.5D, 0D) + IF(contains(x.low, {literal(b.lower())}), 1D, 0D)" for b in brands]
    if brands:
        bonus.append(f"IF(arrays_overlap(x.words, array({', '.join(literal(b.lower()) for b in brands)})), 1.5D, 0D)")
    total = " + ".join(hits) or "0D"
    return f"transform(array({total}), h -> IF(h > 0, h{''.join(' + ' + x for x in bonus)}, 0D))[0]"


def seen(desc: Column, brand: Column) -> Column:
    """What the tests of a row read, computed once; name it and hand the name on."""
    low = F.lower(brand)
    return F.struct(desc.alias("d"), F.lower(desc).alias("low"), brand.alias("b"), low.alias("lowb"), F.regexp_extract_all(low, F.lit("([a-z0-9]+)"), F.lit(1)).alias("words"))


def _over(column: str, body: str) -> Column:
    """``body`` over ``x``, one row's ``seen``.  It is one SQL text, parsed in a call, however many tests there are; inside a
    function over one element the tests are interpreted, instead of one method too large to compile."""
    return F.expr(f"transform(array(`{column}`), x -> {body})[0]")


def match_taxonomy(column: str, dims: Dims) -> Column:
    """``struct(score, neg, classpath, template_id, product_name)`` of the best leaf, the first one on ties; null under a score of
    2.  ``column`` names a column made by ``seen``."""
    rows = [f"named_struct('score', round({_leaf_sql(leaf)}, 6), 'neg', {-i}, 'classpath', {literal(leaf[0])}, 'template_id', {literal(leaf[1])}, 'product_name', {literal(leaf[2])})" for i, leaf in enumerate(dims.effective_leaves())]
    return _over(column, f"transform(array(array_max(array({', '.join(rows)}))), m -> IF(m.score >= 2D, m, NULL))[0]")


def confidence(score: Column) -> Column:
    return F.when(score.isNotNull(), F.least(F.lit(0.95), F.lit(0.35) + score * 0.08))


def _rule_sql(template: str, patterns: list[str], unless: str) -> str:
    any_case = lambda p: f"x.d RLIKE {literal('(?i)' + p)}"
    out = " OR ".join(f"{'x.low' if p.endswith('$') else 'x.d'} RLIKE {literal('(?i)' + p)}" for p in patterns) or "false"
    if unless:
        out = f"({out}) AND NOT {any_case(unless)}"
    brands = lambda names: f"x.b IN ({', '.join(map(literal, names))})"
    if template == "built_in_dishwasher":
        out = f"({out}) OR ({brands(APPLIANCE_BRANDS)} AND {any_case(chr(92) + 'bdishwasher' + chr(92) + 'b')})"
    if template == "ceiling_fan":
        out = f"IF({any_case('gilmour')} AND NOT {any_case('hunter')}, {any_case('fan')}, {out})"
    if template in ABRASIVE_TEMPLATES:
        size = r'\d+\s?(?:"|in)'
        out = f"({out}) OR ({brands(ABRASIVE_BRANDS)} AND x.d RLIKE {literal(size)} AND {any_case('disc|wheel|grit|sand|abrasive|cutoff|cut-off|stikit|abranet')})"
    return out


def first_rule(column: str, dims: Dims) -> Column:
    """Template of the first rule that the row fits, null without one."""
    if not dims.rules:
        return F.lit(None).cast("string")
    return _over(column, "CASE " + " ".join(f"WHEN {_rule_sql(*rule)} THEN {literal(rule[0])}" for rule in dims.rules) + " END")


def route(rows: DataFrame, dims: Dims, desc: str = "expanded_desc", brand: Column | None = None) -> DataFrame:
    """Adds taxonomy (struct or null), category_id, classpath and product_name."""
    b = text(brand if brand is not None else F.col("identity.brand_key"))
    staged = rows.withColumn("_seen", seen(text(desc), b))
    staged = staged.withColumns({"taxonomy": match_taxonomy("_seen", dims), "_rule": first_rule("_seen", dims)})
    sure = F.coalesce(F.col("taxonomy.score") >= 2.5, F.lit(False))
    category = F.when(sure, F.col("taxonomy.template_id")).otherwise(F.coalesce("_rule", F.lit(FALLBACK)))
    staged = staged.withColumn("category_id", category)
    own = sure | F.coalesce(F.col("_rule").isNotNull() & (F.col("taxonomy.template_id") == F.col("category_id")), F.lit(False))
    meta = F.create_map(*[x for k, (c, p) in dims.templates.items() for x in (F.lit(k), F.struct(F.lit(c).alias("classpath"), F.lit(p).alias("product_name")))])
    staged = staged.withColumn("_meta", F.try_element_at(meta, F.col("category_id")))
    return staged.withColumns({k: F.when(own, F.col(f"taxonomy.{k}")).otherwise(F.col(f"_meta.{k}")) for k in ("classpath", "product_name")}).drop("_rule", "_meta", "_seen")


#: fixed values: the first of these hints that a foreign leaf name holds gives its template
LEAF_HINTS = [("dishwasher", "built_in_dishwasher"), ("range", "cooking_range"), ("ceiling fan", "ceiling_fan"), ("cut-off", "metal_cutoff_disc"), ("grinding", "grinding_wheel"), ("sanding", "sanding_abrasive"), ("deck", "deck_composite"), ("coupling", "pipe_fitting"), ("pipe", "pipe_fitting"), ("wire", "wire_cable"), ("cable", "wire_cable"), ("led", "led_lighting"), ("light", "led_lighting"), ("box", "electrical_box"), ("trim", "building_trim"), ("drill", "power_tool_accessory"), ("tool", "power_tool_accessory")]


def template_of(name: Column) -> Column:
    """Template of a foreign leaf name: the first of ``LEAF_HINTS`` that it contains."""
    low = F.lower(text(name))
    out = None
    for hint, template in LEAF_HINTS:
        out = F.when(F.contains(low, F.lit(hint)), F.lit(template)) if out is None else out.when(F.contains(low, F.lit(hint)), F.lit(template))
    return out.otherwise(F.lit(FALLBACK))
