"""Row validation and confidence bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import LOV
from ..functions import urls
from ..functions.text import text, texts
from ..functions.units import mounting

CONSTRAINED = ["Mounting Type", "Plug Type", "Color Temperature"]


def _issue(field: Column | str, message: Column | str, severity: str) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(field).alias("field"), lit(message).alias("message"), F.lit(severity).alias("severity"))


def _when(condition: Column, issue: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), issue)


def slot_issues(slots: Column, category: Column, lov: dict = LOV, reference: dict[str, list[str]] | None = None) -> Column:
    """Issues of every slot, in slot order."""
    at = lambda kind, i: F.concat(F.lit(f"ATTRIBUTE_{kind} "), (i + 1).cast("string"))

    def allowed(label: str) -> Column:
        extra = (reference or {}).get(label, [])
        out = texts(extra) if extra else F.array().cast("array<string>")
        cases = None
        for cat, labels in lov.items():
            if label in labels:
                own = texts([*labels[label], *extra])
                cases = F.when(category == cat, own) if cases is None else cases.when(category == cat, own)
        return out if cases is None else cases.otherwise(out)

    def of(s: Column, i: Column) -> Column:
        label, value, uom = s["label"], s["value"], s["uom"]
        made = [_when((value != "") & (label == ""), _issue(at("VALUE", i), "value without label", "error"))]
        for name in CONSTRAINED:
            ok = allowed(name)
            seen = mounting(value) if name == "Mounting Type" else value
            bad = (label == name) & (value != "") & (F.size(ok) > 0) & ~F.array_contains(ok, seen) & ~F.array_contains(ok, value)
            made.append(_when(bad, _issue(at("VALUE", i), F.concat(F.lit(f"{name} '"), value, F.lit("' not in LOV")), "warning")))
        has = lambda c: F.contains(value, F.lit(c))
        made.append(_when((label == "Voltage Rating") & has("A") & ~has("V"), _issue(at("VALUE", i), "voltage field looks like amperage", "error")))
        made.append(_when((label == "Voltage Rating") & (value != "") & (uom != "") & ~F.upper(uom).isin("V", "VAC", "VOLTS"), _issue(at("UOM", i), "unexpected voltage unit", "warning")))
        made.append(_when((label == "Amperage Rating") & has("V") & ~has("A"), _issue(at("VALUE", i), "amperage field looks like voltage", "error")))
        return F.filter(F.array(*made), lambda x: x.isNotNull())

    return F.flatten(F.transform(slots, of))


def issues(row: dict[str, Column], slots: Column, category: Column, lov: dict = LOV, reference: dict[str, list[str]] | None = None, hosts: urls.HostLists = urls.BUILT_IN) -> Column:
    """All issues of a row, in the order of the rules.  ``row`` maps delivery columns to expressions."""
    get = lambda k: text(row[k]) if k in row else F.lit("")
    n = F.length(get("MOBILE_DESC"))
    head = [
        _when(F.length(get("INVOICE_DESC")) > 40, _issue("INVOICE_DESC", "exceeds 40 characters", "error")),
        _when((n > 0) & (n < 60), _issue("MOBILE_DESC", "below 60 characters", "warning")),
        _when(n > 80, _issue("MOBILE_DESC", "exceeds 80 characters", "error")),
        _when(F.length(get("SHORT_DESC")) > 240, _issue("SHORT_DESC", "exceeds recommended length", "warning")),
    ]
    filled = F.exists(slots, lambda s: s["value"] != "")
    tail = [_when(urls.is_blocked(get(c), hosts), _issue(c, "blocked ecommerce source URL", "error")) for c in ["MFR URL", *[f"Ref URL {i}" for i in range(1, 6)]] if c in row]
    product = get("Product Name") != ""
    tail.append(_when(product & (get("Classpath") == ""), _issue("Classpath", "taxonomy missing for enriched product", "warning")))
    tail.append(_when(~filled, F.when(category == "built_in_dishwasher", _issue("attributes", "no dishwasher attributes populated", "warning")).otherwise(_issue("attributes", "no attributes populated from evidence", "warning"))))
    tail += [_when(product & (F.trim(get(c)) == ""), _issue(c, "required description is empty", "error")) for c in ("MOBILE_DESC", "SHORT_DESC", "LONG_DESC1")]
    some = lambda xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    return F.concat(some(head), slot_issues(slots, category, lov, reference), some(tail))


def band(identity: Column, verified: Column) -> Column:
    """review, low, medium or high from the identity's confidence and the number of verified items."""
    return (
        F.when(identity < 0.4, F.lit("review")).when((verified >= 5) & (identity >= 0.7), F.lit("high")).when((verified >= 3) & (identity >= 0.6), F.lit("high"))
        .when(verified >= 2, F.lit("medium")).when((verified >= 1) & (identity >= 0.5), F.lit("medium")).when(verified >= 1, F.lit("low")).otherwise(F.lit("review"))
    )
