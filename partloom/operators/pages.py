"""Page tests and evidence from HTML.

Regular expressions over the page text stay in the JVM.  Only the extraction of labelled pairs, links and embedded JSON
parses markup; it runs in Arrow batches over pages that passed the tests, and its output is filtered in SQL."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import page_text, squash, text, visible
from ..functions.units import is_hex_colour, split_tail
from .evidence import ITEM, fold, item

CAP_HEAD, CAP_TAIL = 320_000, 80_000
MAX_PAIRS = 80
#: fixed values
SKIP_LABELS = ["cart", "menu", "search", "account", "sign in", "log in", "login", "email", "password", "cookie", "subscribe", "follow", "share", "qty", "price", "compare", "wishlist", "language", "currency", "shop", "home", "filter", "sort", "availability", "shipping", "item", "id", "url", "image", "description", "name", "title", "brand", "category", "town_name", "city", "state", "zip", "postal", "address", "phone", "hours", "latitude", "longitude", "sep", "viewport", "site_name", "state_name", "country_name", "og:title"]
SKIP_VALUES = ["", "-", "--", "n/a", "na", "none", "select", "choose", "learn more", "click here", "view", "yes/no", "true", "false", "null"]
PRIORITY = ["pack quantity", "pack qty", "package quantity", "gtin", "upc", "ean", "unspsc", "application", "includes", "with", "prop 65", "proposition 65", "country of origin", "weight", "net weight", "warranty", "diameter", "wheel diameter", "arbor size", "thickness", "maximum rpm", "grit", "length", "height", "width", "volume"]
#: fixed values: (field, pattern, unit, confidence)
SPECS = [
    ("Series", "(Professional Series|Eco Series|Gallery Series|Profile Series)", "", 0.8), ("Number of Wash Cycles", r"(\d+)\s*Wash Cycles", "", 0.8),
    ("Voltage Rating", r"(?:Voltage Rating|120\s*Volts?|Amps @ 120 Volts)[^\d]*(\d{2,3})", "V", 0.85), ("Amperage Rating", r"(?:Amperage Rating|Amps @ 120 Volts)[^\d]*(\d{1,2})\s*A", "A", 0.85),
    ("Mounting Type", r"(?:Mounting Type|Mounting)\s*[:\-]?\s*(Leg|Built[- ]in)", "", 0.8), ("Sound Level", r"(\d{2})\s*dBA", "dBA", 0.85), ("Material", "(Stainless Steel|Aluminum|Plastic)", "", 0.75),
    ("Color", r"(?:Color|Finish)\s*[:\-]?\s*(Stainless Steel|Black|White|Silver)", "", 0.75), ("Wattage", r"(?:Wattage|Power)\s*[:\-]?\s*(\d+(?:\.\d+)?)\s*(?:[Ww]atts?\b|W\b)?", "W", 0.75),
    ("Diameter", r'Diameter\s*[:\-]?\s*(\d+(?:\.\d+)?)\s*(?:"|in)?', "in", 0.82), ("Arbor Size", r'Arbor Size\s*[:\-]?\s*(\d+(?:\s*/\s*\d+|\.\d+)?)\s*(?:in|")?', "in", 0.82),
    ("Maximum RPM", r"(?:Maximum RPM|Max\.? RPM)\s*[:\-]?\s*([\d,]+)", "RPM", 0.8), ("Thickness", r'Thickness\s*[:\-]?\s*(\d?\.\d+)\s*(?:in|")?', "in", 0.8),
    ("Pack Quantity", r"(?:Pack Quantity|Pack Qty|Package Quantity|Pieces Per Pack)\s*[:\-]?\s*(\d+)", "", 0.82), ("Pack Quantity", r"Pack of\s*(\d+)", "", 0.78),
    ("Country Of Origin", r"Country Of Origin\s*[:\-]?\s*([A-Za-z][A-Za-z ]{2,40})", "", 0.75), ("GTIN", r"\bGTIN(?:-1[34])?\s*[:\-]?\s*(\d{8,14})", "", 0.82), ("UPC", r"\bUPC(?:A|[- ]A)?\s*[:\-]?\s*(\d{8,14})", "", 0.8),
    ("EAN", r"\bEAN(?:-1[38])?\s*[:\-]?\s*(\d{8,14})", "", 0.8), ("UNSPSC", r"\bUNSPSC\s*[:\-]?\s*(\d{6,10})", "", 0.8), ("Application", r"Application\s*[:\-]\s*([A-Za-z][^\n|]{2,60})", "", 0.78),
    ("Weight", r"(?:Net Weight|Item Weight|Product Weight)\s*[:\-]?\s*(\d+(?:\.\d+)?)\s*(?:lb|lbs|kg|oz)?", "", 0.75), ("Fuel Type", r"Fuel Type\s*[:\-]?\s*(Electric|Gas|Dual Fuel)", "", 0.7),
]


def page_title(html: Column | str) -> Column:
    return squash(F.regexp_extract(F.substring(text(html), 1, 6000), r"(?is)<title[^>]*>(.*?)</title>", 1))


def is_error_html(html: Column | str) -> Column:
    low = F.lower(page_title(html))
    out = F.lit(False)
    for token in ("404", "not found", "page not found", "error 404", "doesn't exist", "does not exist"):
        out = out | F.contains(low, F.lit(token))
    return out


def is_not_found(status: Column, html: Column | str, url: Column | str) -> Column:
    return urls.is_error(url) | status.isin(404, 410) | (status.between(200, 399) & is_error_html(html))


def is_usable(status: Column, html: Column | str, url: Column | str | None = None, titles: bool = True) -> Column:
    """A page with a good status and a body.  Its title may not tell of a missing page, nor may its url; without ``titles`` or a
    ``url``, for pages that were read whatever these look like, they do not count."""
    missing = (is_error_html(html) if titles else F.lit(False)) | (urls.is_error(url) if url is not None else F.lit(False))
    return status.between(200, 399) & (squash(html) != "") & ~missing


def is_empty_search(html: Column | str) -> Column:
    return F.substring(visible(html), 1, 8000).rlike("(?i)0 results|no results found|no products found|did not match any|no matches")


def is_pdf_body(html: Column | str) -> Column:
    t = text(html)
    return F.ltrim(t).startswith("%PDF") | (F.length(F.substring(t, 1, 64)) - F.length(F.translate(F.substring(t, 1, 64), "\x00", "")) >= 2)


def is_js_shell(html: Column | str) -> Column:
    t = text(html)
    low = F.lower(t)
    return (F.length(t) >= 12000) & ~low.rlike("""id=["']__next_data__["']""") & (F.regexp_count(low, F.lit("<script")) >= 8) & (F.length(squash(visible(t))) < 500)


def is_challenge(status: Column, html: Column | str) -> Column:
    low = F.lower(F.substring(text(html), 1, 12000))
    return status.isin(202, 403, 429, 503) | (squash(html) == "") | low.rlike("captcha|are you a robot|unusual traffic|verify you are human|challenge-platform")


def capped(html: Column | str) -> Column:
    """The head and tail of very long pages, as the fixed input window of the extractors."""
    t = text(html)
    return F.when(F.length(t) > CAP_HEAD + CAP_TAIL, F.concat(F.substring(t, 1, CAP_HEAD), F.substring(t, -CAP_TAIL, CAP_TAIL))).otherwise(t)


def spec_items(page: Column, url: Column) -> Column:
    """First match of every pattern in the page text."""
    none = F.array().cast(f"array<{ITEM}>")
    found = []
    for field, pattern, unit, confidence in SPECS:
        value = F.trim(F.regexp_extract(page, f"(?i){pattern}", 1))
        if field == "Mounting Type":
            value = F.when(F.translate(F.lower(value), "-", " ") == "built in", F.lit("Built-in")).when(F.lower(value) == "leg", F.lit("Leg")).otherwise(value)
        quote = F.substring(F.regexp_extract(page, f"(?i){pattern}", 0), 1, 180)
        found.append(F.when(value != "", F.array(item(field, value, unit, url, quote, "html_regex", confidence))).otherwise(none))
    return fold(F.concat(none, *found))


def approvals(page: Column) -> Column:
    return F.array_join(F.array_distinct(F.regexp_extract_all(page, F.lit(r"(?i)(ASSE \d+|CEE Tier \d+ Qualified|cUL Listed|ENERGY STAR Certified|NSF Certified|UL Listed)"), F.lit(1))), "|")


def warranty(page: Column) -> Column:
    strict = F.regexp_extract(page, r"(?i)(\d+\s*Year\s+Manufacturer,\s*\d+\s*Year\s+Labor and Parts)", 1)
    loose = F.trim(F.regexp_extract(page, r"(?i)Warranty\s*[:\-]\s*((?:\d+\s*[- ]?Year|Limited Lifetime)[^\n.]{0,40})", 1))
    return F.when(strict != "", strict).when(loose.rlike("(?i)register|portal|login|click here"), F.lit("")).otherwise(loose)


def marketing(html: Column | str) -> Column:
    """The meta description if over 40 characters, else the first paragraph over 60."""
    t = F.substring(text(html), 1, 80_000)
    meta = squash(F.regexp_extract(t, r"""(?is)<meta[^>]*name=["']description["'][^>]*content=["']([^"']*)["']""", 1))
    ps = F.transform(F.regexp_extract_all(t, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1)), lambda p: squash(visible(p)))
    return F.when(F.length(meta) > 40, meta).otherwise(F.coalesce(F.get(F.filter(ps, lambda p: F.length(p) > 60), F.lit(0)), F.lit("")))


def feature_lines(html: Column | str, tokens: list[str]) -> Column:
    """Up to 20 distinct lines of list items and paragraphs of 8 to 120 characters that hold one of the tokens."""
    lines = F.transform(F.regexp_extract_all(capped(html), F.lit(r"(?is)<(?:li|p|span)\b[^>]*>(.*?)</(?:li|p|span)>"), F.lit(1)), lambda x: squash(visible(x)))
    pattern = "(?i)" + "|".join(re.escape(t) for t in tokens)
    return F.slice(F.array_distinct(F.filter(lines, lambda x: F.length(x).between(8, 120) & x.rlike(pattern))), 1, 20)


def hrefs(html: Column | str) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(text(html), F.lit(r"""(?is)<a\b[^>]*href=["']([^"'#][^"']*)["']"""), F.lit(1)), lambda h: h != ""))


def absolute(href: Column, base: Column) -> Column:
    """A link resolved against its page (no ``..`` handling)."""
    origin = F.regexp_extract(base, "^([A-Za-z]+://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_extract(base, "^([^?#]*)", 1), r"(?<=[^/:]/)[^/]*$|(?<=[^/])$", "")
    return F.when(href.rlike("(?i)^https?://"), href).when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/"), F.concat(origin, href)).otherwise(F.concat(folder, F.when(folder.endswith("/"), F.lit("")).otherwise(F.lit("/")), href))


def pdf_links(html: Column | str, base: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(hrefs(html), urls.is_pdf), lambda h: absolute(h, base)))


def usable_pair(label: Column, value: Column) -> Column:
    key, low = F.lower(F.trim(label)), F.lower(value)
    compact = F.replace(value, F.lit(","), F.lit(""))
    bad_size = (key == "size") & compact.rlike("^[0-9]+$") & ~F.coalesce(compact.try_cast("bigint").between(8, 96), F.lit(False))
    junk = value.rlike(r"(?i)https?://|\{\{|\}\}|attributevalue") | is_hex_colour(F.trim(value)) | (value.rlike("(?i)with more than") & (key == "with"))
    return (F.length(label) >= 2) & (value != "") & ~key.isin(SKIP_LABELS) & ~low.isin(SKIP_VALUES) & (low != key) & ~junk & ~bad_size & (F.size(F.split(label, r"\s+")) <= 8) & label.rlike("[A-Za-z]")


class _Pairs(HTMLParser):
    """(label, value) pairs of definition lists, two- and three-cell table rows and ``Label: value`` lines."""

    QUIET = {"script", "style", "noscript", "nav", "footer", "header", "form", "head"}
    LINES = {"li", "p", "div", "span"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pairs: list[tuple[str, str]] = []
        self.quiet = 0
        self.cells: list[str] | None = None
        self.label: str | None = None
        self.parts: list[str] = []

    def _take(self) -> str:
        out = " ".join("".join(self.parts).split())
        self.parts = []
        return out

    def handle_starttag(self, tag, attrs):
        if tag in self.QUIET:
            self.quiet += 1
        elif tag == "tr":
            self.cells = []
            self.parts = []
        elif tag in ("td", "th", "dt", "dd"):
            self.parts = []
        elif tag in self.LINES or tag == "br":
            self._line()

    def handle_endtag(self, tag):
        if tag in self.QUIET:
            self.quiet = max(0, self.quiet - 1)
        elif tag in ("td", "th") and self.cells is not None:
            self.cells.append(self._take())
        elif tag == "tr":
            if self.cells and 2 <= len(self.cells) <= 3:
                self.pairs.append((self.cells[0], self.cells[1]))
            self.cells = None
        elif tag == "dt":
            self.label = self._take()
        elif tag == "dd" and self.label is not None:
            self.pairs.append((self.label, self._take()))
            self.label = None
        elif tag in self.LINES:
            self._line()

    def _line(self) -> None:
        if self.cells is None:
            line = self._take()
            m = re.fullmatch(r"\s*([A-Za-z][A-Za-z0-9][A-Za-z0-9 /&+\-]{0,42})\s*[:\-–|]\s+(.{1,80}?)\s*", line)
            if m:
                self.pairs.append((m[1], m[2]))

    def handle_data(self, data):
        if not self.quiet:
            self.parts.append(data)


def _walk(node, out: list[tuple[str, str]]) -> None:
    """Name/value pairs and scalar members of nested JSON, however deep."""
    open_ = [iter([(None, node)])]
    while open_:
        for k, v in open_[-1]:
            if isinstance(v, dict):
                name = v.get("name") or v.get("label") or v.get("key")
                value = v.get("value")
                if isinstance(name, str) and isinstance(value, str | int | float) and not isinstance(value, bool):
                    out.append((name, str(value)))
                open_.append(iter(v.items()))
                break
            if isinstance(v, list):
                open_.append(iter([(None, x) for x in v]))
                break
            if k is not None and isinstance(v, str | int | float) and not isinstance(v, bool) and not str(k).startswith("@") and k not in ("name", "label", "key", "value", "url", "image"):
                out.append((str(k), str(v)))
        else:
            open_.pop()


_LD = re.compile(r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>""")
_STATE = [
    re.compile(r"""(?is)<script[^>]*id=["']__NEXT_DATA__["'][^>]*>(.*?)</script>"""), re.compile(r"""(?is)<script[^>]*type=["']application/json["'][^>]*>(.*?)</script>"""),
    re.compile(r"(?is)window\.__NUXT__\s*=\s*(\{.*?\})\s*;?\s*</script>"), re.compile(r"(?is)window\.(?:__INITIAL_STATE__|__PRELOADED_STATE__)\s*=\s*(\{.*?\})\s*;?\s*(?:window|</script>)"),
]
MAX_BLOBS, BLOB_CHARS = 8, 2_000_000


def _loads(blob: str):
    try:
        return json.loads(blob, strict=False)
    except (ValueError, RecursionError):
        return None


def json_pairs(html: str) -> list[tuple[str, str]]:
    """Pairs of all JSON-LD and of the first eight blobs of page state that parse, of at most 2 MB each."""
    out: list[tuple[str, str]] = []
    for m in _LD.finditer(html):
        _walk(_loads(m[1]), out)
    seen: set[int] = set()
    for pattern in _STATE:
        for m in pattern.finditer(html):
            if len(seen) < MAX_BLOBS and m.start(1) not in seen and len(m[1].strip()) <= BLOB_CHARS and (node := _loads(m[1])) is not None:
                seen.add(m.start(1))
                _walk(node, out)
    return out


class _Items(HTMLParser):
    """Microdata items as nested members, and the properties of meta tags."""

    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
    IMPLIED = {"li", "p", "td", "th", "tr", "dt", "dd", "option"}
    QUIET = {"script", "style", "noscript"}
    VALUES = {"meta": "content", "a": "href", "area": "href", "link": "href", "img": "src", "source": "src", "embed": "src", "iframe": "src", "audio": "src", "video": "src", "track": "src", "object": "data", "data": "value", "meter": "value", "time": "datetime"}
    #: fixed values: schema types whose members are not the product's
    OTHERS = {"localbusiness", "store", "place", "postaladdress", "geocoordinates", "geo", "imageobject"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.metas: list[tuple[str, str]] = []
        self.open: list[tuple[str, dict | None, tuple[dict, list[str], list[str]] | None]] = []

    @staticmethod
    def _add(to: dict, names: list[str], value) -> None:
        for name in names:
            to[name] = value if name not in to else [*(to[name] if isinstance(to[name], list) else [to[name]]), value]

    def _close(self, n: int) -> None:
        while len(self.open) > n:
            _, _, held = self.open.pop()
            if held:
                self._add(held[0], held[1], " ".join("".join(held[2]).split()))

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta" and a.get("property") and a.get("content"):
            self.metas.append((a["property"], a["content"]))
        if tag in self.IMPLIED and self.open and self.open[-1][0] == tag:
            self._close(len(self.open) - 1)
        names = a.get("itemprop", "").split()
        now = next((x for _, x, _ in reversed(self.open) if x is not None), None)
        item_ = held = None
        if "itemscope" in a:
            item_ = {"@type": a.get("itemtype", "")}
            if names and now is not None:
                self._add(now, names, item_)
            else:
                self.items.append(item_)
        elif names and now is not None:
            value = a.get("content", a.get(self.VALUES.get(tag, "content")))
            if value is not None:
                self._add(now, names, " ".join(value.split()))
            elif tag not in self.VOID:
                held = (now, names, [])
        if tag not in self.VOID:
            self.open.append((tag, item_, held))

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is not None:
            self._close(at)

    def handle_data(self, data):
        if self.open and self.open[-1][0] not in self.QUIET:
            for _, _, held in self.open:
                if held:
                    held[2].append(data)

    def close(self):
        super().close()
        self._close(0)


def _products(node: dict) -> dict:
    """An item without members that are items of other types; every repeated value is a member of its own."""
    out: dict = {}
    for k, v in node.items():
        for i, x in enumerate(v if isinstance(v, list) else [v]):
            if isinstance(x, dict):
                if not any(o in x["@type"].lower().rsplit("/", 1)[-1] for o in _Items.OTHERS):
                    out[k, i] = _products(x)
            elif i:
                out[k, i] = {k: x}
            else:
                out[k] = x
    return out


_META = re.compile(r"""(?is)<meta\b(?:[^>"']|"[^"]*"|'[^']*')*>""")
MICRODATA_CHARS = 350_000
#: fixed values: parts of meta properties that describe the page or its media
MEDIA = {"image", "video", "audio", "type", "locale", "determiner", "fb", "al", "twitter"}


def _parsed(html: str) -> _Items:
    parser = _Items()
    try:
        parser.feed(html)
        parser.close()
    except (AssertionError, ValueError):
        pass
    return parser


def opengraph_pairs(html: str) -> list[tuple[str, str]]:
    """(last part of the property, content) of ``og:`` and other prefixed meta properties."""
    out = []
    for name, value in _parsed("".join(_META.findall(html))).metas:
        parts = name.lower().split(":")
        if len(parts) > 1 and not any(x in MEDIA or x in SKIP_LABELS for x in parts):
            out.append((parts[-1].replace("_", " "), value))
    return out


def microdata_pairs(html: str) -> list[tuple[str, str]]:
    """Pairs of ``itemprop`` members in pages of less than 350 000 characters."""
    out: list[tuple[str, str]] = []
    if len(html) < MICRODATA_CHARS and "itemscope" in html.lower():
        _walk(_products({"": _parsed(html).items}), out)
    return out


def _cap(html: str) -> str:
    return html[:CAP_HEAD] + html[-CAP_TAIL:] if len(html) > CAP_HEAD + CAP_TAIL else html


def html_pairs(html: str) -> list[tuple[str, str]]:
    parser = _Pairs()
    try:
        parser.feed(html)
        parser.close()
    except (AssertionError, ValueError):
        pass
    return parser.pairs


def labelled_pairs(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``(key, ord, kind, label, value)`` of every pair that may be published: labels of high priority first, one per
    label, at most 80 a page from markup; markup is read in the capped page, embedded JSON and OpenGraph in the
    whole, microdata in pages of less than 350 000 characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            rows: tuple[list, ...] = ([], [], [], [], [])
            for i, page in enumerate(batch.column(1).to_pylist()):
                page = page or ""
                kinds = [("html", html_pairs(_cap(page))), ("json", json_pairs(page)), ("opengraph", opengraph_pairs(page)), ("microdata", microdata_pairs(page))]
                found = [(kind, a, b) for kind, some in kinds for a, b in some]
                for n, (kind, a, b) in enumerate(found):
                    for column, v in zip(rows, (i, n, kind, a, b), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(r, pa.string()) for r in rows[2:])], names=[key, "ord", "kind", "label", "value"])

    kind = pages.schema[key].dataType.simpleString()
    raw = pages.where(~is_pdf_body(html)).select(key, text(html).alias(html)).mapInArrow(run, f"{key} {kind}, ord int, kind string, label string, value string")
    clean = raw.select(key, "ord", "kind", F.substring(F.regexp_replace(squash("label"), ":+$", ""), 1, 48).alias("label"), F.substring(squash("value"), 1, 80).alias("value"))
    good = clean.where(usable_pair(F.col("label"), F.col("value"))).withColumn("_k", F.lower(F.trim("label")))
    rank = F.struct(F.when(F.col("_k").isin(PRIORITY), 0).otherwise(1).alias("p"), "ord")
    first = good.groupBy(key, F.when(F.col("kind") == "html", 0).otherwise(1).alias("_m"), "_k").agg(F.min(F.struct(rank.alias("r"), "kind", "label", "value", "_k")).alias("s"))  # partial; one row per page, source and label
    both = first.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.when(F.col("_m") == 0, F.col("s")))), 1, MAX_PAIRS).alias("html"), F.collect_list(F.when(F.col("_m") == 1, F.col("s"))).alias("more"))
    named = both.withColumn("_known", F.transform("html", lambda x: x["_k"]))
    numbered = named.select(key, F.array_sort(F.concat("html", F.filter("more", lambda x: ~F.array_contains("_known", x["_k"])))).alias("l"))
    return numbered.select(key, F.posexplode("l").alias("ord", "s")).select(key, "ord", "s.kind", "s.label", "s.value")


def pair_items(label: Column, value: Column, url: Column) -> Column:
    split = split_tail(value)
    return item(label, split["value"], split["uom"], url, F.concat_ws(": ", label, value), "labeled_html", 0.8)


def mine_tokens(texts: DataFrame, column: str, least: int = 3, top: int = 80) -> DataFrame:
    """The most frequent upper-case tokens: a top-k report."""
    tokens = texts.select(F.explode(F.regexp_extract_all(text(column), F.lit(r"(?U)\b([A-Z][A-Z0-9/#]{1,6})\b"), F.lit(1))).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "token").limit(top)


def page_evidence(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: items (patterns first, then labelled pairs), approvals, warranty, marketing."""
    seen = pages.where(~is_pdf_body(html)).withColumn("_page", page_text(capped(html)))
    base = seen.select(key, url, spec_items(F.col("_page"), F.col(url)).alias("_specs"), approvals(F.col("_page")).alias("approvals"), warranty(F.col("_page")).alias("warranty"), marketing(html).alias("marketing"))
    pairs = labelled_pairs(pages, key, html).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "label", "value"))).alias("_pairs"))
    met = base.join(pairs, key, "left")
    more = F.transform(F.coalesce("_pairs", F.array().cast("array<struct<ord:int,label:string,value:string>>")), lambda p: pair_items(p["label"], p["value"], F.col(url)))
    return met.select(key, url, fold(F.concat("_specs", more)).alias("items"), "approvals", "warranty", "marketing")


#: fixed values: words of specification pages, two points each, and tokens, one point each
SPEC_WORDS = ["specification", "electrical", "dimensions", "product data", "technical", "ratings"]
SPEC_TOKENS = ["120 v", "voltage", "amperage", "dba", "inches", "in.", "mounting"]


def spec_page_score(page: Column | str) -> Column:
    low = F.lower(text(page))
    score = F.lit(0)
    for words, points in ((SPEC_WORDS, 2), (SPEC_TOKENS, 1)):
        for w in words:
            score = score + F.when(F.contains(low, F.lit(w)), points).otherwise(0)
    return score


def spec_pages(pages: DataFrame, key: str = "doc", number: str = "page", body: str = "text", top: int = 8, rest: int = 5) -> DataFrame:
    """Pages of a document that give its data: the ``top`` best scored, later pages first among equals; of a document without any
    scored page the first ``rest``.  A top-k per document."""
    scored = pages.withColumn("score", spec_page_score(body))
    w = Window.partitionBy(key)
    placed = scored.withColumn("_best", F.max("score").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), F.when(F.col("score") > 0, -F.col(number)).otherwise(F.col(number)))))
    return placed.where(((F.col("_best") > 0) & (F.col("score") > 0) & (F.col("rank") <= top)) | ((F.col("_best") == 0) & (F.col("rank") <= rest))).drop("_best")


#: fixed values: members of a model's answer and the fields they name
MODEL_FIELDS = {"product_type": "Product Type", "size": "Size", "material": "Material", "finish": "Finish", "color": "Color", "application": "Application"}


def model_items(answer: Column | str, desc: Column | str, fields: dict[str, str] | None = None) -> Column:
    """Items of a model's JSON answer (fenced or not), each at 0.58; an answer that is no JSON gives none."""
    body = F.regexp_replace(F.regexp_replace(F.trim(text(answer)), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    known = fields or MODEL_FIELDS
    values = F.array(*[F.trim(F.coalesce(F.get_json_object(body, f"$.{k}"), F.lit(""))) for k in known])
    names = F.array(*map(F.lit, known.values()))
    made = F.zip_with(names, values, lambda f, v: item(f, v, url=F.lit("llm:inference"), quote=F.substring(text(desc), 1, 120), extractor="llm_fallback", confidence=0.58))
    return F.filter(made, lambda x: x["value"] != "")
