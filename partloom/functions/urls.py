"""URL and host functions, as column builders over strings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import DISTRIBUTOR, NOISE, PATH_MARKERS, SHOPPING, Dims
from .text import let, strip, text, texts

#: fixed values: (path hint, score) of official pages
HINTS = [("learnwhirlpool.com/smartsearchresults", 95), ("/en/p/owner-center", 92), ("owner-center/product-support", 90), ("gea-specs", 88), ("smartsearchresults", 85), ("owner-center", 80), ("/appliance/", 65), ("/manuals/", 55), ("product-support", 45), ("support.", 40)]
#: fixed values: words of catalogue paths, and query keys of searches
CATALOG_SEGMENTS = ["p", "product", "products", "item", "items", "appliance", "support", "product-support", "manuals", "documents", "spec", "specs", "specsheet", "specsheets", "gea-specs", "smartsearchresults", "html", "content", "dam", "global", "details", "catalog", "pdp", "sku", "part", "literature", "resources"]
SEARCH_KEYS = ["q", "query", "search", "searchtext", "searchterm", "term", "sku"]


@dataclass(frozen=True)
class HostLists:
    """Labels of hosts that sell, that are never a source and that distribute, and the domains allowed beside a maker's own."""

    shopping: tuple[str, ...] = tuple(SHOPPING)
    noise: tuple[str, ...] = tuple(NOISE)
    distributor: tuple[str, ...] = tuple(DISTRIBUTOR)
    third_party: tuple[str, ...] = ("energystar.gov",)
    distributors: tuple[str, ...] = ("grainger.com", "mscdirect.com")

    @classmethod
    def of(cls, dims: Dims) -> HostLists:
        """The user's dictionaries; template tables that are empty leave the built-in domains."""
        third, sellers = tuple(dims.third_party) or cls.third_party, tuple(dims.distributor_templates) or cls.distributors
        return cls(tuple(dims.shopping), tuple(dims.noise), tuple(dims.distributor), third, sellers)


BUILT_IN = HostLists()


def _with_scheme(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("https://"), url))


def netloc(url: Column | str) -> Column:
    """Authority of a url with a scheme, lower case; '' without one."""
    return F.lower(F.regexp_extract(strip(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def host(url: Column | str) -> Column:
    """Host without user, port and ``www.``; a missing scheme is allowed."""
    raw = strip(url)
    name = F.lower(F.regexp_extract(_with_scheme(raw), r"://([^/?#]*)", 1))
    name = F.regexp_replace(F.regexp_replace(name, "^.*@", ""), ":.*$", "")
    return F.when(raw == "", F.lit("")).otherwise(F.regexp_replace(name, r"^www\.", ""))


def path(url: Column | str) -> Column:
    return F.regexp_extract(_with_scheme(strip(url)), r"://[^/?#]*([^?#]*)", 1)


def query(url: Column | str) -> Column:
    return F.regexp_extract(strip(url), r"^[^?#]*\?([^#]*)", 1)


def labels(url: Column | str) -> Column:
    return F.filter(F.split(host(url), r"\."), lambda x: x != "")


def _any(x: Column, tokens: list[str]) -> Column:
    out = F.lit(False)
    for t in tokens:
        out = out | F.contains(x, F.lit(t))
    return out


def has_label(url: Column | str, names: list[str]) -> Column:
    return F.arrays_overlap(labels(url), texts(names)) if names else F.lit(False)


def is_noise(url: Column | str, hosts: HostLists = BUILT_IN) -> Column:
    return _any(F.lower(text(url)), PATH_MARKERS) | has_label(url, [*hosts.shopping, *hosts.noise])


def is_dealer(url: Column | str) -> Column:
    p = F.lower(path(url))
    return (host(url) != "") & (F.contains(p, F.lit("/appliances/")) | F.regexp_replace(p, "/+$", "").endswith("/appliances") | has_label(url, ["appliance", "appliances"]))


def is_blocked(url: Column | str, hosts: HostLists = BUILT_IN) -> Column:
    return (text(url) != "") & (is_noise(url, hosts) | is_dealer(url))


def is_distributor(url: Column | str, hosts: HostLists = BUILT_IN) -> Column:
    return (host(url) != "") & ~is_blocked(url, hosts) & has_label(url, hosts.distributor)


def is_search(url: Column | str) -> Column:
    low = F.lower(text(url))
    return _any(low, ["search?", "search.html", "/search/", "smartsearchresults"]) | (F.contains(host(url), F.lit("icecat.")) & _any(low, ["?q=", "keyword="]))


def is_pdf(url: Column | str) -> Column:
    return F.lower(path(url)).endswith(".pdf")


def is_error(url: Column | str) -> Column:
    low = F.lower(text(url))
    return low.rlike("^https?://") & _any(low, ["errorpage", "404.html", "404.htm"])


def on_domains(url: Column | str, domains: Column) -> Column:
    """A domain occurs anywhere in the host, so ``boxlg.com`` is on ``lg.com``."""
    h = F.regexp_replace(netloc(url), r"^www\.", "")
    bare = lambda d: F.regexp_replace(F.substring_index(F.regexp_replace(F.lower(d), "^https?://", ""), "/", 1), r"^www\.", "")
    return (h != "") & F.exists(F.transform(domains, bare), lambda d: (d != "") & F.contains(h, d))


def fingerprint(url: Column | str) -> Column:
    """Host and path in one case, without a trailing slash; the query counts for searches only."""
    p = F.lower(F.regexp_replace(path(url), "/+$", ""))
    base = F.concat(F.regexp_replace(netloc(url), r"^www\.", ""), F.when(p == "", F.lit("/")).otherwise(p))
    return F.when(is_search(url), F.concat(base, F.lit("?"), F.lower(query(url)))).otherwise(base)


def query_values(url: Column | str) -> Column:
    pairs = F.filter(F.split(query(url), "&"), lambda p: F.contains(p, F.lit("=")))
    return F.transform(pairs, lambda p: F.coalesce(F.try_url_decode(F.substring(p, F.instr(p, "=") + 1, 1 << 30)), p))


def segments(url: Column | str) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def _stem(s: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s)), r"\.[^.]*$", "")


def path_has_mpn(url: Column | str, mpn: Column) -> Column:
    return F.array_contains(F.transform(segments(url), _stem), F.lower(strip(mpn)))


def has_mpn(url: Column | str, mpn: Column) -> Column:
    """The part number is a whole path segment or query value."""
    n = F.lower(strip(mpn))
    return (F.length(n) >= 3) & (path_has_mpn(url, mpn) | F.array_contains(F.transform(query_values(url), F.lower), n))


def official_score(url: Column | str, mpn: Column | None = None, hosts: HostLists = BUILT_IN) -> Column:
    """-1 for pages never to be used, 0 for PDFs, else 10 to 95 by the kind of page."""
    low = F.lower(text(url))
    owned = ((text(mpn) != "") & has_mpn(url, mpn)) if mpn is not None else F.lit(False)
    points = [F.when(F.contains(low, F.lit(hint)), F.lit(p)) for hint, p in HINTS]
    if mpn is not None:
        points.append(F.when(owned, F.when(path_has_mpn(url, mpn), F.lit(80)).otherwise(F.lit(40))))
    caps = [F.when(F.contains(low, F.lit("manuals-and-downloads")) & ~owned, F.lit(18)), F.when(_any(low, ["search?", "search.html"]), F.lit(15))]
    closed = _any(low, ["/login", "/logout", "/signin", "/cart", "/account", "/api/auth"])
    return F.when((low == "") | is_blocked(url, hosts) | F.contains(low, F.lit("/appliances/")), F.lit(-1)).when(low.endswith(".pdf"), F.lit(0)).when(closed, F.lit(-1)).otherwise(F.least(F.greatest(F.lit(10), *points), F.lit(99), *caps))


def keep_score(url: Column | str, hosts: HostLists = BUILT_IN) -> Column:
    low = F.lower(text(url))
    shop = F.contains(low, F.lit("/appliances/"))
    points = [F.when(_any(low, ["/p/", "/product/", "/products/", "/item/", "/en-us/", "/appliance/"]) & ~shop, F.lit(50)), F.when(low.endswith(".pdf"), F.lit(45))]
    cap = F.when(_any(low, ["search?", "search.html", "/search/"]) & ~F.contains(low, F.lit("smartsearch")), F.lit(12))
    return F.least(F.greatest(official_score(url, hosts=hosts), *points), F.lit(99), cap)


def worth_keeping(url: Column | str, hosts: HostLists = BUILT_IN, read: bool = False) -> Column:
    """``read``: the page is known to have been read, so a url like an error page's counts."""
    low = F.lower(strip(url))
    image = F.lower(path(url)).rlike(r"\.(png|jpg|jpeg|gif|tif|tiff|svg|webp)$")
    return low.rlike("^https?://") & ~is_blocked(url, hosts) & (F.lit(read) | ~is_error(url)) & ~F.contains(low, F.lit("javascript:")) & ~image & (netloc(url) != "")


def classify(url: Column | str, domains: Column, family: Column, hosts: HostLists = BUILT_IN) -> Column:
    return (
        F.when((text(url) == "") | is_blocked(url, hosts), F.lit("BLOCKED"))
        .when(on_domains(url, domains), F.lit("MANUFACTURER"))
        .when(on_domains(url, family), F.lit("FAMILY"))
        .when(on_domains(url, texts(list(hosts.third_party))), F.lit("THIRD_PARTY"))
        .when(is_distributor(url, hosts) | on_domains(url, texts(list(hosts.distributors))), F.lit("DISTRIBUTOR"))
        .otherwise(F.lit("OTHER"))
    )


def url_template(url: Column | str, mpn: Column) -> Column:
    """The url with the part number replaced by ``{mpn}``; '' if it does not occur."""
    raw, n = strip(url), strip(mpn)
    out = F.regexp_replace(raw, F.concat(F.lit(r"(?i)\Q"), n, F.lit(r"\E")), F.lit("{mpn}"))
    return F.when((n == "") | ~raw.startswith("http") | (out == raw), F.lit("")).otherwise(out)


def _placeholder(s: Column) -> Column:
    return F.regexp_replace(s, r"(?i)\.(html|htm|aspx)$", "").isin("{mpn}", "{search_mpn}")


def _catalog(s: Column) -> Column:
    return F.lower(s).isin(CATALOG_SEGMENTS)


def _short(s: Column) -> Column:
    return F.lower(s).rlike("^[a-z]{1,3}$")


def is_portable(template: Column, hosts: HostLists = BUILT_IN) -> Column:
    """The part number is a whole segment or query value and all else in the path is a catalogue word or 1-3 letters."""
    parts = segments(template)
    held = lambda s: F.contains(s, F.lit("{mpn}")) | F.contains(s, F.lit("{search_mpn}"))
    pairs = F.filter(F.split(query(template), "&"), lambda p: held(p))
    in_query = F.size(pairs) > 0
    whole = F.forall(pairs, lambda p: F.substring(p, F.instr(p, "=") + 1, 1 << 30).isin("{mpn}", "{search_mpn}"))
    keys = F.transform(F.split(query(template), "&"), lambda p: F.lower(F.substring_index(p, "=", 1)))
    fine = F.forall(parts, lambda s: F.when(held(s), _placeholder(s)).otherwise(_catalog(s) | _short(s)))
    found = F.exists(parts, held) | in_query
    token = F.exists(parts, lambda s: ~held(s) & _catalog(s)) | (in_query & F.arrays_overlap(keys, texts(SEARCH_KEYS)))
    return (template != "") & ~is_pdf(template) & ~is_blocked(template, hosts) & ~is_distributor(template, hosts) & whole & fine & found & token


def skeleton(template: Column) -> Column:
    """The template without the slugs between catalogue words."""
    kept = F.filter(segments(template), lambda s: F.when(F.contains(s, F.lit("mpn}")), _placeholder(s)).otherwise(_catalog(s) | _short(s)))
    tail = F.when(query(template) == "", F.lit("")).otherwise(F.concat(F.lit("?"), query(template)))
    return F.concat(F.regexp_extract(template, "^([a-z]+://[^/?#]*)", 1), F.when(F.size(kept) > 0, F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(F.lit("")), tail)


def portable_templates(url: Column | str, mpn: Column, hosts: HostLists = BUILT_IN) -> Column:
    t = url_template(url, mpn)
    return F.array_distinct(F.filter(F.array(t, skeleton(t)), lambda x: (x != "") & is_portable(x, hosts)))


def path_shape(template: Column) -> Column:
    """Path of at most three segments that holds the part number and no brand's own words; else null."""
    p = path(template)
    ok = p.rlike(r"\{(search_)?mpn\}") & ~_any(F.lower(p), ["owner-center", "gea-specs", "smartsearch", "learnwhirlpool"]) & F.size(segments(template)).between(1, 3) & ~is_search(template)
    return F.when(ok, p)


def registrable(url: Column | str) -> Column:
    """Host reduced to its last two labels (three under a two-letter country's second level)."""
    parts = F.split(host(url), r"\.")
    n = F.when((F.length(F.element_at(parts, -1)) == 2) & F.try_element_at(parts, F.lit(-2)).isin("co", "com", "org", "net", "ac", "gov"), F.lit(3)).otherwise(F.lit(2))
    return F.array_join(F.when(F.size(parts) > n, F.slice(parts, -n, n)).otherwise(parts), ".")


def hint_allowed(url: Column | str) -> Column:
    """A reviewer's url: http(s), at most 2000 characters, no local or private host."""
    h = host(url)
    private = h.rlike(r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.|0\.|\[?::1)") | h.endswith(".local") | h.endswith(".internal")
    return strip(url).rlike("(?i)^https?://") & (F.length(strip(url)) <= 2000) & (h != "") & ~private


def unwrap_search(href: Column | str) -> Column:
    """Target of a search engine's redirect link (``uddg``, ``u`` in url-safe base 64 after ``a1``, ``url``, ``q``)."""
    h = strip(href)
    get = lambda k: F.coalesce(F.try_url_decode(F.regexp_extract(h, rf"[?&]{k}=([^&#]*)", 1)), F.lit(""))
    code = F.translate(F.regexp_extract(h, r"[?&]u=a1([A-Za-z0-9_-]+)", 1), "-_", "+/")
    padded = F.rpad(code, (F.ceil(F.length(code) / 4) * 4).cast("int"), "=")
    decoded = F.coalesce(F.try_to_binary(padded, F.lit("base64")).cast("string"), F.lit(""))
    return F.when(get("uddg").startswith("http"), get("uddg")).when(decoded.startswith("http"), decoded).when(get("url").startswith("http"), get("url")).when(get("q").startswith("http"), get("q")).otherwise(h)


def cite_url(cite: Column | str) -> Column:
    """``www.host.com › a › b`` -> ``https://www.host.com/a/b``."""
    t = F.regexp_replace(strip(cite), r"\s*›\s*", "/")
    return F.when(t == "", t).when(t.rlike("(?i)^https?://"), t).otherwise(F.concat(F.lit("https://"), t))


def family_domains(domains: Column, families: list[list[str]]) -> Column:
    """Sister domains: every member of a family one of whose members contains, or lies in, one of the domains."""
    out = F.array().cast("array<string>")
    for family in families:
        members = texts(family)
        met = F.exists(domains, lambda d: F.exists(members, lambda m: F.contains(m, d) | F.contains(d, m)))
        out = F.concat(out, F.when(met, members).otherwise(F.array().cast("array<string>")))
    return F.array_except(F.array_distinct(out), domains)


#: fixed values
LEGAL_SUFFIXES = ["inc", "llc", "ltd", "corp", "corporation", "co", "company", "manufacturing", "mfg", "industries", "products", "product", "usa", "us", "na", "north", "america", "group", "holdings", "the", "and", "of"]
NO_GUESS = ["unbranded", "commodity", "generic", "none", "null"]


def name_tokens(name: Column | str) -> Column:
    """Words of a company name without legal suffixes; runs of single characters are one word (STR-18)."""
    words = F.filter(F.regexp_extract_all(F.lower(text(name)), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~w.isin(LEGAL_SUFFIXES))
    merged = F.regexp_replace(F.array_join(words, " "), "(?<=\\b[a-z0-9]) (?=[a-z0-9]\\b)", "")
    return F.filter(F.split(merged, " "), lambda w: F.length(w) >= 2)


def guess_domains(name: Column | str) -> Column:
    """``{first}.com``, and the first two, three and all words joined if of 4 to 40 characters (STR-18)."""

    def guess(t: Column) -> Column:
        first = F.coalesce(F.get(t, F.lit(0)), F.lit(""))
        sizes = F.filter(F.array(F.lit(2), F.lit(3), F.size(t)), lambda n: (n >= 2) & (n <= F.size(t)))
        joined = F.filter(F.transform(sizes, lambda n: F.array_join(F.slice(t, 1, n), "")), lambda j: F.length(j).between(4, 40))
        none = F.array().cast("array<string>")
        return F.when((first == "") | first.rlike("^[0-9]+$") | first.isin(NO_GUESS), none).otherwise(F.array_distinct(F.transform(F.concat(F.array(first), joined), lambda j: F.concat(j, F.lit(".com")))))

    return let(name_tokens(name), guess)
