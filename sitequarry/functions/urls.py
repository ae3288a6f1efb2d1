"""URL functions as Columns. Invalid URLs give the default of each function, never an error."""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import quote, unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Fixed values.
SEARCH_KEYS = ["s", "search", "q", "query", "keyword", "terms", "find"]
FACET_KEYS = ["filter", "sort", "color", "size", "brand", "price", "min", "max", "material", "style", "category", "tag", "vendor"]
HTML_EXTENSIONS = ["", "html", "htm", "php", "aspx", "jsp"]
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "gif", "webp", "svg", "ico", "avif"]
CONTENT_TYPES = {
    "html": "text/html", "htm": "text/html", "js": "application/javascript", "mjs": "application/javascript", "css": "text/css", "json": "application/json", "xml": "application/xml", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif",
    "webp": "image/webp", "svg": "image/svg+xml", "pdf": "application/pdf", "mp4": "video/mp4", "webm": "video/webm", "mp3": "audio/mpeg", "ico": "image/x-icon", "woff": "font/woff", "woff2": "font/woff2", "ttf": "font/ttf", "otf": "font/otf",
}
PRODUCT_PATH = "/product/|/products/|/p/|/item/|/shop/|/buy/|-product/|/prod-"
CART_PATH = "/cart/?$|/basket/?$|/checkout/?$|/bag/?$|/minicart|/cart[.]php|/checkout[.]php"
PAGED_URL = "(?i)/(page|p)/[0-9]+/?|/(page|p)-[0-9]+/?|page=[0-9]+|p=[0-9]+"
FIRST_PATH = "(?i)/(page|p)/1/|/(page|p)-1/"
SKIPPED_SCHEMES = "(?i)^(mailto:|tel:|javascript:|data:|#)"

# Characters that stay as they are, besides letters, digits, -._* and %.
KEPT_IN_PATH = "!$&'()+,/:;=@[]^|~"
KEPT_IN_QUERY = "!$&()+,/:;=?@[]\\^`{|}~"

_URL = "^([a-zA-Z][a-zA-Z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]+)(:[0-9]*)?([^?#]*)([?][^#]*)?(#.*)?$"


def is_valid(u: Column) -> Column:
    return F.coalesce(u.rlike(_URL), F.lit(False))


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, _URL, 1))


def host(u: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(u, _URL, 2)), F.lit(""))


def path(u: Column) -> Column:
    p = F.regexp_extract(u, _URL, 4)
    return F.when(is_valid(u) & (p == ""), "/").otherwise(p)


def query(u: Column) -> Column:
    return F.substring(F.regexp_extract(u, _URL, 5), 2, 1 << 30)


def extension(u: Column) -> Column:
    return F.lower(F.regexp_extract(path(u), "[.]([a-zA-Z0-9]+)$", 1))


def segments(u: Column) -> Column:
    return F.filter(F.split(path(u), "/"), lambda s: s != "")


def folder_depth(u: Column) -> Column:
    return F.size(segments(u))


def remove_query(u: Column) -> Column:
    return F.regexp_replace(u, "[?][^#]*", "")


def remove_fragment(u: Column) -> Column:
    return F.regexp_replace(u, "#.*$", "")


def query_keys(u: Column) -> Column:
    parts = F.filter(F.split(query(u), "&"), lambda p: p != "")
    return F.transform(parts, lambda p: F.split_part(p, F.lit("="), F.lit(1)))


def query_params(u: Column) -> Column:
    """Map of decoded parameters; the last value of a key wins."""
    parts = F.filter(F.split(query(u), "&"), lambda p: p != "")
    pairs = F.transform(parts, lambda p: F.struct(F.try_url_decode(F.split_part(p, F.lit("="), F.lit(1))).alias("k"), F.try_url_decode(F.substring_index(F.concat(p, F.when(p.contains("="), "").otherwise("=")), "=", -1)).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(F.filter(last, lambda p: p["k"].isNotNull()))


def has_parameters(u: Column) -> Column:
    return F.length(query(u)) > 0


def has_search_parameter(u: Column) -> Column:
    return F.arrays_overlap(F.transform(query_keys(u), F.lower), F.array(*[F.lit(k) for k in SEARCH_KEYS]))


def has_tracking_parameter(u: Column) -> Column:
    return F.exists(query_keys(u), lambda k: k.startswith("utm_") | k.isin("_ga", "_gl"))


def has_facet_parameter(u: Column) -> Column:
    return F.exists(query_keys(u), lambda k: F.lower(k).rlike("|".join(FACET_KEYS)))


def has_non_ascii(u: Column) -> Column:
    return u.rlike("[^\\x00-\\x7F]")


def has_underscore(u: Column) -> Column:
    return path(u).contains("_")


def has_uppercase(u: Column) -> Column:
    return path(u).rlike("[A-Z]")


def has_multiple_slashes(u: Column) -> Column:
    return path(u).rlike("//+")


def has_repetitive_path(u: Column) -> Column:
    s = segments(u)
    return F.size(s) > F.size(F.array_distinct(s))


def has_space(u: Column) -> Column:
    return path(u).rlike(" |%20")


def is_over_length(u: Column, most: int = 115) -> Column:
    return F.length(u) > most


def strip_protocol(u: Column) -> Column:
    return F.concat(host(u), path(u), F.regexp_extract(u, _URL, 5))


def is_protocol_relative(u: Column) -> Column:
    return u.startswith("//")


def is_skipped_link(u: Column) -> Column:
    return u.rlike(SKIPPED_SCHEMES)


def same_host(a: Column, b: Column) -> Column:
    return is_valid(a) & is_valid(b) & (host(a) == host(b))


def is_internal(u: Column, start: Column, subdomains: bool = False) -> Column:
    return same_host(u, start) | (F.lit(subdomains) & is_valid(u) & host(u).endswith(F.concat(F.lit("."), host(start))))


def is_html_url(u: Column) -> Column:
    return extension(u).isin(HTML_EXTENSIONS)


def is_image_url(u: Column) -> Column:
    return extension(u).isin(IMAGE_EXTENSIONS)


def content_type(u: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for kv in CONTENT_TYPES.items() for x in kv])
    return F.coalesce(kinds[extension(u)], F.lit("unknown"))


def should_crawl(u: Column, images: bool, css: bool, js: bool, pdfs: bool) -> Column:
    kind = content_type(u)
    ok = kind.isin("text/html", "unknown")
    for wanted, test in ((images, kind.startswith("image/")), (css, kind == "text/css"), (js, kind == "application/javascript"), (pdfs, kind == "application/pdf")):
        if wanted:
            ok = ok | test
    return ok


def is_http(u: Column) -> Column:
    return scheme(u) == "http"


def is_https(u: Column) -> Column:
    return scheme(u) == "https"


def is_seed(u: Column) -> Column:
    return F.coalesce(scheme(u).isin("http", "https"), F.lit(False))


def query_mode(u: Column, mode: str) -> Column:
    """keep, remove, or remove-except-first."""
    if mode == "keep":
        return u
    if mode == "remove":
        return remove_query(u)
    first = F.split_part(query(u), F.lit("&"), F.lit(1))
    kept = F.concat(F.regexp_extract(u, "^([^?#]*)", 1), F.when(first != "", F.concat(F.lit("?"), first, F.when(first.contains("="), "").otherwise("="))).otherwise(""), F.regexp_extract(u, "(#.*)$", 1))
    return F.when(is_valid(u), kept).otherwise(u)


def is_first_page(u: Column) -> Column:
    page = F.coalesce(F.nullif(query_params(u)["page"], F.lit("")), query_params(u)["p"])
    return is_valid(u) & (F.coalesce(page.isin("0", "1"), F.lit(False)) | path(u).rlike(FIRST_PATH) | ~u.rlike(PAGED_URL))


def is_product_page(u: Column) -> Column:
    return F.lower(path(u)).rlike(PRODUCT_PATH)


def is_cart(u: Column) -> Column:
    return F.lower(path(u)).rlike(CART_PATH)


def is_html_path(p: Column) -> Column:
    """The text after the last dot of the path; without a dot that is the whole path, which is no HTML extension."""
    return F.lower(F.element_at(F.split(p, "[.]"), -1)).isin(HTML_EXTENSIONS)


def encode_path(u: Column) -> Column:
    """Each path segment percent-encoded."""
    encoded = F.array_join(F.transform(F.split(path(u), "/"), lambda s: F.replace(F.url_encode(F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s)), F.lit("+"), F.lit("%20"))), "/")
    return F.concat(scheme(u), F.lit("://"), host(u), F.regexp_extract(u, _URL, 3), encoded, F.regexp_extract(u, _URL, 5))


def _percent(c: Column, keep: str) -> Column:
    """UTF-8 bytes percent-encoded, but letters, digits, -._* and what is kept; a % stays as it is."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for ch in keep:
        out = F.replace(out, F.lit(f"%{ord(ch):02X}"), F.lit(ch))
    return F.replace(out, F.lit("%25"), F.lit("%"))


def _without_dots(p: Column) -> Column:
    """A path whose . and .. segments are taken away; .. above the top has no effect."""
    parts = F.split(p, "/")
    up = lambda a: F.when(F.size(a) > 1, F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a)
    kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array(F.lit("")), lambda a, s: F.when(s == "..", up(a)).when(s == ".", a).otherwise(F.concat(a, F.array(s))))
    kept = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(p.rlike("(^|/)[.]{1,2}(/|$)"), F.array_join(kept, "/")).otherwise(p)


def normal_path(p: Column) -> Column:
    """The path decoded, where it can be, and encoded anew; plain paths are left as they are."""
    decoded = F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B")))
    bad = decoded.isNull() | (decoded.contains("\ufffd") & ~p.contains("\ufffd"))  # no UTF-8
    text = F.replace(F.when(bad, p).otherwise(decoded), F.lit("\\"), F.lit("/"))
    return _without_dots(F.when(p.rlike("^[A-Za-z0-9*._/,:;=@!$&'()+~-]*$"), p).otherwise(_percent(text, KEPT_IN_PATH)))


def normalize(u: Column) -> Column:
    """Absolute URLs: no fragment, lower-case host, no default port, path and query encoded once, no dot segments; else null."""
    port, query_ = F.regexp_extract(u, _URL, 3), F.regexp_extract(u, _URL, 5)
    standard = ((scheme(u) == "http") & (port == ":80")) | ((scheme(u) == "https") & (port == ":443")) | (port == ":")
    encoded = F.when(query_.rlike("^[!$-&(-;=?-~]*$"), query_).otherwise(_percent(query_, KEPT_IN_QUERY))
    return F.when(is_valid(u), F.concat(scheme(u), F.lit("://"), host(u), F.when(standard, "").otherwise(port), normal_path(path(u)), encoded))


def normal_path_text(p: str) -> str:
    """What normal_path does, for one path."""
    text = p
    if not re.search("%(?![0-9A-Fa-f]{2})", p):
        try:
            text = unquote(p, errors="strict")
        except UnicodeDecodeError:
            pass
    text = quote(text.replace("\\", "/"), safe="%*-._" + KEPT_IN_PATH)
    if not re.search(r"(^|/)\.{1,2}(/|$)", text):
        return text
    first, *parts = text.split("/")
    kept = [first]
    for s in parts:
        if s == "..":
            kept = kept[: max(1, len(kept) - 1)]
        elif s != ".":
            kept.append(s)
    return "/".join(kept + [""] if parts and parts[-1] in (".", "..") else kept)


def resolve_text(link: str | None, base: str | None) -> str | None:
    """A link against its base; links that lead nowhere give None."""
    link = (link or "").strip()
    if not link or re.match(SKIPPED_SCHEMES, link):
        return None
    try:
        out = urljoin(base or "", link)
        parts = urlsplit(out)
    except ValueError:
        return None
    if not parts.scheme or not parts.netloc:
        return None
    host_, port = parts.hostname or "", f":{parts.port}" if parts.port and (parts.scheme, parts.port) not in (("http", 80), ("https", 443)) else ""
    keep = f"#{parts.fragment}" if link.startswith("//") and parts.fragment else ""
    return f"{parts.scheme}://{host_}{port}{normal_path_text(parts.path or '/')}{'?' + quote(parts.query, safe='%*-._' + KEPT_IN_QUERY) if parts.query else ''}{keep}"


@F.pandas_udf(StringType())
def resolve(link: pd.Series, base: pd.Series) -> pd.Series:
    """Relative links need more than a Column can say: resolved in batches."""
    return pd.Series([resolve_text(a, b) for a, b in zip(link, base)], dtype=object)


@F.pandas_udf(ArrayType(StringType()))
def resolve_all(links: pd.Series, base: pd.Series, start: pd.Series) -> pd.Series:
    """All links of a page against its base, which counts from the start; without a base against the start itself.

    One call a page, to be exploded: a filter on the addresses stays above the explode, so no link is resolved twice.
    """
    out = []
    for found, b, s in zip(links, base, start):
        at = resolve_text(b, s) or s
        out.append([resolve_text(x, at) for x in found])
    return pd.Series(out, dtype=object)


def matches_any(u: Column, patterns: Sequence[str]) -> Column:
    """Any of the patterns; one that is no regular expression counts as plain text."""
    out = F.lit(False)
    for p in patterns:
        try:
            re.compile(p)
            out = out | u.rlike(p)
        except re.error:
            out = out | u.contains(p)
    return out
