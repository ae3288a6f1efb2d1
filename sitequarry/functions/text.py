"""Text, date and log functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Glyph widths in pixels, by width; all other characters count FALLBACK_WIDTH.
GLYPHS = {
    3: " '", 4: "!,.:;Iijl|", 5: "()-/[\\]`frt", 6: "\"*1J_cksvxyz{}", 7: "$+23457<=>?FL^abdeghnopqu~", 8: "#0689BEKPRSTXYZ", 9: "&ACDGHNOQUVw", 10: "m", 11: "%@M", 12: "W",
}
FALLBACK_WIDTH = 7
TITLE_FACTOR, DESCRIPTION_FACTOR = 1.0, 13 / 18
TITLE_PIXELS, DESCRIPTION_PIXELS = 561, 985
# Bots in the order of their tests.
BOTS = {
    "Googlebot": "(?i)Googlebot/", "Googlebot-Image": "(?i)Googlebot-Image", "Googlebot-News": "(?i)Googlebot-News", "Bingbot": "(?i)bingbot/", "GPTBot": "(?i)GPTBot", "ClaudeBot": "(?i)ClaudeBot",
    "PerplexityBot": "(?i)PerplexityBot", "ChatGPT-User": "(?i)ChatGPT-User", "Applebot": "(?i)Applebot", "Anthropic": "(?i)Anthropic",
}
# Words that keyword counts leave out.
STOP_WORDS = "a an the and or but is are was were be been being have has had do does did will would could should may might to of in on at by for with from as it its this that these those i you he she we they me him her us them my your his our their what which who when where why how all any both each more most some such no not only own same so than too very can just now get like also use using used one two new way make made out up about into through during before after above below between under again further then once here there".split()
COMMON_WORDS = "the a an is are was were be been being to of and or in on at by for with from as it its this that these those i you he she we they them their what which who when where why how all any both each few more most other some such no not only own same so than too very can will just should now about up out down off over under again further then once".split()
SITE_WORDS = [*COMMON_WORDS, *"here there page home website site online web click read".split()]
EMPTY_ANCHORS = ["click", "click here", "here", "read more", "more", "link", "this", "that", "page", "website", "site"]
TOXIC_DOMAIN = "(?i)spam|porn|xxx|gambling|casino|payday|pharma|warez|torrent|blackhat"
# Well-known hosts and their authority, in the order of their tests.
PLATFORMS = [
    ("youtube[.]com", 99), ("facebook[.]com", 96), ("twitter[.]com|x[.]com", 94), ("linkedin[.]com", 95), ("instagram[.]com", 93), ("pinterest[.]com", 92), ("reddit[.]com", 91), ("wikipedia[.]org", 98), ("medium[.]com", 88), ("github[.]com", 94), ("gitlab[.]com", 90),
    ("stackoverflow[.]com", 92), ("yelp[.]com", 89), ("tripadvisor[.]com", 88), ("trustpilot[.]com", 87), ("g2[.]com", 86), ("capterra[.]com", 85), ("crunchbase[.]com", 88), ("bloomberg[.]com", 95), ("forbes[.]com", 93), ("nytimes[.]com", 95), ("theguardian[.]com", 94),
    ("bbc[.]com|bbc[.]co[.]uk", 96), ("wordpress[.]com|wordpress[.]org", 85), ("blogger[.]com|blogspot[.]com", 82), ("tumblr[.]com", 80), ("quora[.]com", 86), ("soundcloud[.]com", 83), ("vimeo[.]com", 88), ("tiktok[.]com", 90), ("snapchat[.]com", 88),
]
# Language codes, two letters each.
LANGUAGES = "aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj fo fr fy ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu".split()


def _regions() -> list[str]:
    """Assigned two-letter country codes, from the Java runtime's own list."""
    from pyspark.sql import SparkSession

    locale = SparkSession.active()._jvm.java.util.Locale
    return sorted({str(c).lower() for c in locale.getISOCountries()})


WHITE = "[\\s\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]+"


def clean(c: Column) -> Column:
    """White space collapsed; empty is null."""
    return F.nullif(F.trim(F.regexp_replace(c, WHITE, " ")), F.lit(""))


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def pixel_width(c: Column, kind: str = "title") -> Column:
    """Sum of glyph widths, counted class by class, rounded half up; null and empty have width 0."""
    factor = DESCRIPTION_FACTOR if kind == "description" else TITLE_FACTOR
    total = F.length(c) * FALLBACK_WIDTH
    for width, glyphs in GLYPHS.items():
        if width != FALLBACK_WIDTH:
            total = total + (F.length(c) - F.length(F.translate(c, glyphs, ""))) * (width - FALLBACK_WIDTH)
    return F.coalesce(half_up(total * F.lit(factor)), F.lit(0)).cast("long")


def tokens(c: Column, stop: list[str], least: int, keep: str = "") -> Column:
    """Lower-case ASCII words of at least `least` characters that aren't stop words; `keep` lists further characters."""
    words = F.split(F.regexp_replace(F.lower(c), f"[^a-z0-9\\s{keep}]", " "), "\\s+")
    return F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(stop))


def ngrams(t: Column) -> Column:
    """The words and the pairs of neighbouring words."""
    pairs = F.when(F.size(t) > 1, F.transform(F.arrays_zip(F.slice(t, F.lit(1), F.size(t) - 1).alias("a"), F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))).alias("b")), lambda p: F.concat_ws(" ", p["a"], p["b"])))
    return F.concat(t, F.coalesce(pairs, F.array().cast("array<string>")))


def detect_bot(agent: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in BOTS.items():
        out = out.when(agent.rlike(pattern), name)
    return out


def authority(url: Column, nofollow: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for pattern, value in PLATFORMS:
        out = out.when(url.rlike(f"(?i){pattern}"), value)
    tld = F.lower(F.regexp_extract(url, "(?i)[.](com|org|net|edu|gov)$", 1))
    return out.when(nofollow, 20).when(tld.isin("edu", "gov"), 80).when(tld != "", 50).otherwise(30)


def is_toxic_domain(url: Column) -> Column:
    return url.rlike(TOXIC_DOMAIN)


def is_empty_anchor(anchor: Column) -> Column:
    text = F.lower(F.trim(F.coalesce(anchor, F.lit(""))))
    return (text == "") | text.isin(EMPTY_ANCHORS)


def is_hreflang(c: Column) -> Column:
    v = F.lower(F.trim(c))
    parts = F.split(v, "[-_]")
    region = F.get(parts, F.lit(1))
    return F.coalesce((v == "x-default") | ((F.size(parts) <= 2) & F.get(parts, F.lit(0)).isin(LANGUAGES) & (region.isNull() | (region == "") | region.isin(_regions()))), F.lit(False))


def text_list(c: Column) -> Column:
    """A JSON list of strings, or else a list by lines or semicolons."""
    parts = F.filter(F.transform(F.split(c, "[\\n;]"), lambda x: F.trim(x)), lambda p: p != "")
    return F.coalesce(F.from_json(c, "array<string>"), parts)


def phone(c: Column) -> Column:
    """The first phone-like number, plus sign and digits only; '' if there is none."""
    one = F.regexp_extract(c, "\\+?1?[\\s.-]?\\(?\\d{3}\\)?[\\s.-]?\\d{3}[\\s.-]?\\d{4}", 0)
    two = F.regexp_extract(c, "\\+?\\d{1,4}[\\s.-]?\\d{1,4}[\\s.-]?\\d{1,4}[\\s.-]?\\d{1,4}", 0)
    return F.regexp_replace(F.coalesce(F.nullif(one, F.lit("")), two), "[^+\\d]", "")


def zip_code(c: Column) -> Column:
    return F.regexp_extract(c, "\\b\\d{5}(-\\d{4})?\\b", 0)


def log_time(c: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(c, F.lit("dd/MMM/yyyy:HH:mm:ss Z")))


def stripped_html(html: Column) -> Column:
    """Text without scripts, styles and tags, common references decoded."""
    out = F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, "<[^>]+>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, WHITE, " "))
