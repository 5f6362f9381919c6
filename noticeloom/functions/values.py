"""Column functions for dates, addresses, identities and slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeloom.functions.text import squash

#: Site that relative addresses belong to.
SITE = "https://www.fda.gov"
#: Formats read, in this order.
DATE_FORMATS = ("yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy", "MM/dd/yyyy")


def to_date(text: Column) -> Column:
    """Eight digits, ISO dates and times, or a long English date; anything else is null. All times are UTC."""
    t = squash(text)
    compact = F.when(t.rlike(r"^\d{8}$"), F.to_date(F.try_to_timestamp(t, F.lit("yyyyMMdd"))))
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}T"), F.to_date(F.try_to_timestamp(F.substring(t, 1, 10), F.lit("yyyy-MM-dd"))))
    return F.coalesce(compact, iso, *[F.to_date(F.try_to_timestamp(t, F.lit(f))) for f in DATE_FORMATS])


def to_time(text: Column) -> Column:
    """The same as a UTC timestamp; eight digits count as that day's noon."""
    t = squash(text)
    compact = F.when(t.rlike(r"^\d{8}$"), F.try_to_timestamp(F.concat(t, F.lit("12")), F.lit("yyyyMMddHH")))
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}T"), F.try_to_timestamp(t))
    return F.coalesce(compact, iso, *[F.try_to_timestamp(t, F.lit(f)) for f in DATE_FORMATS])


def year_of(text: Column, default: str = "2026") -> Column:
    found = F.regexp_extract(squash(text), r"\b(20\d{2})\b", 1)
    return F.when(found != "", found).otherwise(default)


def link_url(url: Column) -> Column:
    """An absolute link without fragment and trailing punctuation; mail and phone links become empty."""
    bare = F.regexp_replace(F.regexp_replace(squash(url), r"\s+", ""), r"[),.;]+$", "")
    full = (
        F.when(bare.startswith("//"), F.concat(F.lit("https:"), bare))
        .when(bare.startswith("/"), F.concat(F.lit(SITE), bare))
        .when(~F.lower(bare).rlike("^https?://") & F.lower(bare).rlike(r"^[a-z0-9.-]+\.[a-z]{2,}"), F.concat(F.lit("https://"), bare))
        .otherwise(bare)
    )
    clean = F.regexp_replace(F.regexp_replace(full, "#.*$", ""), r"[?]$", "")
    bad = F.lower(bare).rlike("^(mailto|tel):") | ~F.lower(full).rlike("^https?://[^/?#]+")
    return F.when(bad, "").otherwise(clean)


def notice_url(url: Column) -> Column:
    """Identity of a notice's page: no fragment, no trailing slash before the query or the end."""
    bare = F.regexp_replace(squash(url), "#.*$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"/\?", "?"), "/$", "")


def record_url(url: Column) -> Column:
    """Identity of a record's page: neither fragment nor query, no trailing slash."""
    return F.regexp_replace(F.regexp_replace(squash(url), "[?#].*$", ""), "/$", "")


def notice_hash(value: Column) -> Column:
    return F.sha2(F.lower(F.btrim(value)), 256)


def record_hash(recall_id: Column, number: Column, url: Column) -> Column:
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (recall_id, number)]
    return F.sha2(F.concat_ws("|", *parts, F.coalesce(record_url(url), F.lit(""))), 256)


def slug_part(text: Column) -> Column:
    """Lower-case words of letters and digits, joined by hyphens."""
    t = F.replace(F.lower(squash(text)), F.lit("&"), F.lit(" and "))
    t = F.regexp_replace(F.regexp_replace(t, "[®™©]", ""), r"[^a-z0-9\s-]", " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\s+", "-"), "-+", "-"), "^-|-$", "")


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(squash(text), " "), 1, n), " ")


def notice_slug(product: Column, brand: Column, year: Column) -> Column:
    """Eight words of the product, four of the brand, ``recall`` and the year, 80 characters at most."""
    parts = [F.nullif(slug_part(first_words(F.coalesce(c, F.lit("")), n)), F.lit("")) for c, n in ((product, 8), (brand, 4))]
    base = F.concat_ws("-", *parts, F.lit("recall"), year)
    return F.when(F.char_length(base) > 80, F.regexp_replace(F.substring(base, 1, 80), "-+$", "")).otherwise(base)


def plain_slug(text: Column, most: int = 120) -> Column:
    t = F.replace(F.lower(squash(text)), F.lit("&"), F.lit(" and "))
    t = F.regexp_replace(F.regexp_replace(t, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(t, 1, most), "-+$", "")


def record_slug(title: Column) -> Column:
    """A title's slug, in which "recalled" reads "recall" and which ends so."""
    base = plain_slug(F.regexp_replace(title, r"(?i)\brecall(ed)?\b", "recall"))
    return F.when(base.endswith("-recall"), base).otherwise(F.concat(base, F.lit("-recall")))


def image_folder(order: Column, title: Column, most: int = 72) -> Column:
    short = F.regexp_replace(F.substring(plain_slug(title), 1, most), "-+$", "")
    return F.concat_ws("-", order.cast("string"), F.when(short == "", "general-recall").otherwise(short))


def url_encoded(text: Column) -> Column:
    """Percent-encoding as in a path segment: blanks as %20, and ``!'()*~`` as they stand."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, sign in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return out
