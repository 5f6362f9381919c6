"""Page metadata, defaults, briefs and documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeloom.functions.text import blank_to_null, cut_ellipsis, cut_sentence, cut_squashed, escape_html, squash
from noticeloom.functions.values import url_encoded
from noticeloom.operators.documents import ANCHOR, NOTICE_LINK, ON_NOTICE, filled
from noticeloom.operators.localize import first_text, short_product

#: Languages of the site, English first, which has no prefix in addresses.
SITE_LANGS = ("en", "es", "ar", "zh", "fr", "de", "ja", "pt", "hi", "ru", "vi")
VEHICLE_LANGS = ("en", "zh", "es", "ar", "hi", "pt", "ru", "fr", "ja", "de", "vi")
BASE = "https://www.example.org"
DEFAULT_IMAGE = "/images/logo/default.webp"
#: The sentences of titles and descriptions, with the facts that they take.
FDA_TITLE, FDA_DESCRIPTION = "{product} Recall ({year}) - FDA Safety Alert", "FDA recall alert for {product} manufactured by {brand}. See reason, risk and affected batches."
VEHICLE_TITLE, VEHICLE_DESCRIPTION = "Vehicle Recall {number} | Safety Alert", "Safety recall {number}. Read risks, affected components, and official remedy."
HEADLINE, BARE_HEADLINE = "{entity} Recalls {product} Over {reason}", "Recall: {product} Due to {reason}"
ANNOUNCED, BECAUSE = "{entity} announced a recall involving {product}{because}. FDA recall notice published in {year}.", " after issues linked to {reason}"
GENERIC_TITLES = ("", "product recall", "recall", "fda safety alert")


def localized_path(lang: Column, path: Column, base: str = BASE) -> Column:
    return F.when(lang == "en", F.concat(F.lit(base), path)).otherwise(F.concat(F.lit(base + "/"), lang, path))


def absolute_image(url: Column, base: str = BASE) -> Column:
    u = F.btrim(url)
    return (
        F.when(F.lower(u).rlike("^https?://"), u)
        .when(u.startswith("//"), F.concat(F.lit("https:"), u))
        .when(u.startswith("/"), F.concat(F.lit(base), u))
    )


def first_image(images: Column, base: str = BASE) -> Column:
    """The first image with an absolute address, else the site's own."""
    return F.coalesce(F.get(F.filter(F.transform(images, lambda u: absolute_image(u, base)), lambda u: u.isNotNull()), 0), F.lit(base + DEFAULT_IMAGE))


def _by_language(df: DataFrame, langs: Sequence[str]) -> DataFrame:
    return df.withColumn("lang", F.explode(F.array(*[F.lit(x) for x in langs])))


def fda_metadata(df: DataFrame, langs: Sequence[str] = SITE_LANGS, base: str = BASE) -> DataFrame:
    """A row per slug and language: canonical address, title (a generic one is replaced), short description, image."""
    # what a language without a slice of its own shows is made once, not for each of them
    asked = F.array(*map(F.lit, langs))
    known = F.coalesce(F.array_intersect(asked, F.map_keys("languages")), F.array().cast("array<string>"))
    rows = df.withColumn("m_known", known).withColumn("m_slice", F.explode(F.concat("m_known", F.when(F.size("m_known") < len(langs), F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>")))))
    own, english = F.try_element_at("languages", F.col("m_slice")), F.try_element_at("languages", F.lit("en"))
    top = lambda f: F.col(f) if f in df.columns else F.lit("")
    value = lambda f: first_text(own[f], english[f], top(f))
    # in steps, so that no expression is evaluated once for each of its uses
    rows = rows.withColumns({"m_product": F.coalesce(F.nullif(value("productDescription"), F.lit("")), F.lit("Product")), "m_brand": F.coalesce(F.nullif(value("brandName"), F.lit("")), F.lit("Unknown brand")), "m_title": first_text(value("headline"), value("title")), "m_text": F.nullif(value("description"), F.lit(""))})
    rows = rows.withColumn("m_short", short_product(F.col("m_product")))
    default = filled(FDA_DESCRIPTION, product=F.col("m_short"), brand=F.col("m_brand"))
    rows = rows.withColumn("m_text", squash(F.coalesce("m_text", default)))
    generic = filled(FDA_TITLE, product=F.col("m_short"), year=F.substring(F.coalesce("report_date", F.lit("")), 1, 4))
    title = F.when(F.lower(F.btrim("m_title")).isin(*GENERIC_TITLES), generic).otherwise(F.col("m_title"))
    path = F.concat(F.lit("/recalls/"), url_encoded(F.col("slug")))
    made = rows.select("slug", "m_known", "m_slice", path.alias("path"), title.alias("title"), cut_squashed(F.col("m_text"), 160).alias("description"), first_image(F.col("images"), base).alias("image"))
    lang = F.explode(F.when(F.col("m_slice").isNull(), F.array_except(asked, F.col("m_known"))).otherwise(F.array("m_slice")))
    return made.withColumn("lang", lang).select("slug", "lang", localized_path(F.col("lang"), F.col("path"), base).alias("canonical"), "title", "description", "image")


def cpsc_metadata(df: DataFrame, langs: Sequence[str] = SITE_LANGS, base: str = BASE) -> DataFrame:
    """The same for consumer products; a stored description wins, cut at 160; only site images count."""
    rows = _by_language(df, langs)
    own = F.coalesce(F.try_element_at("languages", F.col("lang")), F.try_element_at("languages", F.lit("en")))
    title = F.coalesce(blank_to_null(own["Title"]), blank_to_null(F.col("Title")), F.lit("Product recall"))
    told = F.coalesce(blank_to_null(own["metaDescription"]), blank_to_null(F.col("metaDescription")))
    rows = rows.withColumn("m_text", squash(F.coalesce(blank_to_null(own["Description"]), F.col("Description"), F.lit(""))))
    description = F.coalesce(F.substring(F.btrim(told), 1, 160), cut_squashed(F.col("m_text"), 160, mark="…"))
    site = F.get(F.filter("images", lambda u: u.startswith("/images/")), 0)
    path = F.concat(F.lit("/general-recalls/"), url_encoded(F.col("slug")))
    return rows.select("slug", "lang", localized_path(F.col("lang"), path, base).alias("canonical"), F.btrim(title).alias("title"), description.alias("description"), F.when(site.isNotNull(), F.concat(F.lit(base), site)).alias("image"))


def _vehicle_path(number: Column) -> Column:
    return F.concat(F.lit("/recalls/vehicle/"), number)


def vehicle_alternates(number: Column, base: str = BASE, langs: Sequence[str] = VEHICLE_LANGS) -> Column:
    """A map of language to address, ``x-default`` being English."""
    codes = F.array(*[F.lit(x) for x in ("x-default", *langs)])
    url = lambda code: F.when(code.isin("x-default", "en"), F.concat(F.lit(base), _vehicle_path(number))).otherwise(F.concat(F.lit(base + "/"), code, _vehicle_path(number)))
    return F.map_from_arrays(codes, F.transform(codes, url))


def _vehicle_title(number: Column) -> Column:
    return filled(VEHICLE_TITLE, number=number)


def _vehicle_description(number: Column) -> Column:
    return filled(VEHICLE_DESCRIPTION, number=number)


def vehicle_metadata(df: DataFrame, langs: Sequence[str] = VEHICLE_LANGS, base: str = BASE) -> DataFrame:
    """The same for vehicles, stored titles and descriptions before the defaults, with all alternates."""
    rows = _by_language(df.withColumn("campaignNumber", F.btrim("campaignNumber")), langs)
    n = F.col("campaignNumber")
    stored = lambda c: blank_to_null(F.btrim(c)) if c in df.columns else F.lit(None).cast("string")
    return rows.select(
        "campaignNumber",
        "lang",
        localized_path(F.col("lang"), _vehicle_path(n), base).alias("canonical"),
        F.coalesce(stored("seoTitle"), _vehicle_title(n)).alias("title"),
        F.coalesce(stored("seoDescription"), _vehicle_description(n)).alias("description"),
        vehicle_alternates(n, base).alias("alternates"),
    )


def backfill_vehicle_seo(df: DataFrame, base: str = BASE) -> DataFrame:
    """P25: defaults where the stored values are blank; rows without a number stay as they are."""
    n = F.btrim("campaignNumber")
    known = F.coalesce(n != "", F.lit(False))
    path = _vehicle_path(n)
    fills = {"canonicalPath": path, "canonicalUrl": F.concat(F.lit(base), path), "seoTitle": _vehicle_title(n), "seoDescription": _vehicle_description(n)}
    out = df
    for c, value in fills.items():
        own = F.col(c) if c in df.columns else F.lit(None).cast("string")
        out = out.withColumn(c, F.when(known, F.coalesce(blank_to_null(own), value)).otherwise(own))
    own = F.col("hreflangUrls") if "hreflangUrls" in df.columns else F.lit(None).cast("map<string,string>")
    return out.withColumn("hreflangUrls", F.when(known & (F.coalesce(F.size(own), F.lit(0)) <= 0), vehicle_alternates(n, base)).otherwise(own))


def assemble_brief(df: DataFrame, year: Column) -> DataFrame:
    """Headline, description, keywords, links and an answer made from the facts alone."""
    col = lambda c: squash(F.coalesce(F.col(c), F.lit(""))) if c in df.columns else F.lit("")
    brand, company, product, reason = (col(c) for c in ("brandName", "companyName", "productDescription", "reason"))
    entity = first_text(brand, company)
    title = col("title")
    headline = (
        F.when((title != "") & (F.lower(title) != "product recall"), title)
        .when(entity != "", filled(HEADLINE, entity=entity, product=first_text(product, F.lit("Product")), reason=first_text(reason, F.lit("a safety issue"))))
        .otherwise(filled(BARE_HEADLINE, product=first_text(product, F.lit("Product")), reason=first_text(reason, F.lit("a safety issue"))))
    )
    because = F.when(reason != "", filled(BECAUSE, reason=F.lower(reason))).otherwise("")
    text = filled(ANNOUNCED, entity=first_text(entity, F.lit("A company")), product=first_text(product, F.lit("a product")), because=because, year=year)
    words = F.array(F.lit("FDA recall"), F.concat(year, F.lit(" FDA recall")), company, brand, product, col("productType"), reason)
    keywords = F.slice(F.array_distinct(F.filter(words, lambda w: w != "")), 1, 15)
    url = col("detailUrl")
    link = filled(NOTICE_LINK, link=filled(ANCHOR, url=url, word=F.lit(ON_NOTICE)))
    links = F.when(url != "", F.array(link)).otherwise(F.array().cast("array<string>"))
    answer = F.concat(F.lit("<p>"), escape_html(first_text(entity, F.lit("The company"))), F.lit(" recalled "), escape_html(first_text(product, F.lit("the affected product"))), F.when(reason != "", F.concat(F.lit(" because of "), escape_html(F.lower(reason)))).otherwise(""), F.lit(".</p>"))
    return df.withColumns({"headline": headline, "metaDescription": cut_sentence(cut_ellipsis(text)), "keywords": keywords, "authorityLinks": links, "quickAnswer": answer})


#: A content section, as documents hold it.
SECTION = "struct<subtitle:string,text:string,facts:string,faq:array<struct<question:string,answer:string>>,authorityLinks:array<string>>"


def _section(subtitle: str, text: Column | None = None, facts: Column | None = None, faq: Column | None = None, links: Column | None = None) -> Column:
    null = F.lit(None)
    parts = ((F.lit(subtitle), "subtitle"), (text, "text"), (facts, "facts"), (faq, "faq"), (links, "authorityLinks"))
    return F.struct(*[(null if c is None else c).alias(n) for c, n in parts]).cast(SECTION)


def assemble_document(df: DataFrame) -> DataFrame:
    """The nested document of a notice: its sections in order, empty ones left out, with facts as JSON."""
    facts = F.to_json(F.struct(*[F.nullif(F.col(c), F.lit("")).alias(c) for c in ("productDescription", "brandName", "productType") if c in df.columns]), {"ignoreNullFields": "true"})
    question = lambda q, a: F.struct(F.lit(q).alias("question"), a.alias("answer"))
    faq = F.array(question("What product was recalled?", F.coalesce("productDescription", F.lit(""))), question("Where can I verify this recall?", F.lit("Use the official recall notice linked on this page.")))
    sections = F.array(
        _section("Quick Answer", F.col("quickAnswer")),
        _section("What Was Recalled", facts=F.when(facts != "{}", facts)),
        _section("What Consumers Should Do", F.lit("<p>Follow the remedy instructions of the official notice.</p>")),
        _section("Frequently Asked Questions", faq=faq),
        _section("Source and Verification", F.lit("<p>This page is based on the official recall notice.</p>"), links=F.col("authorityLinks")),
    )
    full = lambda s: (F.coalesce(s["text"], F.lit("")) != "") | s["facts"].isNotNull() | s["faq"].isNotNull() | (F.coalesce(F.size(s["authorityLinks"]), F.lit(0)) > 0)
    return df.withColumn("content", F.filter(sections, full))


def prune(c: Column, kind: T.DataType) -> Column:
    """A value without its empty parts: blank texts, empty arrays and structs become null, at every depth."""
    if isinstance(kind, T.StringType):
        return F.nullif(squash(c), F.lit(""))
    if isinstance(kind, T.ArrayType):
        out = F.filter(F.transform(c, lambda x: prune(x, kind.elementType)), lambda x: x.isNotNull())
        return F.when(F.size(out) > 0, out)
    if isinstance(kind, T.StructType):
        parts = [prune(c[f.name], f.dataType).alias(f.name) for f in kind.fields]
        some = F.coalesce(*[p.isNotNull() & F.lit(True) for p in parts]) if not parts else F.greatest(*[p.isNotNull() for p in parts]) if len(parts) > 1 else parts[0].isNotNull()
        return F.when(some, F.struct(*parts))
    return c


def prune_empty(df: DataFrame) -> DataFrame:
    """``prune`` of every column, driven by the schema."""
    return df.select(*[prune(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])
