"""Localised projections (P11-P14) and cards, sections and facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.functions.text import blank_to_null, clip, squash, strip_tags

RTL = ("ar", "he", "fa", "ur")
FDA_FIELDS = ("brandName", "productDescription", "productType", "description", "reason")
#: Headings of the section that names the official source, by language; fixed values.
OFFICIAL_MARKERS = (
    "official source",
    "source officielle",
    "fuente oficial",
    "offizielle quelle",
    "fonte ufficiale",
    "fonte oficial",
    "официальный источник",
    "公式情報源",
    "officiële bron",
    "oficjalne źródło",
    "resmi kaynak",
    "منبع رسمی",
    "官方来源",
    "nguồn chính thức",
    "sumber resmi",
    "oficiální zdroj",
    "공식 출처",
    "офіційне джерело",
    "hivatalos forrás",
    "आधिकारिक स्रोत",
    "المصدر الرسمي",
)


def first_text(*values: Column) -> Column:
    """The first that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def _slices(lang: str, languages: str = "languages") -> tuple[Column, Column]:
    own, english = F.try_element_at(languages, F.lit(lang)), F.try_element_at(languages, F.lit("en"))
    return F.coalesce(own, english), english


def localize_fda(df: DataFrame, lang: str) -> DataFrame:
    """Per field the language's value, else English, else the row's own; a headline serves as title."""
    own, english = _slices(lang)
    top = lambda f: F.col(f) if f in df.columns else F.lit(None).cast("string")
    fields = [first_text(own[f], english[f], top(f)).alias(f) for f in FDA_FIELDS]
    title = first_text(own["title"], own["headline"], english["title"], english["headline"], top("title"), top("headline"))
    kept = [c for c in ("slug", "image", "report_date", "datePublished", "terminated") if c in df.columns]
    return df.select(*kept, title.alias("title"), *fields)


def localize_cpsc(df: DataFrame, lang: str, strings: Sequence[str] = ("Title", "Description", "ConsumerContact", "metaDescription", "SoldAtLabel"), arrays: Sequence[str] = ("Products", "Hazards", "Remedies", "RemedyOptions", "Retailers", "Injuries", "ManufacturerCountries", "Importers", "Distributors", "Manufacturers")) -> DataFrame:
    """Strings and arrays of the language's slice where they are not empty, image captions by position, and the text's direction."""
    pack, _ = _slices(lang)
    inside = df.schema["languages"].dataType.valueType.names
    out = df.withColumn("pack", pack)
    for c in strings:
        if c in df.columns and c in inside:
            out = out.withColumn(c, F.coalesce(blank_to_null(F.col(f"pack.{c}")), F.col(c)))
    for c in arrays:
        if c in df.columns and c in inside:
            out = out.withColumn(c, F.when(F.size(F.col(f"pack.{c}")) > 0, F.col(f"pack.{c}")).otherwise(F.col(c)))
    if "Images" in df.columns and "Images" in inside:
        caption = lambda x, i: blank_to_null(F.get(F.col("pack.Images"), i)["Caption"])
        out = out.withColumn("Images", F.transform("Images", lambda x, i: x.withField("Caption", F.coalesce(caption(x, i), x["Caption"]))))
    told = F.when(F.col("pack.dir").isin("rtl", "ltr"), F.col("pack.dir")) if "dir" in inside else F.lit(None).cast("string")
    return out.withColumn("dir", F.coalesce(told, F.lit("rtl" if lang in RTL else "ltr"))).drop("pack")


def localize_vehicle(df: DataFrame, lang: str) -> DataFrame:
    """Per field the language's value, else English, and whether there is a translation."""
    english = F.try_element_at("languages", F.lit("en"))
    own = F.try_element_at("languages", F.lit(lang))
    translated = F.lit(lang != "en") & own.isNotNull()
    value = lambda f, *more: first_text(F.when(translated, squash(own[f])), squash(english[f]), *more)
    return df.select(
        "campaignNumber",
        translated.alias("has_translation"),
        *[value(f).alias(f) for f in ("summary", "remedy", "consequence")],
        value("component", squash(F.col("component"))).alias("component"),
    )


def lookup_shape(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Every translation cleaned, English always there (from ``languages.en``, the row, or ``original``), and the codes listed.

    Columns to ``keep`` pass unchanged.
    """
    english = F.try_element_at("languages", F.lit("en"))
    clean = lambda c: F.coalesce(squash(c), F.lit(""))
    base = {
        "summary": first_text(clean(english["summary"]), clean(F.col("summary")), clean(F.col("original.summary"))),
        "remedy": first_text(clean(english["remedy"]), clean(F.col("remedy")), clean(F.col("original.remedy"))),
        "consequence": clean(F.col("original.consequence")),
        "component": clean(F.col("component")),
    }
    names = ("summary", "remedy", "consequence", "component")
    others = F.map_filter(F.col("languages"), lambda k, _: k != "en")
    cleaned = F.transform_values(others, lambda _, v: F.struct(*[clean(v[f]).alias(f) for f in names]))
    own = F.struct(*[first_text(clean(english[f]), base[f]).alias(f) for f in names])
    full = F.map_concat(F.coalesce(cleaned, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<summary:string,remedy:string,consequence:string,component:string>>"))), F.create_map(F.lit("en"), own))
    return df.select("campaignNumber", *keep, *[base[f].alias(f) for f in names], full.alias("translations")).withColumn("languages", F.array_sort(F.map_keys("translations")))


def list_items(df: DataFrame, summary_chars: int = 280) -> DataFrame:
    """What a list shows of a record; a missing title is the slug's words, the summary is plain and clipped."""
    have = df.columns
    none = F.lit(None).cast("string")
    col = lambda c: F.col(c).cast("string") if c in have else none
    array_first = lambda c, f: F.try_element_at(c, F.lit(1))[f] if c in have else none
    slugs = F.get(F.filter(F.transform("categorySlugs", lambda x: F.btrim(x)), lambda x: x != ""), F.lit(0)) if "categorySlugs" in have else none
    slug = F.coalesce(present_text(col("slug")), present_text(F.col("seo.slug") if "seo" in have else none))
    title = F.coalesce(present_text(col("Title")), F.replace(slug, F.lit("-"), F.lit(" ")))
    return df.where(slug.isNotNull()).select(
        slug.alias("slug"),
        title.alias("title"),
        F.coalesce(present_text(col("RecallDate")), present_text(col("lastTranslatedAt")), F.lit("")).alias("recallDate"),
        clip(F.coalesce(strip_tags(col("Description")), F.lit("")), summary_chars).alias("summary"),
        first_text(F.btrim(array_first("Products", "Type")), F.btrim(array_first("Hazards", "Name")), F.btrim(col("productType"))).alias("productType"),
        first_text(F.btrim(array_first("Products", "Name")), F.btrim(col("brand"))).alias("brand"),
        present_text(array_first("Images", "URL")).alias("imageUrl"),
        first_text(F.btrim(col("RecallNumber"))).alias("recallNumber"),
        first_text(F.btrim(col("categoryKey")), F.btrim(col("primaryCategorySlug")), slugs).alias("categoryKey"),
    )


def present_text(c: Column) -> Column:
    return F.nullif(F.btrim(c), F.lit(""))


def names_of(items: Column, field: str) -> Column:
    """The cleaned names of an array of one-field records, blanks left out."""
    return F.filter(F.transform(items, lambda x: squash(x[field])), lambda s: s != "")


def cpsc_facts(df: DataFrame, arrays: dict[str, tuple[str, str]]) -> DataFrame:
    """``arrays`` maps a fact to (array column, field); each becomes a clean array of strings."""
    return df.select(*[c for c in df.columns if c not in {a for a, _ in arrays.values()}], *[names_of(F.col(a), f).alias(name) for name, (a, f) in arrays.items()])


def short_product(product: Column, most: int = 50) -> Column:
    """The product's first segment, clipped."""
    segment = F.btrim(F.get(F.split(F.btrim(product), r"(?i)\s*,\s*Manufactured|\s*,\s*Distributed|\.\s+NDC\s"), 0))
    segment = F.coalesce(F.nullif(segment, F.lit("")), F.btrim(product))
    return F.coalesce(F.nullif(clip(segment, most), F.lit("")), F.lit("Product"))


def recall_cards(df: DataFrame, with_image: Column | None = None) -> DataFrame:
    """Title "short product Recall (year)", brand, day as MM/DD/YYYY, clipped summary and status."""
    have = df.columns
    col = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    date = F.coalesce(present_text(col("report_date")), present_text(col("datePublished")), F.lit(""))
    year = F.when(F.char_length(date) >= 4, F.substring(date, 1, 4)).otherwise("")
    compact = F.replace(date, F.lit("-"), F.lit(""))
    shown = F.when(F.char_length(compact) == 8, F.concat(F.substring(compact, 5, 2), F.lit("/"), F.substring(compact, 7, 2), F.lit("/"), F.substring(compact, 1, 4))).otherwise(date)
    product = first_text(col("productDescription"), col("title"))
    short = short_product(F.when(product == "", "Product").otherwise(product))
    title = F.when(year != "", F.concat(short, F.lit(" Recall ("), year, F.lit(")"))).otherwise(F.concat(short, F.lit(" Recall")))
    section = F.get(F.filter("content", lambda s: F.coalesce(s["text"], F.lit("")) != ""), 0)["text"] if "content" in have else F.lit(None).cast("string")
    raw = F.coalesce(strip_tags(F.nullif(section, F.lit(""))), first_text(col("reason"), col("description"), col("productDescription")))
    image = with_image if with_image is not None else F.lit(False)
    summary = F.when(image, clip(raw, 200, "...")).otherwise(clip(raw, 280, "..."))
    ended = F.when(F.coalesce(col("terminated").cast("boolean"), F.lit(False)), "terminated").otherwise("ongoing")
    return df.select("slug", title.alias("title"), first_text(col("brandName"), F.lit("Unknown brand")).alias("brand"), shown.alias("date"), summary.alias("summary"), ended.alias("status"))


def _has_facts(s: Column) -> Column:
    return F.coalesce(s["facts"], F.lit("")) != ""


def _official(s: Column, markers: Sequence[str]) -> Column:
    low = F.lower(F.btrim(F.coalesce(s["subtitle"], F.lit(""))))
    out = F.lit(False)
    for m in markers:
        out = out | low.contains(m)
    return out


def _said(s: Column, words: str) -> Column:
    return F.contains(F.lower(F.btrim(F.coalesce(s["subtitle"], F.lit("")))), F.lit(words))


def _first_index(content: Column, test) -> Column:
    """0-based place of the first section that passes, or null."""
    places = F.filter(F.transform(content, lambda s, i: F.when(test(s), i)), lambda i: i.isNotNull())
    return F.get(places, 0)


def split_sections(df: DataFrame, content: str = "content", english: str = "en_content", markers: Sequence[str] = OFFICIAL_MARKERS) -> DataFrame:
    """The sections on what was recalled and on the official source, and the main flow without those and the reason.

    Sections are found by the English headings where both arrays are equally long, else by the
    language's own.
    """
    c, e = F.col(content), F.col(english)
    aligned = (F.size(e) > 0) & (F.size(e) == F.size(c))
    what = lambda s: _has_facts(s) | _said(s, "what was recalled")
    reason = lambda s: _said(s, "reason for recall")
    named = lambda s: _said(s, "official source")
    any_official = lambda s: _official(s, markers)
    i_what, i_named, i_any, i_reason = (_first_index(e, t) for t in (what, named, any_official, reason))
    own_what, own_official = F.get(F.filter(c, _has_facts), 0), F.get(F.filter(c, any_official), 0)
    i_official = F.coalesce(i_named, i_any)
    gone = F.array(i_what, i_official, i_reason)
    main = F.when(aligned, F.filter(c, lambda s, i: ~F.array_contains(F.filter(gone, lambda x: x.isNotNull()), i))).otherwise(F.filter(c, lambda s: ~(reason(s) | any_official(s) | what(s))))
    return df.withColumns(
        {
            "what_was_recalled": F.coalesce(F.when(aligned, F.get(c, i_what)), own_what),
            "official_source": F.coalesce(F.when(aligned, F.get(c, i_named)), own_official),
            "main_sections": main,
        }
    )


def editorial_sections(df: DataFrame, content: str = "content", remedies: str | None = None, options: str | None = None) -> DataFrame:
    """Sections worth showing, and whether the remedy options differ from the remedies."""
    skip = lambda s: _said(s, "recall summary") | _said(s, "what was recalled") | _said(s, "company contact")
    full = lambda s: (F.coalesce(s["text"], F.lit("")) != "") | (F.coalesce(F.size(s["faq"]), F.lit(0)) > 0) | (F.coalesce(F.size(s["authorityLinks"]), F.lit(0)) > 0)
    out = df.withColumn("editorial", F.filter(content, lambda s: ~skip(s) & full(s)))
    if remedies and options:
        norm = lambda a: F.array_sort(F.filter(F.transform(a, lambda x: F.lower(F.btrim(x))), lambda x: x != ""))
        out = out.withColumn("show_options", (F.size(options) > 0) & (norm(F.col(remedies)) != norm(F.col(options))))
    return out
