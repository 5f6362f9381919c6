"""Lists, suggestions, search, details and the sitemap."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.functions.values import url_encoded
from noticeloom.operators.aggregates import page_header
from noticeloom.operators.filters import filter_brand, filter_category, filter_general, filter_recalls, filter_year
from noticeloom.operators.joins import asked_campaigns, lookup, new_records, repeated, stored_or_raw
from noticeloom.operators.localize import first_text, list_items, localize_fda, split_sections
from noticeloom.operators.metadata import BASE
from noticeloom.operators.ordering import first_of_hash, global_rank, winners


def newest(df: DataFrame, date: str = "report_date", tie: str = "slug") -> list[Column]:
    return [F.col(date).desc_nulls_last(), F.col(tie).asc_nulls_first()]


def page_of(df: DataFrame, order: Sequence[Column], page: int, limit: int) -> DataFrame:
    """One page: a top-k that each task cuts before the rows meet."""
    return df.orderBy(*order).offset((max(page, 1) - 1) * limit).limit(limit)


def fda_list_page(df: DataFrame, q: str | None, category: str | None, page: int = 1, limit: int = 8) -> tuple[DataFrame, DataFrame]:
    """Q1: the page and its header."""
    found = filter_recalls(df, q, category)
    return page_of(found, newest(df), page, limit), page_header(found, page, limit)


def localized_list_page(df: DataFrame, lang: str, q: str | None, category: str | None, page: int = 1, limit: int = 8) -> DataFrame:
    """Q1 whole: the rows of a page in a language, localised once they are few, each with the header; a page without rows is one row of the header."""
    found, header = fda_list_page(df, q, category, page, limit)
    rows = localize_fda(found, lang).withColumn("shown", F.lit(True))
    return header.join(rows, F.lit(True), "left")  # a row and a page


def category_page(df: DataFrame, slug: str, limit: int = 200) -> DataFrame:
    return filter_category(df, slug, strict=True).orderBy(*newest(df)).limit(limit)


def brand_page(df: DataFrame, brand: str, date: str = "report_date", tie: str = "slug", limit: int = 200) -> DataFrame:
    return filter_brand(df, brand).orderBy(*newest(df, date, tie)).limit(limit)


def year_page(df: DataFrame, year: str, limit: int = 500) -> DataFrame:
    return filter_year(df, year).orderBy(*newest(df)).limit(limit)


def fda_suggest(df: DataFrame, q: str, k: int = 8, fields: Sequence[str] = ("headline", "title", "productType")) -> DataFrame:
    """Q5: the newest matches, 1 to 10; an empty query has none."""
    if not q.strip():
        return df.limit(0)
    return filter_recalls(df, q, None, fields).orderBy(*newest(df)).limit(min(max(k, 1), 10))


def general_index(df: DataFrame, key: Column, newest_col: str, languages: str, ties: Sequence[str]) -> DataFrame:
    """The general list: one row a real recall, as list items."""
    return list_items(winners(df, key, newest_col, languages, ties))


def _item_order() -> list[Column]:
    seconds = F.coalesce(F.unix_seconds(F.try_to_timestamp("recallDate")), F.lit(0))
    return [seconds.desc(), F.col("slug").asc()]


def general_list_page(items: DataFrame, q: str | None, page: int = 1, limit: int = 50) -> DataFrame:
    """Q6: newest first, dates that cannot be read last."""
    return page_of(filter_general(items, q), _item_order(), page, limit)


def general_suggest(items: DataFrame, q: str, k: int = 8) -> DataFrame:
    """Q7: the first matches of the list."""
    kind = F.coalesce(F.nullif("productType", F.lit("")), F.lit("Consumer product"))
    if not q.strip():
        return items.limit(0)
    return filter_general(items, q).orderBy(*_item_order()).limit(min(max(k, 1), 10)).select("slug", "title", kind.alias("productType"))


def pending_queue(records: DataFrame, stored: DataFrame, keys: Sequence[tuple[str, str]], hash_col: str, order: Sequence[Column], limit: int) -> DataFrame:
    """Q9: the first new records of a run, duplicates within the batch left out."""
    fresh = first_of_hash(new_records(records, stored, keys), hash_col, order)
    return fresh.orderBy(*order).limit(limit)


def vehicle_lookup(vehicles: DataFrame, campaigns: DataFrame, stored: DataFrame, key: str, fields: Sequence[str], shape: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Q12: campaigns of the vehicles asked for, the stored text before the raw one, a row for each vehicle.

    The key names one row of ``campaigns``, which a number alone need not do; of stored rows with the same key one counts. Texts are chosen, and brought into
    ``shape``, once a campaign; its rows for equal vehicles are made in the end. ``shape`` must pass the column ``vehicles``.
    """
    found = stored_or_raw(asked_campaigns(vehicles, campaigns), stored.dropDuplicates([key]), key, fields, ["campaignNumber", "vehicles"]).drop(key)
    return repeated(shape(found) if shape else found, "vehicles")


def sitemap(sources: Sequence[tuple[DataFrame, str, str, float]], statics: Sequence[tuple[str, float]], run_ts: Column, base: str = BASE, cap: int = 50_000) -> DataFrame:
    """Q13: fixed pages and every key of each source (key, last change, path, priority), each address once.

    The first source that has an address wins. Addresses follow each other by source and key;
    ``over_cap`` says whether there are more than one file may hold.
    """
    spark = sources[0][0].sparkSession
    fixed = spark.createDataFrame([(0, str(i), base + path, priority) for i, (path, priority) in enumerate(statics)], "source int, key string, url string, priority double").withColumn("last_modified", run_ts)
    out = fixed.select("source", "key", "url", "last_modified", "priority")
    for i, (df, key, path, priority) in enumerate(sources, 1):
        url = F.concat(F.lit(f"{base}{path}"), url_encoded(F.col(key)))
        out = out.unionByName(df.select(F.lit(i).alias("source"), F.col(key).alias("key"), url.alias("url"), F.coalesce("last_modified", run_ts).alias("last_modified"), F.lit(priority).alias("priority")))
    once = out.groupBy("url").agg(F.min_by(F.struct("source", "key", "last_modified", "priority"), F.struct("source", "key")).alias("x")).select("url", "x.*")
    total = once.agg((F.count("*") > cap).alias("over_cap"))
    return once.crossJoin(F.broadcast(total))


def sitemap_entries(sources: Sequence[tuple[DataFrame, str, str, float]], statics: Sequence[tuple[str, float]], run_ts: Column, base: str = BASE, cap: int = 50_000) -> DataFrame:
    """Q13 whole: the sitemap with ``position``, from 1, by source and key; ranked by ranges."""
    return global_rank(sitemap(sources, statics, run_ts, base, cap), ["source", "key"], "position")


def append_new(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored and new documents; fields that one side lacks are null."""
    return stored.unionByName(new, allowMissingColumns=True)


def registry_union(*hashes: DataFrame) -> DataFrame:
    """Every hash once."""
    out = hashes[0].select("hash")
    for h in hashes[1:]:
        out = out.union(h.select("hash"))
    return out.where("hash is not null and hash <> ''").distinct()


def detail(df: DataFrame, keys: DataFrame, key: str = "slug") -> DataFrame:
    """Q11: the rows asked for; what localises and splits them follows."""
    return lookup(df, keys, key)


def detail_record(df: DataFrame, keys: DataFrame, lang: str, key: str = "slug", content: str = "content") -> DataFrame:
    """Q11 whole: the records asked for in a language, their sections told apart, facts before what the record says at its top.

    A field is that of the language's slice, else of English, else the record's own. The sections are the record's own in English,
    else the slice's; what was recalled, the official source and the main flow are found as in P18, and the facts of what was
    recalled (company, brand, product, kind; JSON, as in P27) win over the fields.
    """
    rows = detail(df, keys, key)
    own = F.coalesce(F.try_element_at("languages", F.lit(lang)), F.try_element_at("languages", F.lit("en")))
    english = F.try_element_at("languages", F.lit("en"))
    top = lambda f: F.col(f) if f in df.columns else F.lit(None).cast("string")
    field = lambda f: first_text(own[f], top(f))
    nothing = F.filter(F.col(content), lambda s: F.lit(False))
    shown = F.coalesce(F.col(content), own["content"]) if lang == "en" else F.coalesce(own["content"], F.col(content))
    rows = rows.withColumns({"d_content": F.coalesce(shown, nothing), "d_english": F.coalesce(english["content"], F.col(content), nothing)})
    rows = split_sections(rows, "d_content", "d_english")
    facts = F.from_json(F.col("what_was_recalled")["facts"], "company string, brand string, product string, productType string")
    return rows.select(
        key,
        first_text(own["title"], top("title")).alias("title"),
        first_text(facts["company"], top("companyName")).alias("company"),
        first_text(facts["brand"], field("brandName")).alias("brand"),
        first_text(facts["product"], field("productDescription")).alias("product"),
        first_text(facts["productType"], field("productType")).alias("productType"),
        field("reason").alias("reason"),
        "what_was_recalled",
        "official_source",
        "main_sections",
    )
