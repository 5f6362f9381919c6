"""Counts, headers, facets and checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.functions.text import squash
from noticeloom.operators.filters import require_key


def page_header(df: DataFrame, page: int = 1, limit: int = 0, default: int = 8, most: int = 100) -> DataFrame:
    """G1: one row: total, page, limit and number of pages, all clamped."""
    limit = min(max(limit, 1), most) if limit else default
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / limit)).cast("long")
    return df.agg(F.count("*").alias("total")).select("total", F.lit(max(page, 1)).alias("page"), F.lit(limit).alias("limit"), pages.alias("totalPages"))


def counts_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """Rows per key."""
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def stored_bounds(df: DataFrame, date: str, order: str, base: int) -> DataFrame:
    """Newest stored date, smallest and largest sort order; an empty table gives the base."""
    return df.agg(F.max(date).alias("newest"), F.coalesce(F.min(order), F.lit(base)).alias("min_order"), F.coalesce(F.max(order), F.lit(base)).alias("max_order"))


def last_modified(df: DataFrame, key: str, dates: Sequence[Column], run_ts: Column) -> DataFrame:
    """Per key the latest of each row's first date that is there, else the time of the run."""
    return require_key(df, key).groupBy(F.btrim(key).alias(key)).agg(F.max(F.coalesce(*dates, run_ts)).alias("last_modified"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Trimmed keys that occur more than once; blanks are ignored."""
    return require_key(df, key).groupBy(squash(F.col(key)).alias(key)).agg(F.count("*").alias("n")).where("n > 1")


def category_membership(df: DataFrame, key: str, category: str, order: Sequence[Column]) -> DataFrame:
    """Per record its categories, and the one of the winning row."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(category)).alias("categories"), F.min_by(category, F.struct(*order)).alias("primary_category"))


def first_rows_stored(rows: DataFrame, stored: DataFrame, key: str, order: Sequence[Column], n: int = 5) -> DataFrame:
    """Whether the first ``n`` rows of a listing are all stored; no rows: false."""
    first = rows.orderBy(*order).limit(n).select(F.col(key).alias("k"))
    seen = stored.select(F.col(key).alias("k")).distinct().withColumn("seen", F.lit(True))
    hit = first.join(seen, "k", "left")
    return hit.agg(F.coalesce(F.bool_and(F.coalesce("seen", F.lit(False))), F.lit(False)).alias("all_stored"))


def run_capacity(stored: DataFrame, max_records: int, max_total: int) -> DataFrame:
    """How many records a run may add: what is missing to the total, else the run's own limit."""
    n = F.count("*")
    limit = F.when(n >= max_total, F.lit(max_records)).otherwise(F.least(F.lit(max_records), F.lit(max_total) - n))
    return stored.agg(n.alias("stored"), limit.cast("long").alias("run_limit"), F.greatest(F.lit(0), F.lit(max_total) - n).cast("long").alias("backfill"))
