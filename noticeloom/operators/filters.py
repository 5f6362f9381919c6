"""Predicates and row splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.functions.text import BLANKS, squash

#: The categories served, the urgent words, the boilerplate of investor notices.
CATEGORIES = ("drugs", "food", "medical-devices", "supplements")
URGENT = ("fire", "injury", "crash", "death")
BOILERPLATE = (
    "forward-looking",
    "private litigation securities reform act",
    "no obligation to update",
    "risk factors",
    "sec",
    "securities and exchange commission",
    "form 10-k",
    "financial performance",
    "guidance, estimates and projections",
    "current expectations, assumptions, plans",
    "materially different from its current expectations",
    "company undertakes no obligation",
)
#: The fields that a list's search looks into.
LIST_FIELDS = ("headline", "title", "productType", "productDescription", "slug")
GENERAL_FIELDS = ("slug", "title", "summary", "productType", "brand", "recallNumber")


def serving_columns(df: DataFrame, published: str = "datePublished", terminated: str = "terminatedRecall") -> DataFrame:
    """``report_date`` (from the publication date if missing), ``year`` and a boolean ``terminated``."""
    have = df.columns
    date = F.date_format(published, "yyyyMMdd") if published in have else F.lit(None).cast("string")
    report = F.coalesce("report_date", date) if "report_date" in have else date
    ended = F.lower(squash(F.col(terminated)))
    return df.withColumn("report_date", report).withColumn("year", F.substring("report_date", 1, 4)).withColumn("terminated", F.coalesce(~ended.isin("", "no", "false"), F.lit(False)))


def filter_category(df: DataFrame, slug: str | None, strict: bool = False) -> DataFrame:
    """One category; an unknown one filters nothing, or everything if ``strict`` (blanks then read as hyphens)."""
    key = (slug or "").strip().lower()
    key = "-".join(key.split()) if strict else key
    if key in CATEGORIES:
        return df.where(F.col("browseCategory") == key)
    return df.limit(0) if strict else df


def _holds(df: DataFrame, fields: Sequence[str], q: str) -> Column:
    own = [F.coalesce(F.lower(F.col(f)).contains(q.lower()), F.lit(False)) for f in fields if f in df.columns]
    return F.greatest(*own) if len(own) > 1 else own[0] if own else F.lit(False)


def filter_recalls(df: DataFrame, q: str | None = None, category: str | None = None, fields: Sequence[str] = LIST_FIELDS) -> DataFrame:
    """``q`` as a literal, any case, in any of the fields, and the category."""
    q = (q or "").strip()
    df = filter_category(df, category)
    return df.where(_holds(df, fields, q)) if q else df


def filter_general(df: DataFrame, q: str | None, fields: Sequence[str] = GENERAL_FIELDS) -> DataFrame:
    """Every word of ``q`` occurs in the fields joined by blanks."""
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields if f in df.columns]))
    for word in (q or "").lower().split():
        df = df.where(hay.contains(word))
    return df


def filter_brand(df: DataFrame, brand: str) -> DataFrame:
    return df.where(F.col("brandName") == brand)


def filter_year(df: DataFrame, year: str) -> DataFrame:
    return df.where(F.col("report_date").startswith(str(year)))


def require_key(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key is neither null nor blank."""
    return df.where(F.col(key).isNotNull() & (squash(F.col(key)) != ""))


def triage_searches(df: DataFrame, query: str = "query", ts: str = "ts") -> DataFrame:
    """Searches per day and kind: a 17-character vehicle number, or text."""
    vin = F.upper(F.regexp_replace(query, BLANKS, "")).rlike("^[A-HJ-NPR-Z0-9]{17}$")
    return df.groupBy(F.to_date(ts).alias("day"), F.when(vin, "vin").otherwise("text").alias("kind")).agg(F.count("*").alias("n"))


def flag_urgent(df: DataFrame, fields: Sequence[str] = ("summary", "consequence"), words: Sequence[str] = URGENT) -> DataFrame:
    hay = F.lower(F.concat_ws(" ", *fields))
    flag = F.lit(False)
    for w in words:
        flag = flag | hay.contains(w)
    return df.withColumn("urgent", flag)


def split_paragraphs(df: DataFrame, text: str, blocked: Sequence[str] = BOILERPLATE) -> DataFrame:
    """P10: the paragraphs of a text, those to show and those of boilerplate."""
    paragraphs = F.filter(F.transform(F.split(text, "\n"), squash), lambda p: p != "")
    pattern = "|".join(rf"\Q{b}\E" for b in blocked)
    # each paragraph is judged once, for both sides
    judged = df.withColumn("judged", F.transform(paragraphs, lambda p: F.struct(p.alias("text"), F.lower(p).rlike(pattern).alias("bad"))))
    side = lambda bad: F.transform(F.filter("judged", lambda x: x["bad"] == bad), lambda x: x["text"])
    return judged.withColumn("kept", side(False)).withColumn("rejected", side(True)).drop("judged")


def explode_components(df: DataFrame, component: str = "component") -> DataFrame:
    """P20: a row per clause of ``A:B:C``, with its level from 1."""
    parts = F.filter(F.transform(F.split(component, ":"), squash), lambda p: p != "")
    return df.select("*", F.posexplode(parts).alias("level", "clause")).withColumn("level", F.col("level") + 1)
