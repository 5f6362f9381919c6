"""Whole documents of notices: links, contacts, tables and sections from facts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.functions.text import escape_html, squash
from noticeloom.operators.localize import first_text

#: The sentences that the served documents are made of, with the facts that they take.
NOTICE_LINK = "Read the official FDA recall notice {link}."
LOT_LINK = "Check lot or replacement information {link}."
PORTAL, MEDWATCH, ADVERSE = "Report an adverse event through the FDA Safety Reporting Portal", "Report an adverse event through FDA MedWatch", "Report an adverse event"
SUPPORT, COMPANY = "Review consumer support information", "Visit the company website for product details"
ANCHOR = "<a href='{url}' target='_blank' rel='noopener noreferrer'>{word}</a>"
ON_NOTICE, ON_LOT, ELSEWHERE = "on the FDA website", "on the company support page", "here"
CONSUMER_LINE, MEDIA_LINE = "Consumer support: {parts}", "Media contact: {parts}"
ANSWER = "<p>{entity} recalled {product} because {reason}. The FDA notice was published on {date}.</p>"
SUMMARY = "<p>{entity} announced a recall involving {product}. The recall reason listed by FDA is {reason}.</p>"
UNKNOWN = {"entity": "The company", "product": "the affected product", "reason": "the recall issue described in the FDA notice"}
FAQ = (("What product is recalled?", "{product} is listed in the FDA notice."), ("Why was it recalled?", "{reason}"), ("Where can I verify the recall?", "Use the official FDA recall notice linked on this page."))
SUBTITLES = (
    "Quick Answer", "Recall Summary", "What Was Recalled", "How to Identify the Recalled Product", "What You Should Do", "Risk Overview",
    "Who May Be Affected", "Health and Safety Context", "Company Contact Information", "About the Company", "Frequently Asked Questions", "Source and Verification",
)

#: Advice that every document gives, in words of its own; a deployment may pass others.
ADVICE = {
    "identify": "<p>Hold the label against the notice and its tables: brand, name, size, lot or batch, barcode and date must agree.</p>",
    "do": "<p>If your item is one of those recalled, put it aside, keep its package, and do as the notice and the company say.{contact}</p>",
    "risk": "<p>There is a risk only to those who hold an item that the notice describes; how large it is depends on the item and its use.</p>",
    "who": "<p>Whoever bought, sold, used or gave away {product} should look for the recalled details.</p>",
    "health": "<p>This is information and no medical advice. Who feels unwell should see a health professional and may report it to the FDA.</p>",
    "source": "<p>Written from the company announcement that the FDA posted; its tables are kept, and the original is linked below.</p>",
}

SECTION = "struct<subtitle:string,text:string,facts:string,faq:array<struct<question:string,answer:string>>,authorityLinks:array<string>>"


def filled(template: str, **values: Column) -> Column:
    """A sentence with its facts put in."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if p])


def _text(df: DataFrame, name: str) -> Column:
    return squash(F.coalesce(F.col(name), F.lit(""))) if name in df.columns else F.lit("")


def authority_links(df: DataFrame) -> DataFrame:
    """``authorityLinks``: sentences that lead to the notice, the lot check, reporting sites, consumer support and the company, each once.

    A consumer or company address that has been given already is not given again.
    """
    col = lambda c: F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("")
    notice, lot, consumer, company = map(col, ("detailUrl", "lotCheckUrl", "consumerWebsite", "companyWebsite"))
    reports = F.array_distinct(F.filter(F.coalesce(F.col("reportingUrls"), F.array().cast("array<string>")), lambda u: squash(u) != "")) if "reportingUrls" in df.columns else F.array().cast("array<string>")
    anchor = lambda url, word: filled(ANCHOR, url=url, word=F.lit(word))
    report = lambda url, other: F.when(F.lower(url).contains("safetyreporting.hhs.gov"), PORTAL).when(F.lower(url).contains("medwatch"), MEDWATCH).otherwise(other)
    line = lambda label, url: F.concat(label, F.lit(" "), anchor(url, ELSEWHERE), F.lit("."))
    site = F.when(F.lower(company).rlike(r"fda\.gov/(safety/)?medwatch"), MEDWATCH).otherwise(COMPANY)
    one = lambda test, sentence: F.when(test, F.array(sentence)).otherwise(F.array().cast("array<string>"))
    told = F.array_contains(reports, consumer), F.array_contains(reports, company)
    links = F.concat(
        one(notice != "", filled(NOTICE_LINK, link=anchor(notice, ON_NOTICE))),
        one(lot != "", filled(LOT_LINK, link=anchor(lot, ON_LOT))),
        F.transform(reports, lambda u: line(report(u, ADVERSE), u)),
        one((consumer != "") & ~told[0], line(report(consumer, SUPPORT), consumer)),
        one((company != "") & (company != consumer) & (company != lot) & ~told[1], line(site, company)),
    )
    return df.withColumn("authorityLinks", F.array_distinct(links))


def contact_text(df: DataFrame) -> DataFrame:
    """``contactText``: a line for consumers and one for the press, of what ``consumers`` and ``media`` hold."""

    def line(side: str, fields: tuple[str, ...], template: str) -> Column:
        if side not in df.columns:
            return F.lit("")
        parts = F.filter(F.array(*[squash(F.coalesce(F.col(side)[f], F.lit(""))) for f in fields]), lambda t: t != "")
        return F.when(F.size(parts) > 0, filled(template, parts=F.array_join(parts, " | "))).otherwise("")

    lines = F.array(line("consumers", ("organization", "phone", "email"), CONSUMER_LINE), line("media", ("name", "role", "email", "phone"), MEDIA_LINE))
    return df.withColumn("contactText", F.array_join(F.filter(lines, lambda t: t != ""), "\n"))


def tables_html(tables: Column) -> Column:
    """Tables (``headers``, ``rows``) as HTML, escaped; those without headers or filled rows are left out."""
    cell = lambda tag, c: F.concat(F.lit(f"<{tag}>"), escape_html(squash(F.coalesce(c, F.lit("")))), F.lit(f"</{tag}>"))
    heads = lambda t: F.filter(t["headers"], lambda h: squash(F.coalesce(h, F.lit(""))) != "")
    rows = lambda t: F.filter(t["rows"], lambda r: F.exists(r, lambda c: squash(F.coalesce(c, F.lit(""))) != ""))
    line = lambda n: lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: cell("td", F.get(r, i))), ""), F.lit("</tr>"))
    body = lambda t: F.array_join(F.transform(rows(t), line(F.size(heads(t)))), "")
    html = lambda t: F.concat(F.lit("<table><thead><tr>"), F.array_join(F.transform(heads(t), lambda h: cell("th", h)), ""), F.lit("</tr></thead><tbody>"), body(t), F.lit("</tbody></table>"))
    return F.array_join(F.transform(F.filter(tables, lambda t: (F.size(heads(t)) > 0) & (F.size(rows(t)) > 0)), html), "\n")


def keywords(df: DataFrame, year: Column) -> Column:
    """Up to fifteen distinct words for a notice: the standing ones, its facts and the regulated products."""
    standing = F.array(F.lit("FDA recall"), F.concat(year, F.lit(" FDA recall")), *[_text(df, c) for c in ("companyName", "brandName", "productDescription", "productType", "reason")])
    more = F.transform(F.col("regulatedProducts"), squash) if "regulatedProducts" in df.columns else F.array().cast("array<string>")
    return F.slice(F.array_distinct(F.filter(F.concat(standing, F.coalesce(more, F.array().cast("array<string>"))), lambda w: w != "")), 1, 15)


def document_sections(df: DataFrame, published: Column, advice: dict[str, str] | None = None) -> DataFrame:
    """``content``: the twelve sections of a notice's document in order, made of its facts; those without anything to say are left out.

    ``published`` is the notice's date as text, or its year. Facts that are missing read as ``UNKNOWN`` in sentences and are left out of the
    facts; tables follow the summary and are among the facts. Links and contacts are those of ``authority_links`` and ``contact_text``.
    """
    advice = {**ADVICE, **(advice or {})}
    df = contact_text(authority_links(df))
    company, brand, product, kind, reason = (_text(df, c) for c in ("companyName", "brandName", "productDescription", "productType", "reason"))
    plain = {"entity": first_text(brand, company, F.lit(UNKNOWN["entity"])), "product": first_text(product, F.lit(UNKNOWN["product"])), "reason": first_text(reason, F.lit(UNKNOWN["reason"]))}
    safe = {k: escape_html(v) for k, v in (plain | {"date": published}).items()}
    contact = F.when(F.col("contactText") != "", F.concat(F.lit(" "), escape_html(F.col("contactText")))).otherwise("")
    tables = F.coalesce(F.col("tables"), F.array().cast("array<struct<headers:array<string>,rows:array<array<string>>>>")) if "tables" in df.columns else None
    html = tables_html(tables) if tables is not None else F.lit("")
    held = {"company": company, "brand": brand, "product": product, "productType": kind, "reason": reason}
    facts = [F.nullif(v, F.lit("")).alias(k) for k, v in held.items()]
    if tables is not None:
        facts.append(F.when(F.size(tables) > 0, tables).alias("affectedProductTables"))
    as_json = F.to_json(F.struct(*facts), {"ignoreNullFields": "true"})
    summary = filled(SUMMARY, **safe)
    texts = {
        "Quick Answer": filled(ANSWER, **safe),
        "Recall Summary": F.when(html != "", F.concat(summary, F.lit("\n"), html)).otherwise(summary),
        "How to Identify the Recalled Product": F.lit(advice["identify"]),
        "What You Should Do": filled(advice["do"], contact=contact, **safe),
        "Risk Overview": F.lit(advice["risk"]),
        "Who May Be Affected": filled(advice["who"], **safe),
        "Health and Safety Context": F.lit(advice["health"]),
        "Company Contact Information": F.col("contactText"),
        "About the Company": _text(df, "aboutCompanyText"),
        "Source and Verification": F.lit(advice["source"]),
    }
    nothing = F.lit(None)
    faq = F.array(*[F.struct(F.lit(q).alias("question"), filled(a, **plain).alias("answer")) for q, a in FAQ])

    def section(subtitle: str) -> Column:
        own = {"facts": F.when(as_json != "{}", as_json) if subtitle == "What Was Recalled" else nothing, "faq": faq if subtitle == "Frequently Asked Questions" else nothing, "authorityLinks": F.when(F.size("authorityLinks") > 0, F.col("authorityLinks")) if subtitle == "Source and Verification" else nothing}
        text = F.nullif(texts[subtitle], F.lit("")) if subtitle in texts else nothing
        return F.struct(F.lit(subtitle).alias("subtitle"), text.alias("text"), *[v.alias(k) for k, v in own.items()]).cast(SECTION)

    some = lambda s: s["text"].isNotNull() | s["facts"].isNotNull() | s["faq"].isNotNull() | s["authorityLinks"].isNotNull()
    return df.withColumn("content", F.filter(F.array(*map(section, SUBTITLES)), some))
