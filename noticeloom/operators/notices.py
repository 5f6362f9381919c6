"""Contacts, links, pages and tables of landed notices."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.functions.text import escape_html, squash
from noticeloom.functions.values import link_url

#: Patterns that read alike in Java and RE2; fixed values.
EMAIL = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
PHONE = r"(?:\+?1[ .-]?)?(?:\(?\d{3}\)?[ .-]*)\d{3}[ .-]*\d{4}"
LINK = r"(?i)(?:https?://[^\s<>()]+|www\.[^\s<>()]+|(?:[a-z0-9-]+\.)+[a-z]{2,}/[^\s<>()]+|(?:[a-z0-9-]+\.)+[a-z]{2,})"
REPORTING = r"safetyreporting\.hhs\.gov|fda\.gov/medwatch|fda\.gov/safety/medwatch|medwatch/report"
LOT_CHECK = r"check-pods|check|lot|replacement|recall|corrective-action"
CONSUMER = r"support|current-podders|customer|consumer|medwatch|report"


def text_contacts(df: DataFrame, text: str) -> DataFrame:
    """Addresses, e-mails and phone numbers of a text, each once, in the order seen."""
    t = F.col(text)
    found = lambda p: F.array_distinct(F.regexp_extract_all(t, F.lit(p), F.lit(0)))
    urls = F.array_distinct(F.filter(F.transform(found(LINK), link_url), lambda u: u != ""))
    return df.withColumns({"urls": urls, "emails": found(EMAIL), "phones": found(PHONE)})


def route_links(df: DataFrame, links: str, fallback: str | None = None) -> DataFrame:
    """Links for reporting, lot checks, consumers and the company.

    A link goes to the first use that fits and is still free, so they are folded in order. A reporting
    link also fills an empty consumer slot. Without a company link the first plain domain of ``fallback``
    serves.
    """
    empty = F.struct(F.array().cast("array<string>").alias("reporting"), *[F.lit("").alias(n) for n in ("lot", "consumer", "company")])

    def step(acc: Column, href: Column) -> Column:
        low = F.lower(href)
        made = lambda **new: F.struct(*[new.get(n, acc[n]).alias(n) for n in ("reporting", "lot", "consumer", "company")])
        return (
            F.when(low.rlike(REPORTING), made(reporting=F.concat(acc["reporting"], F.array(href)), consumer=F.when(acc["consumer"] == "", href).otherwise(acc["consumer"])))
            .when((acc["lot"] == "") & low.rlike(LOT_CHECK), made(lot=href))
            .when((acc["consumer"] == "") & low.rlike(CONSUMER), made(consumer=href))
            .when((acc["company"] == "") & ~low.contains("fda.gov") & ~low.contains("safetyreporting.hhs.gov"), made(company=href))
            .otherwise(acc)
        )

    out = df.withColumn("routed", F.aggregate(F.array_distinct(links), empty, step))
    plain = F.lit("")
    if fallback:
        plain = F.coalesce(F.get(F.filter(fallback, lambda u: ~u.contains("fda.gov") & ~F.lower(u).rlike("medwatch|report")), 0), F.lit(""))
    return out.select(*df.columns, F.col("routed.reporting").alias("reportingUrls"), F.col("routed.lot").alias("lotCheckUrl"), F.col("routed.consumer").alias("consumerWebsite"), F.when(F.col("routed.company") != "", F.col("routed.company")).otherwise(plain).alias("companyWebsite"))


def contacts_block(df: DataFrame, facts: str = "facts") -> DataFrame:
    """A consumer and a media record from (term, text) facts of a page."""
    of = lambda word: F.array_join(F.transform(F.filter(facts, lambda f: F.lower(f["term"]).contains(word)), lambda f: f["text"]), " ")
    first = lambda c, p: F.nullif(F.regexp_extract(c, p, 0), F.lit(""))
    make = lambda word: F.struct(F.nullif(of(word), F.lit("")).alias("label"), first(of(word), EMAIL).alias("email"), first(of(word), PHONE).alias("phone"))
    return df.withColumn("contacts", F.struct(make("consumer").alias("consumers"), make("media").alias("media")))


class _Page(HTMLParser):
    """Title, headings, paragraphs, list items, facts, links, images and tables of a page, however untidy."""

    SKIP = frozenset({"script", "style", "nav", "footer"})
    BLOCKS = frozenset({"title", "h1", "h2", "h3", "p", "li", "dt", "dd", "td", "th"})

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str]] = []
        self.links: list[str] = []
        self.images: list[str] = []
        self.tables: list[list[list[tuple[str, int, int, bool]]]] = []
        self.open: list[str] = []
        self.text: list[str] = []
        self.kind = ""
        self.span = (1, 1)

    def close_block(self) -> None:
        text = " ".join("".join(self.text).replace("\xa0", " ").split())
        if self.kind in ("td", "th"):
            if self.tables and self.tables[-1]:
                self.tables[-1][-1].append((text, *self.span, self.kind == "th"))
        elif self.kind and text:
            self.blocks.append((self.kind, text))
        self.text, self.kind = [], ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        got = {k: v or "" for k, v in attrs}
        if tag in self.SKIP:
            self.open.append(tag)
        if self.open:
            return
        if tag == "a" and got.get("href"):
            self.links.append(got["href"])
        if tag == "img":
            sets = [c.split() for c in got.get("srcset", "").split(",") if c.strip()]
            widest = max(sets, key=lambda c: float(c[1][:-1]) if len(c) > 1 and c[1][:-1].replace(".", "").isdigit() else 0.0, default=[got.get("src", "")])
            if widest[0]:
                self.images.append(widest[0].split("?")[0])
        if tag in ("br", "div") and self.kind:
            self.text.append(" ")
        if tag == "table":
            self.close_block()
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.close_block()
            self.tables[-1].append([])
        elif tag in self.BLOCKS:
            self.close_block()
            self.kind = tag
            number = lambda n: max(1, int(got[n])) if got.get(n, "").isdigit() else 1
            self.span = (number("rowspan"), number("colspan"))

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIP:
            if tag in self.open:
                while self.open and self.open.pop() != tag:
                    pass
        elif not self.open and (tag == self.kind or tag in ("table", "tr", "article", "ul", "dl", "body")):
            self.close_block()

    def handle_data(self, data: str) -> None:
        if not self.open and self.kind:
            self.text.append(data)


def read_page(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    page.close()
    page.close_block()
    return page


def table_grid(rows: list[list[tuple[str, int, int, bool]]]) -> tuple[list[str], list[list[str]]]:
    """Headers and rows of a table with its row and column spans filled in; rows are as wide as the headers."""
    cells: dict[tuple[int, int], str] = {}
    for r, row in enumerate(rows):
        c = 0
        for text, down, across, _ in row:
            while (r, c) in cells:
                c += 1
            cells.update({(r + i, c + j): text for i in range(down) for j in range(across)})
            c += across
    height = max((r for r, _ in cells), default=-1) + 1
    lines = [[cells.get((r, c), "") for c in range(max((k[1] for k in cells if k[0] == r), default=-1) + 1)] for r in range(height)]
    head = next((i for i, row in enumerate(rows) if any(h for *_, h in row)), 0)
    body = [line for line in lines[head + 1 :] if any(line)]
    headers = [h for h in lines[head] if h] if lines else []
    if not headers and body:
        headers = [f"Column {i + 1}" for i in range(len(body[0]))]
    return headers, [(line + [""] * len(headers))[: len(headers)] for line in body] if headers else []


def extract_notices(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """C11: title, paragraphs, bullets, facts, links and images of every page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, source in zip(frame[key], frame[html], strict=True):
                page = read_page(source)
                texts = lambda *kinds: [t for b, t in page.blocks if b in kinds]  # noqa: B023, E731
                terms = [(b, t) for b, t in page.blocks if b in ("dt", "dd")]
                facts = [{"term": a[1], "text": b[1]} for a, b in zip(terms, terms[1:], strict=False) if a[0] == "dt" and b[0] == "dd"]
                heading = next(iter(texts("h1") or texts("title")), "")
                out.append((k, heading, texts("p"), texts("li"), facts, list(dict.fromkeys(page.links)), list(dict.fromkeys(page.images))))
            yield pd.DataFrame(out, columns=[key, "title", "paragraphs", "bullets", "facts", "links", "images"])

    kind = dict(pages.dtypes)[key]
    schema = f"{key} {kind}, title string, paragraphs array<string>, bullets array<string>, facts array<struct<term:string,text:string>>, links array<string>, images array<string>"
    return pages.select(key, html).mapInPandas(run, schema)


def extract_tables(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """A row per table row, its cells in the order of the headers, spans filled in."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, source in zip(frame[key], frame[html], strict=True):
                for t, rows in enumerate(read_page(source).tables):
                    headers, body = table_grid(rows)
                    out += [(k, t, r, headers, line) for r, line in enumerate(body)]
            yield pd.DataFrame(out, columns=[key, "table_no", "row_no", "headers", "cells"])

    kind = dict(pages.dtypes)[key]
    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, table_no int, row_no int, headers array<string>, cells array<string>")


def render_tables(rows: DataFrame, key: str, headers: list[str], order: str) -> DataFrame:
    """An HTML table per key from rows of cells in the columns ``headers``, escaped."""
    cell = lambda tag, c: F.concat(F.lit(f"<{tag}>"), escape_html(squash(c)), F.lit(f"</{tag}>"))
    head = F.concat(F.lit("<thead><tr>"), *[cell("th", F.lit(h)) for h in headers], F.lit("</tr></thead>"))
    line = F.concat(F.lit("<tr>"), *[cell("td", F.coalesce(F.col(h).cast("string"), F.lit(""))) for h in headers], F.lit("</tr>"))
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
    body = F.array_join(F.transform(lines, lambda x: x["line"]), "")
    return rows.groupBy(key).agg(F.concat(F.lit("<table>"), head, F.lit("<tbody>"), body, F.lit("</tbody></table>")).alias("html"))
