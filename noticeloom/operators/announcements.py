"""Announcements, their contacts and listings, from landed pages.

A page becomes a flat sequence of typed blocks in one pass; what belongs where is decided on that sequence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.functions.text import squash
from noticeloom.functions.values import link_url
from noticeloom.operators.filters import BOILERPLATE
from noticeloom.operators.notices import EMAIL, LINK, PHONE, route_links

#: Marks of a notice page that bound or name its parts; fixed values.
ANNOUNCEMENT, PHOTOS, CONTACTS = "recall-announcement", "recall-photos", "company contact information"
BUTTONS = r"(?i)\b(External Link Disclaimer|Read Announcement|View Product Photos)\b"
CELL = re.compile(r"\bcell-2_[1-7]\b")
NAMED = {"content-type-label": "label", "node-current-date": "current", "lcds-description-list__item-heading": "heading"}
LISTING = "datatable"
LISTING_FIELDS = ("date_text", "date_time", "brand", "product", "type", "reason", "company", "terminated", "url")

_BLOCK = pa.struct([("kind", pa.string()), ("name", pa.string()), ("depth", pa.int32()), ("text", pa.string()), ("time", pa.string()), ("links", pa.list_(pa.string()))])
_ROW = pa.struct([(f, pa.string()) for f in LISTING_FIELDS])
_DDL = "blocks array<struct<kind:string,name:string,depth:int,text:string,time:string,links:array<string>>>, listing array<struct<" + ",".join(f"{f}:string" for f in LISTING_FIELDS) + ">>, images array<string>"


class _Blocks(HTMLParser):
    """The typed blocks of a page, its listing rows and pictures, in order and in one pass.

    A block is a heading, paragraph, list item, term, description, or an element with a class that names it;
    ``depth`` is how many elements hold it. Paragraphs in list items, descriptions and cells are part of these. ``mark`` is
    the announcement's heading, ``photos`` where photos begin, ``end`` where an element ends that a heading stands in.
    """

    SKIP = frozenset({"script", "style", "noscript", "template"})
    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
    TEXT = frozenset("title h1 h2 h3 h4 h5 h6 p li dt dd td th".split())
    HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
    WITHIN = frozenset({"li", "dd", "td", "th", "cell", "item"})

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[dict] = []
        self.rows: list[list[dict]] = []
        self.images: list[str] = []
        self.stack: list[list] = []  # tag, name of the cell or list it opens, whether a heading stands in it
        self.skipped: list[str] = []
        self.block: dict | None = None
        self.until = 0
        self.picture: list[tuple[str, str]] | None = None
        self.tables = self.listing = 0

    def close_block(self) -> None:
        block, self.block = self.block, None
        if not block:
            return
        block["text"] = "".join(block["text"])
        if block["kind"] in ("td", "th"):
            if self.listing and self.rows and block["kind"] == "td":
                self.rows[-1].append(block)
        elif block["text"].strip():
            self.blocks.append(block)

    def put(self, kind: str, name: str = "", depth: int | None = None) -> None:
        self.close_block()
        self.blocks.append({"kind": kind, "name": name, "depth": len(self.stack) if depth is None else depth, "text": "", "time": "", "links": []})

    def begin(self, kind: str, name: str, until: int) -> None:
        self.close_block()
        self.block, self.until = {"kind": kind, "name": name, "depth": len(self.stack), "text": [], "time": "", "links": []}, until

    def named(self, what: str) -> str:
        return next((s[1] for s in reversed(self.stack) if s[1].startswith(what)), "")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in self.SKIP:
            self.skipped.append(tag)
        if self.skipped:
            return
        got = {k: v or "" for k, v in attrs}
        classes = got.get("class", "")
        if got.get("id") == PHOTOS:
            self.put("photos")
        if tag in self.VOID:
            self.void(tag, got)
            return
        if tag == "a" and got.get("href") and self.block:
            self.block["links"].append(got["href"])
        if tag == "time" and self.block:
            self.block["time"] = self.block["time"] or got.get("datetime", "")
        if tag == "picture":
            self.picture = []
        if tag == "table":
            self.listing += got.get("id") == LISTING or self.listing > 0
            self.put("table", str(self.tables))
            self.tables += 1
        elif tag == "tr":
            self.close_block()
            if self.listing:
                self.rows.append([])
        cell = CELL.search(classes)
        at = len(self.stack)
        kind = next((k for c, k in NAMED.items() if c in classes.split()), "")
        if cell:
            self.begin("cell", cell[0], at)
        elif "field--item" in classes.split() and self.named("cell-"):
            self.begin("item", self.named("cell-"), at)
        elif kind:
            self.begin(kind, "", at)
        elif tag in self.TEXT and not (tag == "p" and self.block and self.block["kind"] in self.WITHIN):
            if got.get("id") == ANNOUNCEMENT:
                self.put("mark")
            name = "content" if "content-title" in classes.split() else self.named("list-") if tag == "li" else "disclaimer" if self.named("disclaimer") else ""
            self.begin(tag, name, at)
        elif got.get("id") == ANNOUNCEMENT:
            self.put("mark")
        elif self.block:
            self.block["text"].append(" " if tag in ("p", "div", "ul", "ol") else "")
        elif tag == "div":
            self.begin("text", "", at)
        if (tag in self.HEADS or got.get("id") == ANNOUNCEMENT) and self.stack:
            self.stack[-1][2] = True
        own = cell[0] if cell else "list-regulated" if "lcds-metadata-list" in classes.split() else f"list-{tag}" if tag in ("ul", "ol") else "disclaimer" if got.get("id") == "disclaimer" else ""
        if tag not in self.TEXT or cell:
            self.stack.append([tag, own, False])

    def void(self, tag: str, got: dict[str, str]) -> None:
        if tag == "hr":
            self.put("hr")
        elif tag == "br" and self.block:
            self.block["text"].append(" ")
        elif tag in ("img", "source"):
            first = got.get("srcset", "").split()[:1] if tag == "source" else [got.get("src", "")]
            if first and first[0]:
                if self.picture is not None:
                    self.picture.append((tag, first[0].rstrip(",")))

    def handle_endtag(self, tag: str) -> None:
        if self.skipped:
            if tag in self.skipped:
                del self.skipped[self.skipped.index(tag) :]
            return
        if tag == "picture" and self.picture is not None:
            sources = [s for t, s in self.picture if t == "source"]
            best = [s for s in sources if "recall_image_large" in s] or [s for s in sources if "large" in s] or sources or [s for _, s in self.picture]
            self.images += best[:1]
            self.picture = None
        if tag in self.TEXT and self.block and self.block["kind"] == tag:
            self.close_block()
        at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag), None)
        if at is None or (tag in self.TEXT and not self.stack[at][1]):
            return
        if self.block and self.until >= at:
            self.close_block()
        if tag in ("ul", "ol", "dl", "table"):
            self.close_block()
        while len(self.stack) > at:
            gone = self.stack.pop()
            if gone[2]:
                self.put("end", depth=len(self.stack))
            if gone[0] == "table" and self.listing:
                self.listing -= 1

    def handle_data(self, data: str) -> None:
        if not self.skipped and self.block:
            self.block["text"].append(data)


def read_blocks(html: str | None) -> tuple[list[dict], list[dict], list[str]]:
    """Blocks, listing rows and pictures of a page, however untidy."""
    page = _Blocks()
    page.feed(html or "")
    page.close()
    page.close_block()
    listing = []
    for cells in page.rows:
        texts = [c["text"] for c in cells] + [""] * 7
        first = next((c["links"][0] for c in cells if c["links"]), "")
        if cells:
            listing.append(dict(zip(LISTING_FIELDS, (texts[0], cells[0]["time"], *texts[1:7], first), strict=True)))
    return page.blocks, listing, list(dict.fromkeys(s.split("?")[0] for s in page.images))


def page_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key, blocks, listing, images`` of every page: the only step that runs Python, a page at a time in Arrow batches.

    A null or empty page has none of them; repeated rows are read each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):  # what is made of a page may be larger than the page
                part = batch.slice(at, 200)
                read = list(map(read_blocks, part.column(html).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array([r[0] for r in read], pa.list_(_BLOCK)), pa.array([r[1] for r in read], pa.list_(_ROW)), pa.array([r[2] for r in read], pa.list_(pa.string()))], [key, "blocks", "listing", "images"])

    return pages.select(key, html).mapInArrow(run, f"`{key}` {dict(pages.dtypes)[key]}, {_DDL}")


def _first(blocks: Column, test) -> Column:
    """The place, from 1, of the first block that passes, else 0."""
    return F.array_position(F.transform(blocks, test), True)


def _after(blocks: Column, place: Column) -> Column:
    return F.slice(blocks, (place + 1).cast("int"), F.size(blocks))


def _upto(blocks: Column, place: Column) -> Column:
    """What stands before a place; everything if that is 0."""
    return F.when(place == 0, blocks).otherwise(F.slice(blocks, F.lit(1), F.greatest(place - 1, F.lit(0)).cast("int")))


def _let(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _bounded(blocks: Column) -> Column:
    """The blocks of the announcement: from its heading to the photos, the contacts, or the end of the element that holds it."""

    def stops(depth: Column):
        inside = lambda b: F.lower(b["text"]).contains(CONTACTS) & ((b["depth"] > depth) | b["kind"].rlike("^(h[1-6]|text)$"))
        return lambda b: (b["kind"] == "photos") | ((b["kind"] == "end") & (b["depth"] < depth)) | inside(b)

    def region(start: Column) -> Column:
        depth = F.get(blocks, (start - 1).cast("int"))["depth"]
        own = F.get(blocks, start.cast("int"))["kind"].rlike("^h[1-6]$")  # the heading itself
        return _let(_after(blocks, start + F.when(own, 1).otherwise(0)), lambda rest: _upto(rest, _first(rest, stops(depth))))

    return _let(_first(blocks, lambda b: b["kind"] == "mark"), lambda start: F.when(start > 0, region(start)).otherwise(F.slice(blocks, 1, 0)))


def _texts(blocks: Column, test) -> Column:
    return F.filter(F.transform(F.filter(blocks, test), lambda b: squash(F.regexp_replace(b["text"], BUTTONS, " "))), lambda t: t != "")


def _boilerplate(text: Column) -> Column:
    low, out = F.lower(text), F.lit(False)
    for phrase in BOILERPLATE:
        out = out | low.contains(phrase)
    return out


def announcements(blocks: DataFrame) -> DataFrame:
    """C11: the bounded announcement of each page of ``page_blocks``, with the page's facts.

    Paragraphs and bullets (of plain lists) stand between the announcement's heading and the photos, the company's
    contacts or the end of the part that holds the heading; boilerplate goes to ``rejected``. ``links`` are those of kept and rejected
    paragraphs and bullets, ``text_links`` the addresses in the kept texts, ``tables`` the numbers of tables on the page (as in
    C12). ``about`` is the paragraph on the company. Facts come from the page's cells, else from its terms. A page
    without such a heading has empty lists.
    """
    rows = blocks.withColumn("region", _bounded(F.col("blocks")))
    paragraph, bullet = lambda b: b["kind"] == "p", lambda b: (b["kind"] == "li") & (b["name"] == "list-ul")
    clean = lambda texts: F.filter(texts, lambda t: ~_boilerplate(t))
    links = F.flatten(F.transform(F.filter("region", lambda b: paragraph(b) | bullet(b)), lambda b: F.transform(b["links"], link_url)))
    rows = rows.withColumns(
        {
            "p_all": _texts(F.col("region"), paragraph),
            "bullets": clean(_texts(F.col("region"), bullet)),
            "links": F.array_distinct(F.filter(links, lambda u: u != "")),
            "tables": F.transform(F.filter("region", lambda b: b["kind"] == "table"), lambda b: b["name"].cast("int")),
        }
    )
    rows = rows.withColumns({"paragraphs": clean(F.col("p_all")), "rejected": F.filter("p_all", _boilerplate)})
    both = F.concat("paragraphs", "bullets")
    found = F.flatten(F.transform(both, lambda t: F.regexp_extract_all(t, F.lit(LINK), F.lit(0))))
    about = F.get(F.filter("paragraphs", lambda t: t.rlike(r"(?i)^about\b|headquartered")), F.lit(0))
    whole = F.concat(F.transform("bullets", lambda t: F.concat(F.lit("• "), t)), F.col("paragraphs"))

    kept = lambda test: _texts(F.col("blocks"), test)
    cell = lambda n: F.array_join(kept(lambda b: (b["name"] == f"cell-2_{n}") & b["kind"].isin("cell", "item")), " ")
    items = lambda n: kept(lambda b: (b["name"] == f"cell-2_{n}") & (b["kind"] == "item"))
    when = lambda n: F.get(F.filter("blocks", lambda b: (b["name"] == f"cell-2_{n}") & (b["time"] != "")), F.lit(0))["time"]
    one = lambda kind, name=None: F.get(kept(lambda b: (b["kind"] == kind) & (F.lit(True) if name is None else b["name"] == name)), F.lit(0))

    def term(label: str) -> Column:
        """What follows the first term with these words."""
        place = _first(F.col("blocks"), lambda b: (b["kind"] == "dt") & F.lower(b["text"]).contains(label))
        follows = _let(place, lambda i: F.when(i > 0, F.get("blocks", i.cast("int"))))
        return F.when(follows["kind"] == "dd", squash(follows["text"]))

    filled = lambda *options: F.coalesce(*[F.nullif(o, F.lit("")) for o in options])
    regulated = _let(_first(F.col("blocks"), lambda b: (b["kind"] == "heading") & F.lower(b["text"]).contains("regulated product")), lambda i: F.when(i > 0, _let(_after(F.col("blocks"), i), lambda rest: _texts(_upto(rest, _first(rest, lambda b: b["kind"] == "heading")), lambda b: b["name"] == "list-regulated"))))
    keep = [c for c in blocks.columns if c not in ("blocks", "listing", "images")]
    return rows.select(
        *keep,
        filled(one("h1", "content"), one("h1")).alias("title"),
        one("label").alias("page_type"),
        one("p", "disclaimer").alias("disclaimer"),
        filled(cell(1)).alias("company_date"),
        when(1).alias("company_time"),
        filled(cell(2)).alias("publish_date"),
        when(2).alias("publish_time"),
        filled(cell(3), term("product type")).alias("product_type"),
        filled(F.array_join(items(4), " "), term("reason for announcement")).alias("reason"),
        filled(cell(5), term("company name")).alias("company"),
        items(6).alias("brands"),
        filled(F.array_join(items(7), " | ")).alias("product"),
        "paragraphs",
        "bullets",
        "rejected",
        "tables",
        F.array_join(whole, " ").alias("announcement"),
        F.substring(about, 1, 240).alias("about"),
        F.coalesce(regulated, F.array().cast("array<string>")).alias("regulated_products"),
        F.get(F.filter("blocks", lambda b: b["kind"] == "current"), F.lit(0))["time"].alias("current_as_of"),
        F.array_distinct(F.filter(F.transform("images", link_url), lambda u: u != "")).alias("images"),
        "links",
        F.array_distinct(F.filter(F.transform(found, link_url), lambda u: u != "")).alias("text_links"),
    )


def routed_links(announced: DataFrame) -> DataFrame:
    """C7 for announcements: their links, then the addresses in their texts; without a company link the first plain one of these."""
    every = announced.withColumn("all_links", F.array_distinct(F.concat("links", "text_links")))
    return route_links(every, "all_links", "text_links").drop("all_links")


def listing_rows(blocks: DataFrame, key: str = "page_id") -> DataFrame:
    """C11: the rows of listings on the pages, in order; addresses absolute."""
    rows = blocks.select(key, F.posexplode("listing").alias("row_no", "r"))
    text = [squash(F.col(f"r.{f}")).alias(f) for f in LISTING_FIELDS[:-1]]
    return rows.select(key, "row_no", *text, link_url(F.col("r.url")).alias("url"))


def contact_records(blocks: DataFrame) -> DataFrame:
    """``consumers`` and ``media`` of each page's company contacts.

    Below the heading each term begins a group, which its descriptions continue up to the next other block. Of the groups whose
    term has the word, the last counts. E-mail and phone are the first in the group; the organisation is its first line that is neither,
    the website its first address; of media, what is left before the first comma is the name and behind it the role.
    """
    heading = lambda b: b["kind"].rlike("^h[1-6]$") & (F.lower(squash(b["text"])) == CONTACTS)

    def section(start: Column) -> Column:
        depth = F.get("blocks", (start - 1).cast("int"))["depth"]
        return _let(_after(F.col("blocks"), start), lambda rest: _upto(rest, _first(rest, lambda b: (b["kind"] == "end") & (b["depth"] < depth))))

    rows = blocks.withColumn("section", _let(_first(F.col("blocks"), heading), lambda i: F.when(i > 0, section(i))))
    nothing = F.array().cast("array<string>")
    first = lambda found: F.nullif(F.get(found, F.lit(0)), F.lit(""))
    all_of = lambda text, pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def group(word: str) -> Column:
        term = F.transform("section", lambda b: (b["kind"] == "dt") & F.lower(b["text"]).contains(word))
        last = _let(term, lambda t: F.size(t) + 1 - F.array_position(F.reverse(t), True))
        found = F.exists("section", lambda b: (b["kind"] == "dt") & F.lower(b["text"]).contains(word))
        lines = lambda i: _let(_after(F.col("section"), i), lambda rest: F.transform(_upto(rest, _first(rest, lambda b: b["kind"] != "dd")), lambda b: squash(b["text"])))
        return F.when(found, _let(last, lambda i: F.struct(F.concat(F.regexp_replace(squash(F.get("section", (i - 1).cast("int"))["text"]), ":$", ""), F.lit(":")).alias("label"), F.filter(lines(i), lambda t: t != "").alias("lines"))))

    rows = rows.withColumns({"c": group("consumer"), "m": group("media")})
    parts = {}
    for side in ("c", "m"):
        parts |= {f"{side}_text": F.array_join(F.coalesce(F.col(f"{side}.lines"), nothing), " | ")}
    rows = rows.withColumns(parts)
    rows = rows.withColumns({f"{side}_{n}": all_of(F.col(f"{side}_text"), p) for side in ("c", "m") for n, p in (("emails", EMAIL), ("phones", PHONE))})
    site = lambda lines: F.get(F.filter(F.transform(F.filter(F.flatten(F.transform(lines, lambda t: all_of(F.regexp_replace(t, EMAIL, " "), LINK))), lambda u: ~u.contains("@")), link_url), lambda u: u != ""), F.lit(0))
    own = F.filter("c.lines", lambda t: ~F.array_contains("c_emails", t) & ~F.array_contains("c_phones", t))
    consumers = F.struct(F.col("c.label").alias("label"), first(own).alias("organization"), first(F.col("c_phones")).alias("phone"), first(F.col("c_emails")).alias("email"), site(F.col("c.lines")).alias("website"))
    # the first e-mail and the first phone go, and lines that are empty then
    rows = rows.withColumns({"m_email": first(F.col("m_emails")), "m_phone": first(F.col("m_phones"))})
    rows = rows.withColumn("m_left", F.expr("CASE WHEN m_email IS NULL THEN m_text ELSE concat(substr(m_text, 1, instr(m_text, m_email) - 1), substr(m_text, instr(m_text, m_email) + char_length(m_email))) END"))
    rows = rows.withColumn("m_left", F.expr("CASE WHEN m_phone IS NULL OR instr(m_left, m_phone) = 0 THEN m_left ELSE concat(substr(m_left, 1, instr(m_left, m_phone) - 1), substr(m_left, instr(m_left, m_phone) + char_length(m_phone))) END"))
    lines = F.filter(F.transform(F.split("m_left", r"\|"), squash), lambda t: t != "")
    said = F.filter(F.transform(F.split(F.array_join(lines, " | "), ","), squash), lambda t: t != "")
    media = F.struct(F.col("m.label").alias("label"), F.get(said, F.lit(0)).alias("name"), F.nullif(F.array_join(F.slice(said, 2, F.greatest(F.size(said), F.lit(1))), ", "), F.lit("")).alias("role"), F.col("m_email").alias("email"), F.col("m_phone").alias("phone"))
    keep = [c for c in blocks.columns if c not in ("blocks", "listing", "images")]
    return rows.select(*keep, F.when(F.col("c").isNotNull(), consumers).alias("consumers"), F.when(F.col("m").isNotNull(), media).alias("media"))
