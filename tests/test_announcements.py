"""Notice pages: bounds of announcements, facts, listings and contacts."""

import pytest

from noticeloom.operators import announcements as an

PAGE = """<!DOCTYPE html><title>t</title><script>var x = "<h2 id='recall-announcement'>";</script>
<main id="main-content"><span class="content-type-label">Company Announcement</span><h1 class="content-title">Acme Recalls&nbsp;Tea</h1>
<div id="disclaimer"><p>When a company announces</p></div>
<dl><dt>Company Announcement Date:</dt><dd class="cell-2_1"><time datetime="2024-03-01T05:00:00Z">March 01, 2024</time></dd>
<dt>Publish Date:</dt><dd class="cell-2_2"><time datetime="2024-03-02T05:00:00Z">March 02, 2024</time></dd>
<dt>Product Type:</dt><dd>Food &amp; Beverages</dd><dt>Reason for Announcement:</dt><dd class="cell-2_4"><div class="field--label">Reason</div><div class="field--item">Salmonella</div></dd>
<dt>Company Name:</dt><dd class="cell-2_5">Acme LLC</dd><dt>Brand Name:</dt><dd class="cell-2_6"><div class="field--item">Leaf</div><div class="field--item">Bud</div></dd>
<dt>Product:</dt><dd class="cell-2_7"><div class="field--item">Green tea</div><div class="field--item">Black tea</div></dd></dl>
<p>before</p>
<div><p>outside</p><h2 id="recall-announcement">Company Announcement</h2>
<p>Acme of Ohio recalls tea. Read Announcement <a href="/safety/x#a">more</a>
<p>About Acme, headquartered in Ohio. See acme.com/tea or write.
<p>These are forward-looking statements <a href="https://acme.com/investors">x</a></p>
<ul><li>Lot <b>12</b><li><p>Lot 13</p></ul><ol><li>step</li></ol>
<table><tr><th>UPC<tr><td>1</table>
<div><p>MedWatch: <a href="https://www.fda.gov/medwatch/report.htm">report</a></p><ul><li>nested <a href="https://acme.com/support">s</a></li></ul></div>
<div id="recall-photos"><p>photo</p><picture><source srcset="/a_small.jpg 1x"><source srcset="/a_large.jpg?x=1 1x"><img src="/a.jpg"></picture></div><p>after</p></div>
<p>far after</p><div class="node-current-date">Current as of: <time datetime="2024-03-05T10:00:00Z">03/05/2024</time></div>
<li class="x"><h3 class="lcds-description-list__item-heading">Regulated Product(s)</h3><ul class="lcds-metadata-list"><li>Food</li><li>Tea</li></ul></li>
<div><h2>Company Contact Information</h2><dl><dt>Consumers:</dt><dd>Acme LLC</dd><dd><a href="tel:1">1-800-555-0100</a></dd><dd>help@acme.com</dd><dd>www.acme.com/help</dd>
<dt>Media:</dt><dd>Jo Doe, Press Officer, Ohio</dd><dd>(555) 010-0199</dd><dd>jo@acme.com</dd></dl></div><dl><dt>Consumer</dt><dd>elsewhere</dd></dl></main>"""

LIST = """<table id="datatable"><thead><tr><th>Date</th></tr></thead><tbody><tr><td><time datetime="2024-01-02">01/02/2024</time></td><td><a href="/safety/a">Leaf</a></td><td>Tea</td><td>Food</td><td>Lead</td><td>Acme</td><td>Terminated</td></tr>
<tr><td>01/01/2024<td><a href="https://x.org/b">B</a></table><table><tr><td>other</td></tr></table>"""


@pytest.fixture(scope="module")
def blocks(spark):
    return an.page_blocks(spark.createDataFrame([(1, PAGE), (2, LIST), (3, None), (4, ""), (5, "<h2 id='recall-announcement'>x</h2><p>a</p><div><div>Company contact information</div><p>b</p></div>")], "page_id long, html string")).cache()


def test_announcement(blocks):
    row = an.announcements(blocks).where("page_id = 1").first()
    assert row.paragraphs == ["Acme of Ohio recalls tea. more", "About Acme, headquartered in Ohio. See acme.com/tea or write.", "MedWatch: report"]
    assert row.bullets == ["Lot 12", "Lot 13", "nested s"] and row.rejected == ["These are forward-looking statements x"] and row.tables == [0]
    assert row.about == row.paragraphs[1] and row.announcement.startswith("• Lot 12 • Lot 13")
    assert row.links == ["https://www.fda.gov/safety/x", "https://acme.com/investors", "https://www.fda.gov/medwatch/report.htm", "https://acme.com/support"]
    assert row.text_links == ["https://acme.com/tea"] and row.images == ["https://www.fda.gov/a_large.jpg"]
    assert (row.title, row.page_type, row.disclaimer) == ("Acme Recalls Tea", "Company Announcement", "When a company announces")
    assert (row.company_date, row.company_time, row.publish_date, row.publish_time) == ("March 01, 2024", "2024-03-01T05:00:00Z", "March 02, 2024", "2024-03-02T05:00:00Z")
    assert (row.product_type, row.reason, row.company, row.brands, row["product"]) == ("Food & Beverages", "Salmonella", "Acme LLC", ["Leaf", "Bud"], "Green tea | Black tea")
    assert (row.regulated_products, row.current_as_of) == (["Food", "Tea"], "2024-03-05T10:00:00Z")


def test_links_of_announcement(blocks):
    row = an.routed_links(an.announcements(blocks)).where("page_id = 1").first()
    assert (row.reportingUrls, row.consumerWebsite, row.companyWebsite) == (["https://www.fda.gov/medwatch/report.htm"], "https://www.fda.gov/medwatch/report.htm", "https://acme.com/investors")


def test_bounds(blocks):
    rows = {r.page_id: r for r in an.announcements(blocks).collect()}
    assert rows[5].paragraphs == ["a"] and [rows[i].paragraphs for i in (2, 3, 4)] == [[], [], []] and rows[3].title is None


def test_contacts(blocks):
    rows = {r.page_id: r for r in an.contact_records(blocks).collect()}
    assert rows[1].consumers.asDict() == {"label": "Consumers:", "organization": "Acme LLC", "phone": "1-800-555-0100", "email": "help@acme.com", "website": "https://www.acme.com/help"}
    assert rows[1].media.asDict() == {"label": "Media:", "name": "Jo Doe", "role": "Press Officer, Ohio", "email": "jo@acme.com", "phone": "(555) 010-0199"}
    assert all(rows[i].consumers is None and rows[i].media is None for i in (2, 3, 4, 5))


def test_listing(blocks):
    rows = sorted((tuple(r)[1:] for r in an.listing_rows(blocks).collect()))
    assert rows == [
        (0, "01/02/2024", "2024-01-02", "Leaf", "Tea", "Food", "Lead", "Acme", "Terminated", "https://www.fda.gov/safety/a"),
        (1, "01/01/2024", "", "B", "", "", "", "", "", "https://x.org/b"),
    ]


def test_long_and_hostile_pages():
    import time

    began = time.perf_counter()
    for html in ("<div>" * 50_000 + "x", "<p>" * 100_000, "</div>" * 50_000, "<h2 id=recall-announcement>" + "<ul><li>a" * 20_000):
        an.read_blocks(html)
    assert time.perf_counter() - began < 20
