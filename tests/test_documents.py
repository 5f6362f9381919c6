"""Documents of notices (P26, P27): what is missing is left out, what is there is escaped."""

from pyspark.sql import functions as F

from noticeloom.operators import documents as dc


def test_bare_notice(spark):
    row = dc.document_sections(spark.createDataFrame([(1,)], "id int"), F.lit("2024")).first()
    found = {s.subtitle: s for s in row.content}
    assert list(found) == [t for t in dc.SUBTITLES if t not in ("What Was Recalled", "Company Contact Information", "About the Company")]
    assert found["Quick Answer"].text == "<p>The company recalled the affected product because the recall issue described in the FDA notice. The FDA notice was published on 2024.</p>"
    assert row.authorityLinks == [] and row.contactText == "" and found["Source and Verification"].authorityLinks is None
    assert [x.answer for x in found["Frequently Asked Questions"].faq][:2] == ["the affected product is listed in the FDA notice.", "the recall issue described in the FDA notice"]


def test_links(spark):
    schema = "detailUrl string, lotCheckUrl string, reportingUrls array<string>, consumerWebsite string, companyWebsite string"
    rows = [
        ("n", "l", ["https://x/MedWatch", "https://x/other", "https://x/MedWatch", " "], "https://x/other", "l"),
        (None, None, None, "https://safetyreporting.hhs.gov", "https://fda.gov/medwatch/1"),
        ("", "", [], None, None),
    ]
    got = [[x.split(" <a")[0] + " " + x.split("'")[1] for x in r.authorityLinks] for r in dc.authority_links(spark.createDataFrame(rows, schema)).collect()]
    assert got[0] == [f"Read the official FDA recall notice n", "Check lot or replacement information l", f"{dc.MEDWATCH} https://x/MedWatch", f"{dc.ADVERSE} https://x/other"]
    assert got[1] == [f"{dc.PORTAL} https://safetyreporting.hhs.gov", f"{dc.MEDWATCH} https://fda.gov/medwatch/1"] and got[2] == []


def test_tables(spark):
    kind = "t array<struct<headers:array<string>,rows:array<array<string>>>>"
    rows = [([(["a", " ", "b&"], [["1"], ["", None], [None, "<2>", "3"]]), ([], [["x"]]), (["h"], [[" "]])],), ([],), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, kind).select(dc.tables_html(F.col("t"))).collect()]
    assert got == ["<table><thead><tr><th>a</th><th>b&amp;</th></tr></thead><tbody><tr><td>1</td><td></td></tr><tr><td></td><td>&lt;2&gt;</td></tr></tbody></table>", "", None]
