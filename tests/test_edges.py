"""Edge cases of single operators, and the shape of plans."""

import json

import pytest
from pyspark.sql import functions as F

from noticeloom.functions import text as tx
from noticeloom.functions import values as vl
from noticeloom.operators import aggregates as ag
from noticeloom.operators import filters as fl
from noticeloom.operators import joins as jn
from noticeloom.operators import metadata as md
from noticeloom.operators import notices as nt
from noticeloom.operators import ordering as od
from noticeloom.plans import catalog
from noticeloom.plans import lists as ls
from noticeloom.sources import records as rc
from noticeloom.views import view

SF = "/root/testdata/sf0.001"


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("value", "want"),
    [("20240305", "2024-03-05"), ("x", None), ("2024-03-14T00:00:00Z", "2024-03-14"), (" March 14, 2024", "2024-03-14"), ("2024-13-40", None), ("", None), (None, None)],
)
def test_dates(spark, value, want):
    assert one(spark, value, lambda c: vl.to_date(c).cast("string")) == want


@pytest.mark.parametrize(
    ("make", "value", "want"),
    [
        (vl.notice_url, "https://a.gov/x/?q=1#f", "https://a.gov/x?q=1"),
        (vl.record_url, "https://a.gov/x/?q=1#f", "https://a.gov/x"),
        (vl.link_url, "mailto:a@b.c", ""),
        (vl.link_url, "//a.org/x).", "https://a.org/x"),
        (vl.link_url, "/x", "https://www.fda.gov/x"),
        (vl.link_url, "a.org/x#y", "https://a.org/x"),
        (tx.squash, " a  b﻿\n", "a b"),
        (tx.strip_html, "<script>1</script><p>a&nbsp;b &amp; c</p>", "a b & c"),
        (tx.clean_fragment, " ```x\ny``` <style>p</style><b>t</b> ", "<b>t</b>"),
        (lambda c: tx.cut_hard(c, 5), "abcd efg", "abcd…"),
        (lambda c: tx.cut_sentence(c, F.lit("All is well")), "Please contact", "All is well."),
        (vl.record_slug, "Acme Recalled Chairs & Tables!", "acme-recall-chairs-and-tables-recall"),
        (lambda c: vl.notice_slug(c, F.lit(None).cast("string"), F.lit("2024")), "A® b/c", "a-b-c-recall-2024"),
        (vl.url_encoded, "a b/ü~(1)", "a%20b%2F%C3%BC~(1)"),
    ],
)
def test_values(spark, make, value, want):
    assert one(spark, value, make) == want


def test_unique_slugs(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a-2"), (4, "a"), (5, "b"), (6, "b"), (7, "c-2"), (8, "d")], "i int, base string")
    got = {r.row_id: r.slug for r in od.unique_slugs(rows, "base", "i", "i").collect()}
    assert got == {1: "a", 2: "a-2", 3: "a-2-2", 4: "a-3", 5: "b", 6: "b-2", 7: "c-2", 8: "d"}
    held = spark.createDataFrame([("b-2",), ("d",)], "slug string")
    got = {r.row_id: r.slug for r in od.unique_slugs(rows, "base", "i", "i", held).collect()}
    assert (got[5], got[6], got[8]) == ("b", "b-3", "d-2")


def test_page_header(spark):
    header = lambda df, *a: tuple(ag.page_header(df, *a).first())
    assert header(spark.range(0), -3, 0) == (0, 1, 8, 1)
    assert header(spark.range(101), 2, 500) == (101, 2, 100, 2)


def test_sort_orders(spark):
    c = spark.createDataFrame([(i, k) for k in ("fresh", "newer", "backfill") for i in range(3)], "pos int, candidate_class string")
    bounds = spark.createDataFrame([(10, 20)], "min_order int, max_order int")
    got = {(r.candidate_class, r.pos): r.sortOrder for r in od.assign_orders(c, bounds, "pos", 300).collect()}
    assert [got["fresh", i] for i in range(3)] == [300, 299, 298]
    assert [got["newer", i] for i in range(3)] == [23, 22, 21] and [got["backfill", i] for i in range(3)] == [9, 8, 7]


def test_paragraphs_and_components(spark):
    df = spark.createDataFrame([("ok\nwithin seconds\n\n x ",)], "t string")
    row = fl.split_paragraphs(df, "t").first()
    assert (row.kept, row.rejected) == (["ok", "x"], ["within seconds"])
    got = fl.explode_components(spark.createDataFrame([("A:B:C",), ("A:",)], "component string")).collect()
    assert sorted((r.component, r.level, r.clause) for r in got) == [("A:", 1, "A"), ("A:B:C", 1, "A"), ("A:B:C", 2, "B"), ("A:B:C", 3, "C")]


def test_vehicle_numbers(spark):
    df = spark.createDataFrame([(" 1hg cm82633a004352",), ("1HGCM82633A00435O",), ("brakes",)], "query string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    assert {r.kind: r.n for r in fl.triage_searches(df).collect()} == {"vin": 1, "text": 2}


def test_backfill(spark):
    df = spark.createDataFrame([("21V137000", "Own", None), (" ", None, None)], "campaignNumber string, seoTitle string, hreflangUrls map<string,string>")
    a, b = md.backfill_vehicle_seo(df, "https://x.org").collect()
    assert (a.seoTitle, a.canonicalPath, a.canonicalUrl) == ("Own", "/recalls/vehicle/21V137000", "https://x.org/recalls/vehicle/21V137000")
    assert len(a.hreflangUrls) == 12 and a.hreflangUrls["x-default"] == a.hreflangUrls["en"] and b.canonicalPath is None is b.hreflangUrls


def test_new_records_plan_and_blanks(spark):
    rows = spark.createDataFrame([("1", "u1", ""), ("2", "u9", " "), ("3", "u3", None)], "id string, url string, number string")
    stored = spark.createDataFrame([("9", "u9", ""), ("3", "x", " ")], "id string, url string, number string")
    new = jn.new_records(rows, stored, [(k, k) for k in ("url", "id", "number")])
    assert [r.id for r in new.collect()] == ["1"]
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_plans(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan(catalog.QUERIES["Q1_fda_list"](spark, SF))
    repair = catalog.QUERIES["W5_order_repair"](spark, SF)
    assert "r_part" in plan(repair)
    pushed = plan(fl.filter_brand(view(spark, SF, "v_products"), "Brand#13").select("p_partkey"))
    assert "EqualTo(p_brand,Brand#13)" in pushed and "p_type" not in pushed.split("ReadSchema")[1]


def test_order_of_input_does_not_matter(spark):
    rows = view(spark, SF, "v_category_rows")
    of = lambda df: sorted(map(tuple, od.winners(df, od.identity_key(have=df.columns), "last_modified", "n_langs", ["slug", "pos"]).collect()), key=str)
    assert of(rows) == of(rows.orderBy(F.rand(3)).repartition(5))


def test_links_and_contacts(spark):
    links = ["https://x.org/a", "https://www.fda.gov/medwatch/1", "https://y.org/recall-info", "https://z.org/support", "https://w.org/"]
    row = nt.route_links(spark.createDataFrame([(links, ["https://p.org"])], "l array<string>, t array<string>"), "l", "t").first()
    assert (row.reportingUrls, row.consumerWebsite, row.lotCheckUrl, row.companyWebsite) == ([links[1]], links[1], links[2], links[0])
    row = nt.route_links(spark.createDataFrame([([], ["https://www.fda.gov/x", "https://p.org"])], "l array<string>, t array<string>"), "l", "t").first()
    assert row.companyWebsite == "https://p.org"
    facts = [("Consumers:", "call 1-800-555-1234 or a@b.org"), ("Media", "m@b.org")]
    row = nt.contacts_block(spark.createDataFrame([(facts,)], "facts array<struct<term:string,text:string>>")).first().contacts
    assert (row.consumers.email, row.consumers.phone, row.media.email, row.media.phone) == ("a@b.org", "1-800-555-1234", "m@b.org", None)


def test_untidy_page():
    page = nt.read_page('<h1>T<p>one<p>two &amp; <a href="/x">x</a><script>var t="</p>";</script><!-- <p>no --><ul><li>b1<li>b2</ul><dl><dt>K<dd>V</dl><img srcset="s.png 1x, l.png?w=2 2x">')
    assert page.blocks == [("h1", "T"), ("p", "one"), ("p", "two & x"), ("li", "b1"), ("li", "b2"), ("dt", "K"), ("dd", "V")]
    assert (page.links, page.images) == (["/x"], ["l.png"])


def test_table_spans():
    html = '<table><tr><th>a</th><th>b</th><th>c</th></tr><tr><td rowspan="2">1</td><td colspan="2">2</td></tr><tr><td>3</td></tr><tr><td></td></tr></table>'
    headers, rows = nt.table_grid(nt.read_page(html).tables[0])
    assert headers == ["a", "b", "c"] and rows == [["1", "2", "2"], ["1", "3", ""]]
    assert nt.table_grid([]) == ([], [])


def test_csv_of_odd_texts(spark, tmp_path):
    """Texts come back from the CSV as they are: blanks around them, empty ones, nulls, line ends and quotes."""
    texts = ["plain", " a ", "\ta\n", "", None, " ", "\n", "\r\n", "a\r", '"', 'a "b", c\\', '\\"', ",", "null", "\\N", "\ufeffa", "\x00", "\x1f", "\u3000a\x85"]
    rows = [(i, t, "en", s, 0) for i, (t, s) in enumerate([*((t, "web") for t in texts), *(("a", t) for t in texts)])] + [(None, None, None, None, None)]
    for parts in (1, len(rows)):
        d = f"{tmp_path}/{parts}"
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(parts).write.parquet(f"{d}/documents.parquet")
        got = {(r.doc_id, r.text, r.source) for r in catalog.QUERIES["S1_csv_scan"](spark, d).collect()}
        assert got == {(None if i is None else str(i), t, s) for i, t, _, s, _ in rows}


def test_csv(spark, tmp_path):
    head = ",".join(f'"{c}"' for c in rc.CSV_COLUMNS)
    line = ['"1"', '""', '"March 14, 2024"', '""', '"say ""hi""\nthere"', *['"x&nbsp;\u00a0"'] * 17]
    (tmp_path / "air-fryer_2023-12-01_2026-04-01.csv").write_text("﻿" + head + "\n" + ",".join(line) + "\n", encoding="utf-8")
    rows = rc.read_cpsc_csv(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0]["category"] == "air-fryer" and rows[0]["Recall Number"] == "1" and rows[0]["Recall Heading"] == 'say "hi"\nthere'


def test_json(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("slug", T.StringType()), T.StructField("n", T.LongType())])
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text(json.dumps([{"_id": 1, "slug": "s", "n": 2, "more": 3}, {"slug": "t"}]))
    assert [(r.slug, r.n) for r in rc.read_recall_json(spark, str(tmp_path / "a"), schema).collect()] == [("s", 2), ("t", None)]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "toys.json").write_text(json.dumps({"meta": {"slug": "m"}, "recalls": [{"slug": "p"}, {"slug": "q"}]}))
    (tmp_path / "b" / "url-map.json").write_text(json.dumps({"recalls": [{"slug": "no"}]}))
    (tmp_path / "b" / "broken.json").write_text("{")
    got = rc.read_category_docs(spark, str(tmp_path / "b"), schema).collect()
    assert sorted((r.category, r.pos, r.slug) for r in got if r.slug) == [("toys", 0, "p"), ("toys", 1, "q")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, f"k{i}") for i in range(50)], "o int, k string")
    assert tuple(rc.replace_table(df, str(tmp_path / "t"), "k", dry_run=True).first()) == (50, 50, False)
    assert tuple(rc.replace_table(df, str(tmp_path / "t"), "k").first()) == (50, 50, True) and spark.read.parquet(str(tmp_path / "t")).count() == 50
    with pytest.raises(ValueError, match="duplicate"):
        rc.replace_table(df.union(df), str(tmp_path / "t"), "k")
    rc.save_snapshot(df, str(tmp_path / "s"), "o", 4)
    files = sorted((tmp_path / "s").glob("part-*"))
    assert [r.o for f in files for r in spark.read.parquet(str(f)).collect()] == list(range(49, -1, -1))
    entries = ls.sitemap([(df.select("k").withColumn("last_modified", F.lit(None).cast("timestamp")), "k", "/r/", 0.8)], [("", 1.0)], F.lit("2026-01-01").cast("timestamp"), cap=20)
    assert entries.count() == 51 and entries.first().over_cap
    ranked = od.global_rank(entries.withColumn("n", F.monotonically_increasing_id()), ["n"], "position")
    rc.write_sitemap(ranked, str(tmp_path / "m"), 20)
    assert {r.file_no: r["count"] for r in spark.read.json(str(tmp_path / "m")).groupBy("file_no").count().collect()} == {0: 20, 1: 20, 2: 11}


def test_upsert_is_idempotent(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    t = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "k string, n int, s string")
    u = spark.createDataFrame([("b", None, "y"), ("c", 3, None)], "k string, n int, s string")
    once = rc.upsert(t, u, "k", ["n", "s"], now)
    twice = rc.upsert(once.drop("outcome"), u, "k", ["n", "s"], now)
    rows = lambda df: sorted(map(tuple, df.drop("outcome").collect()), key=str)
    assert rows(once) == rows(twice) and {r.k: (r.n, r.s) for r in once.collect()} == {"a": (1, None), "b": (2, "y"), "c": (3, None)}


def test_prune(spark):
    df = spark.createDataFrame([(" ", ["", " x "], (None, []), [("", "")])], "a string, b array<string>, c struct<x:string,y:array<string>>, d array<struct<p:string,q:string>>")
    assert tuple(md.prune_empty(df).first()) == (None, ["x"], None, None)


def test_documents(spark):
    from noticeloom.plans.catalog import _facts

    row = md.assemble_document(md.assemble_brief(_facts(spark, SF), F.lit("2024"))).where("p_partkey = 2").first()
    assert [s.subtitle for s in row.content] == ["Quick Answer", "What Was Recalled", "What Consumers Should Do", "Frequently Asked Questions", "Source and Verification"]
    assert json.loads(row.content[1].facts).keys() == {"productDescription", "brandName", "productType"} and len(row.content[-1].authorityLinks) == 1


def test_busy_values_do_not_fill_a_range(spark):
    """One day holds all rows but two, and one row is there 300 times: ranks are right, and ranges stay even."""
    rows = [(1, 0)] + [(5, i % 700) for i in range(1400)] + [(5, 9999)] * 300 + [(9, 1)]
    df = spark.createDataFrame(rows, "day int, id int").repartition(7)
    got = od.global_rank(df, ["day", "id"], "n", parts=8).collect()
    assert sorted((r.n, r.day, r.id) for r in got) == [(i + 1, *r) for i, r in enumerate(sorted(rows))]
    ranged = df.withColumn("turn", F.monotonically_increasing_id()).repartitionByRange(8, "day", "id", "turn")
    assert max(r["count"] for r in ranged.groupBy(F.spark_partition_id()).count().collect()) < 500
    each = od.global_rank(df, ["id"], "n", within=["day"], parts=8).collect()
    own = {}
    for d, i in sorted(rows):
        own.setdefault(d, []).append(i)
    assert sorted((r.day, r.n, r.id) for r in each) == sorted((d, n + 1, i) for d, ids in own.items() for n, i in enumerate(ids))
    total = od.running_total(df, ["day", "id"], "n", F.col("id"), parts=4).agg(F.max("n")).first()[0]
    assert total == sum(i for _, i in rows)


def test_gaps(spark):
    far = 3_000_000
    df = spark.createDataFrame([(x,) for x in (7, 3, 3, 4, 12, far, None)], "n long")
    got = od.order_gaps(df, "n", parts=3)
    assert got.where("missing < 12").orderBy("missing").collect() == [(x,) for x in (5, 6, 8, 9, 10, 11)]
    assert got.count() == 6 + far - 13 and got.agg(F.min("missing"), F.max("missing"), F.count_distinct("missing")).first() == (5, far - 1, 6 + far - 13)
    assert od.order_gaps(df.limit(0), "n").count() == 0


def test_one_base_for_all(spark):
    df = spark.createDataFrame([(i, "same") for i in range(500)], "id int, base string").repartition(5)
    got = {r.row_id: r.slug for r in od.unique_slugs(df, "base", "id", "id").collect()}
    assert got == {i: "same" if i == 0 else f"same-{i + 1}" for i in range(500)}
