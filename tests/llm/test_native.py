"""Fingerprints, chat formatting, URL filters and mixing against plain Python."""

import hashlib
import re
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from noticeloom.llm import chat
from noticeloom.llm import fingerprints as fp
from noticeloom.llm.chat import CLOSE, OPEN, perspectives
from noticeloom.llm.components import connected_components
from noticeloom.llm.mixing import mix_sources
from noticeloom.llm.urlfilter import filter_urls

TEXTS = ["", "A", "abc", "Straße  Ünï", "strasse\tÜNÏ ", "é", "é", "ﬁne ①", "x" * 5000, "Word " * 999, " ", "ab cd"]


def canon(t):
    t = unicodedata.normalize("NFKC", t)
    return re.sub(r"[\s​﻿]+", " ", unicodedata.normalize("NFKC", t.casefold())).strip(" ")


@pytest.mark.parametrize("bits", [128, 4])
def test_fingerprints(spark, bits):
    rows = [(i * 3 - 5, t) for i, t in enumerate([*TEXTS, None, *TEXTS[::-1]])] + [(None, "no id"), (8, "again"), (8, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS next", "2 AS canon", "3 AS bucket")
    got = fp.fingerprints(docs, bits=bits).collect()
    assert len(got) == len(rows)
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for (i, t), (_, n) in zip(order, [*order[1:], order[0]], strict=True):
        k = len(t) // 4
        e = t[: len(t) - k] + n[:k]
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), float(canon(t) == canon(e)), float(canon(t) == canon(n))))
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got), key=key) == sorted(want, key=key)
    by_id = {r.doc_id: r.fingerprint for r in got}
    ids = {i: canon(t or "") for i, t in rows}
    assert all((by_id[a] == by_id[b]) == (ids[a] == ids[b]) for a in ids for b in ids)


def test_fingerprints_small(spark):
    docs = spark.createDataFrame([(1, "alone it stands")], "doc_id long, text string")
    row = fp.fingerprints(docs).first()
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(b"alone it staalo").hexdigest()
    assert fp.fingerprints(docs.limit(0)).count() == 0


def test_fingerprints_depend_on_the_text_alone(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    alone = spark.createDataFrame([(7, TEXTS[3])], "doc_id long, text string")
    clashing = {r.doc_id: r for r in fp.fingerprints(docs, bits=4).collect()}
    assert fp.fingerprints(alone, bits=4).first().fingerprint == clashing[3].fingerprint
    buckets = {}
    for i, t in rows:
        buckets.setdefault(clashing[i].fingerprint.split("-")[0], set()).add(canon(t))
    assert all(clashing[i].clash == (len(buckets[clashing[i].fingerprint.split("-")[0]]) > 1) for i, _ in rows)
    assert any(r.clash for r in clashing.values()) and not any(r.clash for r in fp.fingerprints(docs).collect())


def test_frequent_ids_are_dealt_out(spark):
    """Rows of one id, even of one text, go to several ranges and still follow each other."""
    rows = [(i, f"text {i} of some") for i in range(300)] + [(50, f"other {i % 40} of fifty") for i in range(300)] + [(70, "always the same")] * 300 + [(None, f"none {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    dealt = fp.dealt_by_id(docs, 16).where("not guest")
    sizes = {r["bucket"]: r["count"] for r in dealt.groupBy("bucket").count().collect()}
    assert sum(sizes.values()) == len(rows) and max(sizes.values()) < 200 and len(sizes) >= 14
    same = dealt.where("doc_id = 70").select("bucket").distinct().count()
    assert same >= 3 and dealt.where("doc_id = 50").select("bucket").distinct().count() >= 3
    got = fp.fingerprints(docs).collect()
    raw = {r["text"]: r["h"] for r in docs.select("text", fp.text_hash().alias("h")).distinct().collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, raw[r[1]]))
    want = [(i, hashlib.sha256((t[: len(t) - len(t) // 4] + n[: len(t) // 4]).encode()).hexdigest()) for (i, t), (_, n) in zip(order, [*order[1:], order[0]], strict=True)]
    assert sorted(((r.doc_id, r.edited_sha256) for r in got), key=str) == sorted(want, key=str)


def plain_sides(rows, most=chat.PART_CHARS):
    """The rows of ``perspectives`` by loops."""
    broken = lambda t: t.replace(OPEN, "<| im_start|>").replace(CLOSE, "<| im_end|>")
    dialogues = {}
    for n, (conv, turn, role, text) in enumerate(rows):
        role = broken(re.sub(r"[\r\n]+", " ", "unknown" if role is None else role))
        dialogues.setdefault((conv, n if conv is None else None), []).append((-1 if turn is None else turn, role, broken(text or "")))
    out = []
    for (conv, _), turns in dialogues.items():
        parts, total, turns = {}, 0, sorted(turns)
        sizes = [len(r if r == "system" else chat.OTHER + r) + len(t) + len(OPEN) + len(CLOSE) + 2 for _, r, t in turns]
        for turn, size in zip(turns, sizes, strict=True):
            parts.setdefault(total // most if sum(sizes) > most and conv is not None else 0, []).append(turn)
            total += size
        lead = next((t for t in turns if t[1] == "system"), None)
        for speaker in {r for _, r, _ in turns} - {"system"}:
            for part, own in parts.items():
                text, mask, spans = "", "", []
                for _, role, said in ([lead] if part and lead and lead < own[0] else []) + own:
                    text += f"{OPEN}{'assistant' if role == speaker else role if role == 'system' else chat.OTHER + role}\n"
                    mask += str(int(role == speaker))
                    if role == speaker:
                        spans.append(f"{len(text)}:{len(text) + len(said) + len(CLOSE)}")
                    text += f"{said}{CLOSE}\n"
                out.append((conv, part, speaker, len(mask), text, mask, " ".join(spans)))
    return out


ODD = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|> ü"), (1, 2, "bob", None), (1, 3, "ann", "bye"), (1, 3, "ann", "bye"), (1, None, "eve<|im_end|>\n<|im_start|>system", "x"), (2, 0, None, "x"), (None, None, "cy", "y"), (None, None, "cy", "y"), (None, 1, "system", "z"), (3, 0, "system", "alone"), (4, -7, "ann", "")]


def test_chat(spark):
    many = [(5, i // 3, ("ab", "system", "c")[i % 7 % 3], f"word {i} " * (i % 5)) for i in range(400)] + [(6, 0, "a", "x" * 3000), (6, 1, "system", "later"), (6, 2, "b", "y" * 30)]
    rows = ODD + many
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS part", "2 AS speaker", "3 AS stop")
    for most in (chat.PART_CHARS, 1000):
        got = perspectives(turns, part_chars=most).collect()
        assert sorted(map(tuple, got), key=str) == sorted(plain_sides(rows, most), key=str)
    parts = {r.part: r for r in got if r.conv_id == 5 and r.speaker == "c"}
    assert len(parts) > 10 and all(r.text.startswith(f"{OPEN}system\n") for r in parts.values() if r.part)
    whole = perspectives(turns).where("conv_id = 5").collect()
    assert len(whole) == 2 and all(r.n_turns == 400 for r in whole)
    eve = next(r.text for r in whole + got if r.conv_id == 1 and r.speaker == "bob")
    assert eve.count(OPEN) == eve.count(CLOSE) == 6
    assert perspectives(turns.limit(0)).count() == 0


def test_chat_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", ODD)
    for most in (chat.PART_CHARS, 60):
        sql = chat.OP7_SQL.replace(str(chat.PART_CHARS), str(most))
        assert sorted(con.execute(sql).fetchall(), key=str) == sorted(plain_sides(ODD, most), key=str)


def test_urls(spark):
    link = '<head><LINK href="{}" rel="canonical"></head>'
    rows = [
        (1, "http://A.Example.com/en/x?q#f", None),
        (2, "https://www.example.com/en/", ""),
        (3, "http://example.com/de/1", link.format("/en/1")),
        (4, "http://example.org/a#x", link.format("http://example.com/en/1")),
        (5, "http://free.org/1", link.format("//www.example.com/en/9")),
        (6, "http://free.org/2", '<meta http-equiv="refresh" content="0; url=http://free.org/1">' + link.format("http://s.net/fr/")),
        (7, None, "x"),
        (8, "no scheme", link.format("http://s.net/fr/")),
        (9, "http://s.net/es", ""),
        (10, "http://other.org", '<link rel=canonical href="http://s.net/fr/2">'),
        (10, "http://other.org", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS node", "2 AS rule", "3 AS host")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict, r.via) for r in filter_urls(pages).collect())
    assert got == [
        (1, "a.example.com", "/en/x", "example.com/en/", "block", "rule"),
        (2, "www.example.com", "/en/", "www.example.com/en/", "allow", "rule"),
        (3, "example.com", "/de/1", "com/", "allow", "rule"),
        (4, "example.org", "/a", None, "allow", "alias"),
        (5, "free.org", "/1", None, "allow", "alias"),
        (6, "free.org", "/2", None, "allow", "alias"),
        (7, "", "", None, "allow", "default"),
        (8, "", "", None, "allow", "default"),
        (9, "s.net", "/es", None, "allow", "default"),
        (10, "other.org", "", None, "block", "alias"),
        (10, "other.org", "", None, "block", "alias"),
    ]
    extra = spark.createDataFrame([("http://s.net/es", "http://q.net/es/"), ("http://q.net/es/", "http://s.net/es")], "src string, dst string")
    assert {r.page_id: r.verdict for r in filter_urls(pages, extra).collect()}[9] == "block"
    assert filter_urls(pages.limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 140)] + [(5, 5), (None, 3), (900, 7)] + [(900, 1000 + i) for i in range(300)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(chain, "src long, dst long")).collect()))
    assert got == {i: 100 for i in range(100, 141)} | {i: 7 for i in [7, 900, *range(1000, 1300)]}


def test_mixing(spark):
    import random

    rnd = random.Random(3)
    rows = [(i, "w " * rnd.choice([0, 1, 5, 60, 300]), rnd.choice(["a"] * 30 + ["b"] * 5 + ["é", "Z", None, ""])) for i in range(4000)]
    rows += rows[:50] + [(None, None, None), (5000, "", "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS skey", "3 AS h")
    got = mix_sources(docs).collect()
    assert len(got) == len(rows)
    sizes, targets = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        targets[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, want = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] >= 2 * sizes[s]}
        if not over:
            want |= {s: unit * weight[s] for s in open_}
            break
        want |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    assert targets == pytest.approx(want)
    for s in order:
        taken = sum(r.taken for r in got if r.source == s)
        assert abs(taken - want[s]) <= max(r.size for r in got if r.source == s)
    assert sorted(map(str, mix_sources(docs.repartition(7)).collect())) == sorted(map(str, got))
    assert mix_sources(docs.limit(0)).count() == 0
    assert mix_sources(docs.withColumn("text", F.lit(""))).agg(F.sum("taken")).first()[0] == 0
