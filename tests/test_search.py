"""Ranked search in blocks against plain BM25."""

import math
import random
from collections import Counter

import pytest

from noticeloom.operators import search as sr


def plain(docs, queries, k):
    own = [(i, Counter(t.split())) for i, t in docs if t is not None and i is not None]
    mean = sum(sum(c.values()) for _, c in own) / max(len(own), 1)
    out = {}
    for q, text in queries:
        terms = set((text or "").split())
        df = {t: sum(t in c for _, c in own) for t in terms}
        idf = {t: math.log(1 + (len(own) - df[t] + 0.5) / (df[t] + 0.5)) for t in terms}
        scored = [(-round(sum(idf[t] * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for t in terms if c[t]), 6), i) for i, c in own if terms & set(c)]
        for n, (score, i) in enumerate(sorted(scored)[:k], 1):
            out[q, n] = (i, pytest.approx(-score, abs=2e-6))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    text = lambda n: " ".join(rng.choices(vocabulary, weights, k=n))
    docs = [(i, text(rng.randrange(1, 60))) for i in range(2500)] + [(3000, None), (None, "w1"), (3001, "")]
    docs += [(4000 + i, docs[7][1]) for i in range(30)]  # ties
    queries = [(q, text(rng.randrange(1, 25))) for q in range(40)] + [(90, "absent"), (91, ""), (92, None), (93, docs[7][1])]
    return docs, queries


@pytest.mark.parametrize("k, cells, block, words", [(5, 3000, 7, 10**6), (50, 4_000_000, 256, 120)])
def test_same_as_plain(spark, corpus, monkeypatch, k, cells, block, words):
    for name, value in (("CELLS", cells), ("BLOCK_QUERIES", block), ("PASS_WORDS", words)):
        monkeypatch.setattr(sr, name, value)
    docs, queries = corpus
    d = spark.createDataFrame(docs, "id long, text string").repartition(3)
    q = spark.createDataFrame(queries, "query_id long, query string")
    got = {(r.query_id, r.rank): (r.id, r.score) for r in sr.ranked_search(d, q, "id", "text", k).collect()}
    assert got == plain(docs, queries, k)


def test_empty_sides(spark):
    d, q = spark.createDataFrame([("a", "x y")], "id string, text string"), spark.createDataFrame([("q", "x")], "query_id string, query string")
    assert [tuple(r)[:3] for r in sr.ranked_search(d, q, "id", "text").collect()] == [("q", 1, "a")]
    assert sr.ranked_search(d.limit(0), q, "id", "text").count() == sr.ranked_search(d, q.limit(0), "id", "text").count() == 0
