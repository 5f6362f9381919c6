"""Operator 12 against plain search for runs, suffix trees against sorted suffixes."""

import hashlib
import random
import time
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from noticeloom.llm.runs import Extensions, collapsed, op12_periodic_runs, periodic_runs, repeat_tail, runs_of_texts


def plain_runs(words, least_length=6, least_exponent=4):
    """Every stretch in which words q apart are equal, and no smaller q does."""
    n, found = len(words), set()
    for q in range(1, n // least_exponent + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least_length, least_exponent * q):
                stretch = words[i : i + length]
                if all(stretch[r:] != stretch[: length - r] for r in range(1, q)):
                    found.add((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_collapse(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40), max_size=4), st.integers(2, 5), st.integers(1, 8))
def test_runs(texts, exponent, length):
    for words, runs in zip(texts, runs_of_texts(texts, length, exponent) if texts else [], strict=True):
        assert [tuple(r) for r in runs.tolist()] == plain_runs(words, length, exponent)
        assert collapsed(words, runs) == plain_collapse(words, [tuple(r) for r in runs.tolist()])


def test_planted_periods():
    rng = random.Random(3)
    for _ in range(300):
        words = [bytes([97 + rng.randrange(20)]) for _ in range(rng.randrange(10, 200))]
        for _ in range(rng.randrange(1, 4)):
            a, p = rng.randrange(len(words)), rng.randrange(1, 12)
            b = min(len(words), a + rng.randrange(2, 9) * p)
            words[a:b] = [words[a + (i - a) % p] for i in range(a, b)]
        assert [tuple(r) for r in runs_of_texts([words], 6, 4)[0].tolist()] == plain_runs(words)


def test_extensions():
    rng = random.Random(7)
    for size in (1, 2, 5):
        s = [rng.randrange(1, size + 1) for _ in range(80)]
        lce = Extensions([*s, 0], size + 1)
        assert lce.ranked.tolist() == sorted(range(81), key=lambda i: [*s, 0][i:])
        i, j = map(np.array, zip(*[(a, b) for a in range(80) for b in range(80) if a != b], strict=True))
        common = [next((k for k in range(81) if [*s, 0][a + k] != [*s, 0][b + k])) for a, b in zip(i, j, strict=True)]
        assert lce(i, j).tolist() == common


def test_long_text():
    began = time.perf_counter()
    words = [b"w%d" % (i % 5000) for i in range(100_000)] + [b"x"] * 50_000
    assert [tuple(r) for r in runs_of_texts([words], 6, 4)[0].tolist()] == [(0, 100_000, 5000), (100_000, 50_000, 1)]
    assert time.perf_counter() - began < 10


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op12_periodic_runs(spark, folder).collect()
    assert len(rows) == len(texts)
    assert sum(r.n_runs > 0 for r in rows) > 20
    for r in rows:
        words = (texts[r.doc_id] or "").encode().split()
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words) if n < 1500 else [tuple(x) for x in runs_of_texts([words], 6, 4)[0].tolist()]
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=(None, None, None))
        milli = None if best[0] is None else 1000 * best[1] // best[2]
        listed = "".join(f"{a},{b},{q}\n" for a, b, q in runs)
        assert r.asDict() == {
            "doc_id": r.doc_id, "n_runs": len(runs), "start": best[0], "length": best[1], "period": best[2], "exponent_milli": milli,
            "runs_sha256": hashlib.sha256(listed.encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(plain_collapse(words, runs)).hexdigest(),
        }


def test_odd_rows(spark):
    rows = [(1, None, 0), (1, "", 0), (None, "a b " * 6, 0), (2, "x\x0by\tx y x y x\ny", 0), (2, "x y x y x y x y", 0), (3, "é " * 5, 0), (4, "z", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int").withColumnRenamed("runs", "n_bytes")
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(docs).collect()), key=str)
    want = [(1, [], ""), (1, [], ""), (None, [(0, 6, 1)], "a b"), (2, [(0, 8, 2)], "x y"), (2, [(0, 8, 2)], "x y"), (3, [], "é é é é é"), (4, [], "z")]
    assert got == sorted(want, key=str)
    assert periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert repeat_tail(None, [b"a"]) == [b"a"] and repeat_tail(5, []) == []
