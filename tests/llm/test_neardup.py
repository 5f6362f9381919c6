"""Shingles and near duplicates against plain Python sets."""

import random
import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from noticeloom.llm import neardup, shingles
from noticeloom.llm.neardup import near_duplicates


def plain_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_components(rows, num, den):
    sets = [plain_shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if rows[i][0] == rows[j][0] and sets[i] and sets[j] or same and den * same >= num * (len(sets[i]) + len(sets[j]) - same):
                up[root(i)] = root(j)
    least = {}
    for i in range(len(rows)):
        least[root(i)] = min(least.get(root(i), rows[i][0]), rows[i][0])
    return sorted((r[0], len(s), least[root(i)], r[0] == least[root(i)]) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aAbé \n\x0b\x85 "), max_size=40)), max_size=6), st.integers(3, 40))
def test_shingle_sets(texts, piece):
    old, shingles.PIECE = shingles.PIECE, piece
    try:
        got = [s.tolist() for s in shingles.shingle_sets(pa.array(["skip", *texts], pa.string())[1:])]
    finally:
        shingles.PIECE = old
    want = [plain_shingles(t) for t in texts]
    assert [len(s) for s in got] == [len(s) for s in want]
    code = {}
    for own, plain in zip(got, want, strict=True):
        assert own == sorted(own)
        for other, p in zip(got, want, strict=True):
            assert len(set(own) & set(other)) == len(plain & p)
        code[frozenset(plain)] = own
    assert len({tuple(v) for v in code.values()}) == len(code)


def corpus(seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 5)))
    text = lambda n: [word() for _ in range(n)]
    shared = text(60)
    rows = [(i, t) for i, t in enumerate(["", None, " \n", "One", "one", "a b c d", "A B c d", "a b c d e"])]
    for _ in range(60):
        base = text(rnd.choice([8, 30, 90, 400]))
        for _ in range(rnd.choice([1, 1, 2, 5, 12])):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 3])):
                copy[rnd.randrange(len(copy))] = word()
            if rnd.random() < 0.3:
                copy[rnd.randrange(len(copy)) :] += shared
            rows.append((len(rows), " ".join(copy)))
    hot = text(120)
    for _ in range(150):
        copy = list(hot)
        for _ in range(rnd.choice([0, 1, 2, 3, 4])):
            copy[rnd.randrange(len(copy))] = word()
        rows.append((len(rows), " ".join(copy)))
    rnd.shuffle(rows)
    ids = list(range(len(rows)))
    return [(i * 3, t) for i, (_, t) in zip(ids, rows, strict=True)]


def test_components(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS rep", "2 AS value", "'x' AS sketch", "3 AS n_shingles")
    for num, den in ((85, 100), (4, 5)):
        want = plain_components(rows, num, den)
        for block in (1000, 40):
            got = near_duplicates(docs.repartition(5), num, den, block_docs=block).collect()
            assert sorted(map(tuple, got)) == want


def test_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (None, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, None, True), (None, 0, None, True), (4, 0, 4, True)], key=str)
    assert near_duplicates(docs.limit(0)).count() == 0
    two = spark.createDataFrame([(1, "a b c d e f"), (1, "x y z u v w"), (2, "x y z u v w"), (3, "a b c d e f")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_duplicates(two).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_a_pair_is_judged_like_a_block():
    import numpy as np

    from noticeloom.llm import neardup as nd

    rnd = np.random.default_rng(5)
    said = []
    for _ in range(400):
        n = int(rnd.integers(1, 400))
        a = np.unique(rnd.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rnd.random(len(a)) < rnd.uniform(0.8, 1)], rnd.integers(0, 1 << 62, int(rnd.integers(0, n // 10 + 2))).astype(np.uint64)]))
        same = len(np.intersect1d(a, b))
        far = rnd.integers(0, 1 << 62, 50).astype(np.uint64)
        far.sort()
        block = nd.link_block([a, b, far], 85, 100, nd.SKETCH)
        said.append(nd.linked(a, b, 85, 100, nd.SKETCH))
        assert said[-1] == nd.linked(b, a, 85, 100, nd.SKETCH) == ((0, 1) in block) == (same > 0 and 100 * same >= 85 * (len(a) + len(b) - same))
    assert 50 < sum(said) < 350


def test_long_lists_cost_in_proportion(spark):
    """A list of near copies needs a seat or two a document, not one for every chunk of the others."""
    from noticeloom.llm.neardup import cross_blocks

    seats = []
    for n in (5000, 20_000):
        held = spark.range(n).selectExpr("7L AS value", "id AS doc_id", "100L AS n_shingles", f"CASE WHEN id < {n} - 9 THEN 0L ELSE id END AS label")
        got = cross_blocks(held, 800, 10**9)
        blocks = got.groupBy("low", "high").count()
        seats.append(got.count())
        assert blocks.agg({"count": "max"}).first()[0] <= 2 * 800
        pairs = got.where("in_low").selectExpr("doc_id AS a", "low", "high").join(got.where("NOT in_low OR low = high").selectExpr("doc_id AS b", "low", "high"), ["low", "high"])
        met = pairs.selectExpr("least(a, b) AS x", "greatest(a, b) AS y").where(f"x <> y AND y >= {n} - 9").distinct().count()
        assert met == 9 * (n - 9) + 36
    assert seats[1] < 4.2 * seats[0] and seats[1] < 1.1 * 20_000


def test_long_chains(spark):
    from noticeloom.llm.components import connected_components

    edges = spark.range(306).selectExpr("id * 7 % 307 AS src", "(id + 1) * 7 % 307 AS dst").repartition(4)
    got = connected_components(edges).collect()
    assert len(got) == 307 and {r.component for r in got} == {0}


def test_groups_around_the_threshold(spark, monkeypatch):
    """Copies of one text that are about as like as the threshold: all links are found, and a document is not compared once for each shared value."""
    rng = random.Random(6)
    base = [f"word{i}" for i in range(120)]
    texts = []
    for _ in range(600):
        own = list(base)
        for at in rng.sample(range(120), rng.choice([1, 1, 2, 2, 3])):
            own[at] = f"x{rng.random()}"
        texts.append(" ".join(own))
    seats = []
    placed = neardup.placed_links
    monkeypatch.setattr(neardup, "placed_links", lambda rows, s, *rest: seats.append(s.count()) or placed(rows, s, *rest))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, 85, 100).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    up = list(range(600))
    for i in range(600):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if up[i] != up[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                low, high = sorted((up[i], up[j]))
                up = [low if u == high else u for u in up]
    assert got == dict(enumerate(up))
    assert sum(seats) <= 25 * 600
