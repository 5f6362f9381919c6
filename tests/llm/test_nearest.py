import numpy as np

from noticeloom.llm import nearest as op
from noticeloom.llm.nearest import nearest


def brute(rows, queries, k=20):
    out = []
    for q, v in queries:
        scored = []
        for i, w in rows:
            if i != q and len(v) == len(w):
                total = 0.0
                for a, b in zip(w, v, strict=True):
                    total += a * b
                scored.append((-total, i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return out


def test_recall_and_scores(spark):
    rnd = np.random.default_rng(0)
    x = rnd.standard_normal((3000, 24)).astype(np.float32) * rnd.uniform(0.2, 3, (3000, 1)).astype(np.float32)
    x[100:400] = x[100]  # one very common vector
    rows = [(i * 7, [float(a) for a in v]) for i, v in enumerate(x)]
    odd = [(1, None), (2, [0.0] * 24), (3, [float("nan")] * 24), (4, [float("inf")] + [0.0] * 23), (5, [None] + [1.0] * 23), (8, []), (None, [1.0] * 24)]
    other = [(20 * i, [1.0, float(i % 3), 0.5]) for i in range(1, 8)]  # vectors of another length
    frame = spark.createDataFrame(rows + odd + other[::2], "vec_id long, embedding array<float>").selectExpr("*", "1 AS score", "2 AS rank", "3 AS seat", "4 AS dim", "5 AS asks")
    queries = spark.createDataFrame([r for r in rows if r[0] % 20 == 0 and r[0] > 200] + other, frame.selectExpr("vec_id", "embedding").schema)
    asked = [(i, v) for i, v in rows if i % 20 == 0 and i > 200] + other
    want = brute(rows + other[::2], asked)
    for block, chunk in ((700, 60), (10_000, 10_000)):  # neither blocks nor chunks decide what is found
        got = nearest(frame, queries, block=block, chunk=chunk).collect()
        pairs = {(r.query_id, r.vec_id) for r in got}
        assert len(got) == len(want)
        recall = np.mean([(q, i) in pairs for q, _, i, _ in want])
        assert recall >= 0.97, recall
        exact = {(q, i): s for q, _, i, s in brute(rows + other[::2], asked, k=len(rows))}
        assert all(exact[r.query_id, r.vec_id] == r.score for r in got)
        by_query = {}
        for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
            by_query.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert all(v == sorted(v) for v in by_query.values())


def test_few(spark):
    frame = spark.createDataFrame([(20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, -0.5]), (3, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    got = nearest(frame, frame.where("vec_id % 20 = 0")).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id, r.score) for r in got] == [(1, 1, 0.5), (2, 2, 0.5), (3, 3, -1.0)]
    twice = frame.unionByName(spark.createDataFrame([(20, [1.0, 0.0]), (1, [0.5, 0.5])], frame.schema))
    got = nearest(twice, twice.where("vec_id % 20 = 0")).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id) for r in got] == [(1, 1), (2, 1), (3, 2), (4, 3)]
    assert nearest(frame.limit(0), frame).count() == 0
    assert nearest(frame, frame.limit(0)).count() == 0


def test_index_prunes():
    """On directions without any structure, the hardest case, a small share is verified and little is missed."""
    rnd = np.random.default_rng(3)
    x = rnd.standard_normal((50_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[-500:] = x[:500] + 0.01 * rnd.standard_normal((500, 64))  # near copies are found at a small radius
    index = op.Block(np.arange(len(x)), x)
    asked = np.r_[np.arange(20), np.arange(1000, 1040)]
    found = list(index.search(asked, x[asked], 20))
    exact = x[asked] @ x.T
    exact[np.arange(len(asked)), asked] = -9
    want = np.argsort(-exact, axis=1)[:, :20]
    recall = np.mean([len({i for i, _ in got} & set(w.tolist())) / 20 for got, w in zip(found, want, strict=True)])
    assert recall >= 0.95, recall
    assert index.verified / len(asked) / len(x) < 0.15
    assert all(got[0][0] == q + 49_500 for q, got in zip(asked[:20].tolist(), found, strict=False))


def test_base_is_shuffled_once(spark):
    """However many blocks there are, a vector goes to one, and only queries go to all."""
    rnd = np.random.default_rng(4)
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(rnd.standard_normal((2000, 8)))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    seen = []
    real = op.answered
    counted = spark.sparkContext.accumulator(0)

    def counting(batches, k):
        def each():
            for b in batches:
                counted.add(b.num_rows)
                yield b

        return real(each(), k)

    op.answered = counting
    try:
        for block in (2000, 250):
            before = counted.value
            assert nearest(frame, frame.where("vec_id % 20 = 0"), block=block).count() == 2000
            seen.append(counted.value - before)
    finally:
        op.answered = real
    assert seen == [2000 + 100, 2000 + 8 * 100]
