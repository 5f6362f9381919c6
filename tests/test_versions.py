"""Stores: commits are whole, readers are pinned, and an ingest that is killed anywhere ends as if it had not been."""

import random

import pytest
from pyspark.sql import functions as F

from noticeloom.operators import ordering as od
from noticeloom.operators.joins import matching
from noticeloom.sources import versions as vs
from noticeloom.streaming import jobs


class Killed(Exception):
    pass


class Fragile(vs.Store):
    """Dies before or after the n-th of its writes."""

    def __init__(self, spark, path, dies: float):
        super().__init__(spark, path)
        self.left = dies

    def _step(self, act):
        self.left -= 1
        if self.left == 0:
            raise Killed
        out = act()
        if self.left == 0.5:
            raise Killed
        return out

    def stage(self, table, rows):
        return self._step(lambda: super(Fragile, self).stage(table, rows))

    def commit(self, *args, **kinds):
        return self._step(lambda: super(Fragile, self).commit(*args, **kinds))


def test_commits(spark, tmp_path):
    store = vs.Store(spark, f"{tmp_path}/s")
    assert store.snapshot() == vs.Snapshot()
    rows = lambda *x: spark.createDataFrame([(v,) for v in x], "a long")
    one = store.commit(store.snapshot(), appended=[store.stage("t", rows(1, 2)), store.stage("u", rows(7))], numbers={"n": 3})
    pinned = store.read("t", one)
    two = store.commit(one, appended=[store.stage("t", rows(3))], replaced=[store.stage("u", rows())], batch=5)
    store.stage("t", rows(9))  # never committed
    values = lambda df: sorted(r.a for r in df.collect())
    assert (values(store.read("t")), values(store.read("u")), values(pinned)) == ([1, 2, 3], [], [1, 2])
    assert (two.version, two.batch, two.numbers, store.snapshot(1)) == (2, 5, {"n": 3}, one)
    with pytest.raises(ValueError, match="moved on"):
        store.commit(one, appended=[store.stage("t", rows(4))])
    with pytest.raises(ValueError, match="other columns"):
        store.commit(two, appended=[store.stage("t", rows(4).withColumnRenamed("a", "b"))])
    with pytest.raises(ValueError, match="no version"):
        store.snapshot(9)
    three = store.commit(two, appended=[store.stage("t", rows(4))], most_parts=2)
    assert len(three.parts["t"]) == 1 and values(store.read("t")) == [1, 2, 3, 4] and values(store.read("t", two)) == [1, 2, 3]
    assert store.snapshot() == vs.Store(spark, f"{tmp_path}/s/").snapshot()


@pytest.mark.parametrize("dies", [1, 1.5, 2, 2.5])
def test_loads_that_die(spark, tmp_path, dies):
    path = f"{tmp_path}/s"
    old = spark.createDataFrame([(1, "a", None, None), (2, "b", None, None)], "k long, v string, createdAt timestamp, updatedAt timestamp")
    assert vs.replace_load(vs.Store(spark, path), "t", old, "k") == {"rows": 2, "keyed": 2}
    updates = spark.createDataFrame([(2, "B"), (3, "c")], "k long, v string")
    with pytest.raises(Killed):
        vs.upsert_load(Fragile(spark, path, dies), "t", updates, "k", ["v"], F.lit("2026-01-01").cast("timestamp"))
    store = vs.Store(spark, path)
    found = sorted((r.k, r.v) for r in store.read("t").collect())
    assert found == ([(1, "a"), (2, "B"), (3, "c")] if dies == 2.5 else [(1, "a"), (2, "b")])
    assert vs.upsert_load(store, "t", updates, "k", ["v"], F.lit("2026-01-01").cast("timestamp"))["kept"] == 1
    assert sorted((r.k, r.v) for r in store.read("t").collect()) == [(1, "a"), (2, "B"), (3, "c")]
    with pytest.raises(ValueError, match="duplicate"):
        vs.replace_load(store, "t", old.union(old), "k")
    assert store.read("t").count() == 3 and vs.replace_load(store, "t", old.limit(1), "k", dry_run=True) == {"rows": 1, "keyed": 1} and store.read("t").count() == 3


SCHEMA = "url string, base string, published timestamp, event long"


def listing(batches):
    """What a row-by-row ingest of these batches stores."""
    stored, used, low, high, dated = {}, set(), None, None, False
    for rows in batches:
        kept = [r for r in rows if not (dated and r[2] is None)]
        order = sorted(kept, key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
        known, queued, some = False, [], bool(stored)
        for url, base, when, event in order:
            if url in stored:
                known = True
            elif url not in [q[0] for q in queued]:
                queued.append((url, base, when, event, "fresh" if not some else "backfill" if known else "newer"))
        newer = [q for q in queued if q[4] == "newer"]
        back = [q for q in queued if q[4] == "backfill"]
        for i, q in enumerate(queued):
            number = jobs.FIRST_ORDER - i if q[4] == "fresh" else high + len(newer) - newer.index(q) if q[4] == "newer" else low - 1 - back.index(q)
            slug, n = q[1], 2
            while slug in used:
                slug, n = f"{q[1]}-{n}", n + 1
            used.add(slug)
            stored[q[0]] = (q[3], q[4], number, slug)
        low, high = min(v[2] for v in stored.values()), max(v[2] for v in stored.values())
        dated = dated or any(r[2] is not None for r in kept)
    return stored


def batches_of(rng, n):
    event = iter(range(10_000))
    return [[(f"https://a.org/{rng.randrange(40)}", rng.choice(["x", "x-2", "y"]), None if rng.random() < 0.1 else rng.randrange(10**6), next(event)) for _ in range(rng.randrange(1, 25))] for _ in range(n)]


def frame(spark, rows):
    raw = spark.createDataFrame(rows, "url string, base string, s long, event long")
    return raw.select("url", "base", F.timestamp_seconds("s").alias("published"), "event")


def records(store):
    return {r.url: (r.event, r.candidate_class, r.sortOrder, r.slug) for r in store.read("records").collect()}


def test_ingest_dies_anywhere(spark, tmp_path):
    batches = batches_of(random.Random(3), 2)
    want = listing(batches)
    for dies in (2, 3.5, 4.5):  # behind the first of three writes, after the third, after the commit
        path = f"{tmp_path}/{dies}"
        for i, rows in enumerate(batches):
            batch = frame(spark, rows)
            if i == 1:
                with pytest.raises(Killed):
                    jobs.ingest_batch(batch, i, Fragile(spark, path, dies))
                got = records(vs.Store(spark, path))
                assert len(got) == len(listing(batches[: 2 if dies == 4.5 else 1]))  # all of the batch or nothing
            jobs.ingest_batch(batch, i, vs.Store(spark, path))
        store = vs.Store(spark, path)
        assert records(store) == want, dies
        at = store.snapshot()
        assert at.numbers["records"] == len(want) == store.read("hashes").count() == store.read("slugs").distinct().count()
        assert (at.numbers["min_order"], at.numbers["max_order"]) == (min(v[2] for v in want.values()), max(v[2] for v in want.values()))
        jobs.ingest_batch(frame(spark, batches[1]), 1, store)
        assert store.snapshot() == at  # a replayed batch is not taken again


def test_stream_dies_and_goes_on(spark, tmp_path):
    batches = [[r for r in b if r[2] is not None] for b in batches_of(random.Random(9), 3)]
    for i, rows in enumerate(batches):
        frame(spark, rows).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        if i == 1:
            dying = jobs.ingest(stream, Fragile(spark, f"{tmp_path}/s", 3), f"{tmp_path}/c")
            with pytest.raises(Exception, match="Killed"):
                dying.awaitTermination()
        jobs.ingest(stream, vs.Store(spark, f"{tmp_path}/s"), f"{tmp_path}/c").awaitTermination()
    assert records(vs.Store(spark, f"{tmp_path}/s")) == listing(batches)


def test_empty_batches(spark, tmp_path):
    store = vs.Store(spark, f"{tmp_path}/s")
    jobs.ingest_batch(frame(spark, []), 0, store)
    assert store.read("records").count() == 0 and store.snapshot().numbers == {"records": 0}
    jobs.ingest_batch(frame(spark, [("https://a.org/1", "x", 5, 1), (None, "x", 5, 2)]), 1, store)
    jobs.ingest_batch(frame(spark, []), 2, store)
    assert records(store) == {"https://a.org/1": (1, "fresh", jobs.FIRST_ORDER, "x")} and store.snapshot().batch == 2


def replay(rows, existing):
    used, out = set(existing), {}
    for _, row, base in sorted(rows):
        slug, i = base, 2
        while slug in used:
            slug, i = f"{base}-{i}", i + 1
        used.add(slug)
        out[row] = slug
    return out


@pytest.mark.parametrize("seed", range(4))
def test_slugs_as_row_by_row(spark, seed):
    rng = random.Random(seed)
    pool = ["a", "a-2", "a-3", "a-4", "a-2-2", "a-2-3", "a-5", "b", "b-1", "b-02", "b-2", "c-7", "a-2-2-2", "a-10"]
    rows = [(rng.randrange(100), i, rng.choice(pool[: rng.choice([3, 6, 14])])) for i in range(250)]
    held = [] if seed % 2 else ["a", "a-3", "a-7", "a-2-4", "b-2", "c-7", "zz", "a-2-2", "a-12345678901234567890"]
    existing = spark.createDataFrame([(x,) for x in held], "slug string") if held else None
    got = od.unique_slugs(spark.createDataFrame(rows, "arrival long, row_id long, base string"), "base", "arrival", "row_id", existing, large=60 if seed > 1 else od.LARGE_GROUP)
    assert {r.row_id: r.slug for r in got.collect()} == replay(rows, held)


def test_one_stem_for_all(spark):
    rows = [(i, i, "s" if i % 3 else f"s-{2 + i // 2}") for i in range(3000)] + [(5, 9999, None)]
    got = {r.row_id: r.slug for r in od.unique_slugs(spark.createDataFrame(rows, "arrival long, row_id long, base string"), "base", "arrival", "row_id", large=500).collect()}
    assert got.pop(9999) is None and got == replay(rows[:-1], [])


def test_stored_side_is_not_shuffled(spark, tmp_path):
    """A batch's keys go to where the registry lies; only more than may be broadcast are joined by a shuffle."""
    store = vs.Store(spark, f"{tmp_path}/s")
    hashes = spark.range(1000).select(F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    images = spark.createDataFrame([("https://a.org/1", "f1")], "url string, filename string")
    vs.snapshot_load(store, spark.range(10).withColumnRenamed("id", "o"), "o", images, hashes, 4)
    keys = hashes.limit(7)
    found = matching(store.read("hashes"), keys, "hash")
    plan = found._jdf.queryExecution().executedPlan().toString()
    stored = plan[plan.index("BroadcastHashJoin") : plan.index("BroadcastExchange")]
    assert "Exchange hashpartitioning" not in stored and found.count() == 7
    assert matching(store.read("hashes"), keys, "hash", limit=3).count() == 7
    spans = store.read("records").groupBy(F.input_file_name()).agg(F.min("o").alias("low"), F.max("o").alias("high"), F.count("*").alias("n")).collect()
    assert sum(s.n for s in spans) == 10 and all(s.high - s.low + 1 == s.n for s in spans) and len(spans) > 1 and store.read("images").count() == 1
