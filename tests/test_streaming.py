"""Streams give what the same work on tables gives."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noticeloom.streaming import jobs

SF = "/root/testdata/sf0.001"


def landed(spark, tmp_path, df, n, order):
    """The rows in n files, in order of time."""
    for i, part in enumerate(df.orderBy(order).randomSplit([1.0] * n, 4) if order is None else [df.where((F.col("part_no") == k)) for k in range(n)]):
        part.drop("part_no").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(df.drop("part_no").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def events(spark, n=4):
    e = spark.read.parquet(f"{SF}/events.parquet")
    e = e.select("event_id", F.concat_ws(":", "event_type", (F.col("user_id") % 5).cast("string")).alias("hit_key"), F.col("ts").cast("timestamp").alias("ts"))
    bounds = e.agg(F.min("ts").cast("double").alias("a"), F.max("ts").cast("double").alias("b")).first()
    return e.withColumn("part_no", F.least(F.lit(n - 1), ((F.col("ts").cast("double") - bounds.a) / (bounds.b - bounds.a) * n).cast("int")))


def test_requests_once(spark, tmp_path):
    df = events(spark)
    once = jobs.requests_once(landed(spark, tmp_path, df, 4, "ts"), "hit_key", "ts", "4000 days")
    query = once.writeStream.format("memory").queryName("once").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    keys = [r.hit_key for r in spark.table("once").collect()]
    assert len(keys) == len(set(keys)) == df.select("hit_key").distinct().count()


def test_admission_rule():
    kept, out = [], []
    for now in (0, 10, 20, 60):
        kept, ok, _, retry = jobs.admit(kept, now * jobs.SECOND, 60 * jobs.SECOND, 2)
        out.append((ok, retry))
    assert out == [(True, 0), (True, 0), (False, 40), (True, 0)]


def one_by_one(times, kept, window, most):
    out = []
    for t in times:
        kept, *decision = jobs.admit(kept, t, window, most)
        out.append(tuple(decision))
    return out, kept


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=60), st.lists(st.integers(-60, 0), max_size=4), st.integers(1, 80), st.integers(1, 4), st.integers(0, 60))
def test_decisions_at_once(times, kept, window, most, cut):
    unit = 250_000
    times, kept = sorted(t * unit for t in times), sorted(t * unit for t in kept)[-most:]
    want, _ = one_by_one(times, kept, window * unit, most)
    got, left = [], np.array(kept, np.int64)
    for part in (times[:cut], times[cut:]):  # as batches come
        *found, left = jobs.decide(np.array(part, np.int64), left, window * unit, most)
        got += list(zip(*[x.tolist() for x in found], strict=True))
    assert got == want


def test_one_key_with_pauses(spark):
    rng = np.random.default_rng(5)
    seconds = np.cumsum(rng.choice([1, 2, 30, 200], size=4000, p=[0.5, 0.3, 0.15, 0.05]))
    rows = [("k", i, int(s)) for i, s in enumerate(seconds)] + [(None, 9000 + i, i * 10) for i in range(20)]
    hits = spark.createDataFrame(rows, "hit_key string, event_id long, s long").selectExpr("hit_key", "event_id", "timestamp_seconds(s) AS ts")
    decided = jobs.admission_batch(hits, 60.0, 5)
    want, _ = one_by_one([int(s) * jobs.SECOND for s in seconds], [], 60 * jobs.SECOND, 5)
    assert {r.event_id: (r.ok, r.remaining, r.retry_after) for r in decided.where("hit_key = 'k'").collect()} == dict(enumerate(want))
    assert decided.where("hit_key is null").count() == 20
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert jobs.admission_batch(hits.where("hit_key is not null"), 60.0, 5).select(F.spark_partition_id().alias("p")).distinct().count() > 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_admission_without_times(spark):
    rows = [("a", 1, None), ("a", 2, 0), ("a", 3, 10), ("a", 4, None), ("b", 5, None)]
    hits = spark.createDataFrame(rows, "hit_key string, event_id long, s long").selectExpr("hit_key", "event_id", "timestamp_seconds(s) AS ts")
    got = {r.event_id: (r.ok, r.remaining, r.retry_after) for r in jobs.admission_batch(hits, 60.0, 1).collect()}
    assert got == {1: (False, 0, 0), 2: (True, 0, 0), 3: (False, 0, 50), 4: (False, 0, 0), 5: (False, 0, 0)}


@pytest.mark.parametrize("files", [1, 3])
def test_admission(spark, tmp_path, files):
    jobs.use_rocksdb(spark)
    df = events(spark, files)
    day = 86_400.0
    want = sorted(map(tuple, jobs.admission_batch(df, 7 * day, 3).collect()), key=str)
    assert len({r[3] for r in want}) == 2
    out = jobs.admission_stream(landed(spark, tmp_path, df, files, "ts"), 7 * day, 3, 60 * day)
    query = out.writeStream.format("memory").queryName(f"hits{files}").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(map(tuple, spark.table(f"hits{files}").collect()), key=str)
    assert got == want


def test_in_flight_late_and_idle(spark, tmp_path):
    jobs.use_rocksdb(spark)
    rows = [("a", 1, 100), ("a", 2, 130), ("a", 3, 161), ("b", 4, 100), ("b", 5, None), ("c", 6, 1000), ("a", 7, 50), ("d", 8, 990)]
    hits = spark.createDataFrame(rows, "hit_key string, event_id long, s long").selectExpr("hit_key", "event_id", "timestamp_seconds(s) AS ts")
    table = {r.event_id: r.ok for r in jobs.in_flight(hits, 60.0).collect()}
    assert table == {1: False, 2: True, 3: False, 4: True, 5: False, 6: True, 7: True, 8: True}
    late = 0
    for ids in ((1, 2, 3, 4, 5), (6, 8), (7,)):  # the last comes behind the watermark
        hits.where(F.col("event_id").isin(*ids)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = jobs.in_flight_stream(spark.readStream.schema(hits.schema).parquet(f"{tmp_path}/in"), 60.0)
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out")
        query.awaitTermination()
        late += jobs.late_requests(query)
    got = {r.event_id: r.ok for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: False, 6: True, 8: True} and late == 1
    live = sorted(r.hit_key for r in jobs.live_keys(spark, f"{tmp_path}/c").collect())
    assert live == ["c", "d"] == sorted(r.hit_key for r in jobs.live_keys_batch(hits, 60.0).collect())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=30), st.lists(st.integers(-60, 0), max_size=4), st.integers(1, 80), st.integers(1, 4))
def test_few_decisions(times, kept, window, most):
    times, kept = sorted(times), sorted(kept)[-most:]
    got, left = jobs.decide_few(times, kept, window * jobs.SECOND, most)
    *found, want = jobs.decide(np.array(times, np.int64), np.array(kept, np.int64), window * jobs.SECOND, most)
    assert got == list(zip(*[x.tolist() for x in found], strict=True)) and left == want.tolist()


def test_state_of_many_keys(spark, tmp_path, monkeypatch):
    """Keys are called for and kept by groups; each is still decided, and expires, by itself."""
    monkeypatch.setattr(jobs, "KEY_GROUPS", 8)
    monkeypatch.setattr(jobs, "FEW", 3)
    jobs.use_rocksdb(spark)
    rows = [(f"k{i % 400}" if i % 400 else None, i, i // 400 * 7 + i % 13) for i in range(6000)] + [("k1", 9000 + i, None) for i in range(3)]
    rows += [(f"early{i}", 10000 + i, i) for i in range(100)] + [("at", 20000, 57), ("behind", 20001, 58)]
    rows += [("newest", 30000, 117)]
    hits = spark.createDataFrame(rows, "hit_key string, event_id long, s long").selectExpr("hit_key", "event_id", "timestamp_seconds(s + 1000) AS ts", "s")
    for i in range(3):
        part = F.coalesce(F.least(F.lit(2), F.floor(F.col("s") / 40)), F.lit(0))
        hits.where(part == i).drop("s").write.mode("append").parquet(f"{tmp_path}/in")
        stream = jobs.admission_stream(spark.readStream.schema(hits.drop("s").schema).parquet(f"{tmp_path}/in"), 20.0, 2, 60.0)
        stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()), key=str)
    assert got == sorted(map(tuple, jobs.admission_batch(hits, 20.0, 2).collect()), key=str)
    live = {r.hit_key for r in jobs.live_keys(spark, f"{tmp_path}/c").collect()}
    assert live == {r.hit_key for r in jobs.live_keys_batch(hits, 60.0).collect()} and "behind" in live and "at" not in live and len(live) > 400
    state = spark.read.format("statestore").option("stateVarName", "times").option("flattenCollectionTypes", "true").load(f"{tmp_path}/c")
    assert state.select("key").distinct().count() <= 8
