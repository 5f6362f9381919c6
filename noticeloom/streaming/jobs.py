"""Streams: incremental ingest, requests in flight, admission."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from noticeloom.functions.values import notice_hash, notice_url
from noticeloom.operators.joins import matching
from noticeloom.operators.ordering import LARGE_GROUP, assign_orders, first_of_hash, summed_within, unique_slugs
from noticeloom.session import written
from noticeloom.sources.versions import Snapshot, Store

#: Microseconds, in which times are compared.
SECOND = 1_000_000
#: Outcome of an admission decision.
DECISION = "hit_key string, event_id long, ts timestamp, ok boolean, remaining int, retry_after int"


#: Order of the first notice of a store.
FIRST_ORDER = 300


def ingest_batch(batch: DataFrame, batch_id: int, store: Store, run_ts: Column | None = None, first_order: int = FIRST_ORDER) -> Snapshot:
    """T1 for one micro-batch of ``url, base, published`` and any other columns: what is new joins the store, whole or not at all.

    The batch is a listing, newest first (undated rows last, ties by address). Rows whose address, as its hash, is stored
    are known; undated ones are left out once the store has a dated notice; of rows of one address the first counts (J3, W2). New
    rows before the first known one are ``newer``, behind it ``backfill``, and ``fresh`` in an empty store (W3); they get
    sort orders at either end (W4) and slugs that no stored one has (W7). Records, hashes, slugs, the range of orders and
    the newest time become visible in one commit with the batch's number, so that a batch that is replayed after a crash
    either finds itself committed or begins anew. Only stored hashes and slugs that the batch may meet leave the scan.
    """
    since = store.snapshot()
    if since.batch is not None and batch_id <= since.batch:
        return since
    spark, numbers = batch.sparkSession, since.numbers
    some = numbers.get("records", 0) > 0
    listed = batch.withColumn("hash", notice_hash(notice_url(F.col("url")))).where("hash is not null")
    if "newest" in numbers:
        listed = listed.where("published is not null")
    undated, age = F.col("published").isNull().cast("int"), F.coalesce(-F.unix_micros("published"), F.lit(0))
    order = {"undated": undated, "age": age, "tie": F.xxhash64(*batch.columns)}  # a replayed batch is listed alike
    listed = written(summed_within(listed.withColumns(order | {"whole": F.lit(0)}), "whole", ["undated", "age", "url", "tie"], "position"))
    known = matching(store.read("hashes", since), listed, "hash").select("hash") if some else None
    new, first_known = listed, None
    if known is not None:
        known = written(known)
        first_known = listed.join(known, "hash", "left_semi").agg(F.min("position")).first()[0]
        new = listed.join(known, "hash", "left_anti")
    new = first_of_hash(new, "hash", [F.col("position")])
    kind = F.lit("fresh") if not some else F.lit("newer") if first_known is None else F.when(F.col("position") < first_known, "newer").otherwise("backfill")
    bounds = spark.createDataFrame([(numbers.get("min_order", first_order + 1), numbers.get("max_order", first_order))], "min_order long, max_order long")
    ordered = written(assign_orders(new.withColumn("candidate_class", kind), bounds, "position", first_order, LARGE_GROUP))
    slugs = unique_slugs(ordered, "base", "position", "hash", store.read("slugs", since) if some else None)
    named = ordered.join(slugs.withColumnRenamed("row_id", "hash"), "hash")
    folder = F.concat_ws("-", F.col("sortOrder").cast("string"), "slug")
    seen = Observation()
    records = named.select(*batch.columns, "hash", "candidate_class", "sortOrder", "slug", folder.alias("folder"), (F.current_timestamp() if run_ts is None else run_ts).alias("createdAt"))
    measured = records.observe(seen, F.count(F.lit(1)).alias("n"), F.min("sortOrder").alias("low"), F.max("sortOrder").alias("high"), F.max(F.unix_micros("published")).alias("newest"))
    staged = store.stage("records", measured)
    got = seen.get
    if not got["n"] and some:
        return store.commit(since, batch=batch_id)
    parts = [staged, store.stage("hashes", staged.rows.select("hash")), store.stage("slugs", staged.rows.select("slug"))]
    known_so_far = {"records": numbers.get("records", 0) + got["n"]}
    if got["n"]:
        known_so_far |= {"min_order": min(got["low"], numbers.get("min_order", got["low"])), "max_order": max(got["high"], numbers.get("max_order", got["high"]))}
    newest = [x for x in (got["newest"], numbers.get("newest")) if x is not None]
    if newest:
        known_so_far["newest"] = max(newest)
    return store.commit(since, appended=parts, numbers=known_so_far, batch=batch_id)


def ingest(stream: DataFrame, store: Store, checkpoint: str, run_ts: Column | None = None) -> StreamingQuery:
    """``ingest_batch`` on what has landed since the checkpoint."""
    return stream.writeStream.foreachBatch(lambda batch, batch_id: ingest_batch(batch, batch_id, store, run_ts) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def requests_once(stream: DataFrame, key: str, ts: str, in_flight: str) -> DataFrame:
    """The first request of each key while one is in flight (by event time), as far as the watermark goes."""
    return stream.withWatermark(ts, in_flight).dropDuplicatesWithinWatermark([key])


def in_flight(hits: DataFrame, span_s: float) -> DataFrame:
    """T2 on a table: a request passes if none of its key has passed in the ``span_s`` before, which is how long one is in flight."""
    return admission_batch(hits, span_s, 1)


def in_flight_stream(hits: DataFrame, span_s: float, late: str = "0 seconds") -> DataFrame:
    """T2 on a stream, exactly: the time of the request in flight is the state of its key, and goes when no late one can need it.

    Requests older than the watermark are left out of the state and counted (``late_requests``); those without a time are turned away.
    """
    return admission_stream(hits, span_s, 1, span_s, late)


def late_requests(query: StreamingQuery) -> int:
    """How many rows of a stream's runs so far came behind the watermark."""
    return sum(int(operator["numRowsDroppedByWatermark"]) for progress in query.recentProgress for operator in progress["stateOperators"])


def live_keys(spark: SparkSession, checkpoint: str) -> DataFrame:
    """T4: ``hit_key, held``: the keys that an admission stream still has state for, and how many times it holds; the others have been idle for long and are gone."""
    state = spark.read.format("statestore").option("stateVarName", "times").option("flattenCollectionTypes", "true").load(checkpoint)
    return state.select("list_element.hit_key", F.size("list_element.times").cast("long").alias("held"))


def live_keys_batch(hits: DataFrame, idle_s: float) -> DataFrame:
    """T4 on a table: the keys that had a hit in the last ``idle_s``, as of the newest hit of all."""
    last = hits.where("ts is not null").groupBy("hit_key").agg(F.max(F.unix_millis("ts")).alias("last"))
    newest = last.agg(F.max("last").alias("newest"))  # one row
    return last.crossJoin(F.broadcast(newest)).where(F.col("last") + round(idle_s * 1000) > F.col("newest")).select("hit_key")


def admit(kept: list[int], now: int, window: int, most: int) -> tuple[list[int], bool, int, int]:
    """One decision, in microseconds: the hits still inside the window, whether this one passes, what remains, when to retry (seconds).

    A hit that is turned away is not recorded.
    """
    kept = [t for t in kept if t > now - window]
    if len(kept) >= most:
        return kept, False, 0, max(1, -(-(kept[0] + window - now) // SECOND))
    return [*kept, now], True, most - len(kept) - 1, 0


def decide(times: np.ndarray, kept: np.ndarray, window: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``admit`` for ascending times after the hits ``kept``: what passes, what remains, when to retry, and the hits that may still count.

    The next hit that passes is the first one behind the last at which the oldest of the ``most`` latest has left the
    window, so only hits that pass are stepped through, by binary search; those turned away between them are filled in at once.
    """
    passed, at, start = kept.tolist(), [], 0
    while start < len(times):
        if most <= 0:
            break
        if len(passed) >= most:
            start = max(start, int(np.searchsorted(times, passed[-most] + window)))
            if start >= len(times):
                break
        at.append(start)
        passed.append(int(times[start]))
        start += 1
    ok = np.zeros(len(times), bool)
    ok[at] = True
    known = np.array(passed, np.int64)
    before = len(kept) + np.cumsum(ok) - ok  # hits that passed before each
    gone = np.searchsorted(known, times - window, side="right")  # of them no longer in the window
    remaining = np.where(ok, most - (before - gone) - 1, 0)
    oldest = known[np.clip(before - most, 0, max(len(known) - 1, 0))] if len(known) else times
    retry = np.where(ok, 0, np.maximum(1, -(-(oldest + window - times) // SECOND)))
    return ok, remaining, retry, known[max(0, len(known) - max(most, 0)) :]


def admission_batch(hits: DataFrame, window_s: float, most: int) -> DataFrame:
    """T3 on a table: every hit decided in order of time.

    Where a key pauses for longer than the window nothing is left to count, so its hits before and after are decided apart:
    a span of the window's length without a hit is such a pause, and the spans that have hits are found by an
    aggregate. So a busy key is spread over tasks by its pauses, and a task passes over its pieces in order with
    the latest ``most`` times at hand. A key that never pauses is one piece, streamed through one task. Hits without a time are turned away.
    """
    window = round(window_s * SECOND)
    rows = hits.select("hit_key", "event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    dated = rows.where("us is not null").withColumn("span", F.expr(f"(us - pmod(us, {window})) div {window}"))
    # a row for each key and span with hits, however many they are
    key = Window.partitionBy("hit_key").orderBy("span")
    spans = dated.select("hit_key", "span").distinct()
    begins = F.coalesce((F.col("span") - F.lag("span").over(key) > 1).cast("int"), F.lit(0))
    pieces = spans.withColumn("begins", begins).withColumn("piece", F.sum("begins").over(key)).select(F.col("hit_key").alias("own_key"), F.col("span").alias("own_span"), "piece")
    placed = dated.join(pieces, F.col("hit_key").eqNullSafe(F.col("own_key")) & (F.col("span") == F.col("own_span")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, np.zeros(0, np.int64)
        for batch in batches:
            us = batch.column("us").to_numpy(zero_copy_only=False)
            labels = list(zip(batch.column("hit_key").to_pylist(), batch.column("piece").to_pylist(), strict=True))
            cuts = [0, *[i for i in range(1, len(labels)) if labels[i] != labels[i - 1]], len(labels)]
            parts = []
            for low, high in zip(cuts, cuts[1:], strict=False):
                if high > low:
                    if labels[low] != last:
                        last, kept = labels[low], np.zeros(0, np.int64)
                    *found, kept = decide(us[low:high], kept, window, most)
                    parts.append(found)
            if parts:
                ok, remaining, retry = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("hit_key"), batch.column("event_id"), batch.column("ts"), pa.array(ok), pa.array(remaining, pa.int32()), pa.array(retry, pa.int32())], ["hit_key", "event_id", "ts", "ok", "remaining", "retry_after"])

    ordered = placed.select("hit_key", "event_id", F.col("ts").cast("timestamp").alias("ts"), "us", "piece").repartition("hit_key", "piece").sortWithinPartitions("hit_key", "piece", "us", "event_id")
    undated = rows.where("us is null").select("hit_key", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.lit(False).alias("ok"), F.lit(0).alias("remaining"), F.lit(0).alias("retry_after"))
    return ordered.mapInArrow(run, DECISION).unionByName(undated)


#: State is kept for so many groups of keys; a checkpoint belongs to this number.
KEY_GROUPS = 1024
#: Up to so many hits of a key are decided one by one, which is quicker for few.
FEW = 48


def decide_few(times: list[int], kept: list[int], window: int, most: int) -> tuple[list[tuple[bool, int, int]], list[int]]:
    """``decide`` for few hits, one by one."""
    out = []
    for now in times:
        _, *decision = admit(kept, now, window, most)
        out.append(tuple(decision))
        if decision[0]:
            kept = [*kept, now][-most:]
    return out, kept


class _Admission(StatefulProcessor):
    """T3 and T4 for a group of keys: a row of state for each key with the hits admitted last, and the time of its last hit, after which it expires.

    A call from Spark and each look at the state take some milliseconds, so there is one for a group and batch, not for a key. The group's
    timer stands where its first key expires.
    """

    def __init__(self, window: int, most: int, idle_ms: int):
        self.window, self.most, self.idle_ms = window, most, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "hit_key string, last long, times array<long>")

    def stored(self) -> dict[str | None, tuple[int, list[int]]]:
        return {name: (last, list(times)) for name, last, times in self.times.get()}

    def first_expiry(self, keys: dict) -> int | None:
        """A timer fires once the watermark is beyond it; a key goes when the watermark is where it expires."""
        return min(last for last, _ in keys.values()) + self.idle_ms - 1 if keys else None

    def store(self, keys: dict) -> None:
        if keys:
            self.times.put([(name, last, times) for name, (last, times) in keys.items()])
        else:
            self.times.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        frame = pd.concat(list(rows))
        frame["code"], names = pd.factorize(frame["hit_key"], use_na_sentinel=False)
        frame = frame.sort_values(["code", "us", "event_id"], na_position="last")
        dated = frame["us"].notna().to_numpy()
        codes, times = frame["code"].to_numpy()[dated], frame["us"][dated].to_numpy().astype(np.int64)
        keys = self.stored()
        timer = self.first_expiry(keys)
        ok, remaining, retry = np.zeros(len(frame), bool), np.zeros(len(frame), np.int32), np.zeros(len(frame), np.int32)
        places = np.flatnonzero(dated)
        cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if high == low:
                continue
            name = names[codes[low]]
            name = None if pd.isna(name) else name
            last, kept = keys.get(name, (None, []))
            at = places[low:high]
            if high - low <= FEW and self.most > 0:
                found, kept = decide_few(times[low:high].tolist(), kept, self.window, self.most)
                ok[at], remaining[at], retry[at] = zip(*found, strict=True)
            else:
                ok[at], remaining[at], retry[at], kept = decide(times[low:high], np.array(kept, np.int64), self.window, self.most)
                kept = kept.tolist()
            newest = int(times[high - 1]) // 1000
            if kept:
                keys[name] = (newest if last is None else max(last, newest), kept)
        self.store(keys)
        self.set_timer(timer, self.first_expiry(keys))
        yield pd.DataFrame({"hit_key": frame["hit_key"], "event_id": frame["event_id"], "ts": frame["ts"], "ok": ok, "remaining": remaining, "retry_after": retry})

    def set_timer(self, old: int | None, new: int | None) -> None:
        if old != new:
            if old is not None:
                self.handle.deleteTimer(old)
            if new is not None:
                self.handle.registerTimer(new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        now = timerValues.getCurrentWatermarkInMs()
        keys = {name: (last, times) for name, (last, times) in self.stored().items() if last + self.idle_ms > now}
        self.store(keys)
        self.set_timer(None, self.first_expiry(keys))  # the old one goes as it has fired
        return iter([])

    def close(self) -> None:
        pass


def admission_stream(hits: DataFrame, window_s: float, most: int, idle_s: float, late: str = "0 seconds") -> DataFrame:
    """T3 on a stream of ``hit_key, event_id, ts``, with state in RocksDB; the rows of a key come ordered inside a micro-batch."""
    source = hits.select("hit_key", "event_id", "ts").withWatermark("ts", late)
    grouped = source.withColumns({"us": F.unix_micros("ts"), "key_group": F.pmod(F.xxhash64("hit_key"), F.lit(KEY_GROUPS))})
    return grouped.groupBy("key_group").transformWithStateInPandas(
        statefulProcessor=_Admission(round(window_s * SECOND), most, int(max(idle_s, window_s) * 1000)),
        outputStructType=DECISION,
        outputMode="append",
        timeMode="EventTime",
    )


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
