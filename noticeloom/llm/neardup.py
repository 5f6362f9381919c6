"""Operator 8: near-duplicate documents by bottom-k sketches of word shingles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.llm.common import cut, join_small, sliced, table
from noticeloom.llm.components import connected_components
from noticeloom.llm.shingles import array_sets, digests, list_array, shingle_sets

#: Values kept of each document, the smallest of one hash function.
SKETCH = 96
#: Sketches are asked for this much less overlap than the threshold, and a pair whose union sketch estimates
#: its similarity this much below the threshold is still verified. A pair just at a threshold of 0.8 falls
#: short of either with odds of about 1 in 50 million (binomial tails at 96 values).
SLACK = MARGIN = 0.26
#: Most documents and shingles that one block of an inverted list holds.
BLOCK_DOCS, BLOCK_SHINGLES = 800, 400_000
#: Lists of a document that are compared first, and members of a long list that meet all its chunks, about.
FIRST_LISTS, PIVOTS = 4, 8


def _overlap(n: int, share: float) -> int:
    return max(1, math.ceil(round(n * share, 9)))


def sketch_documents(docs: DataFrame, k: int = SKETCH) -> DataFrame:
    """``doc_id, n_shingles, d1, d2, sketch``: set size, set digest and the k smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            n, d1, d2, low = [], [], [], []
            for own in shingle_sets(part.column("text")):
                a, b = digests(own)
                n.append(len(own))
                d1.append(a)
                d2.append(b)
                low.append(own[:k].copy())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), list_array(low)], ["doc_id", "n_shingles", "d1", "d2", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, sketch array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """``doc_id, d1, d2, shingles``: every distinct shingle of every document, and the set's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            sets = list(shingle_sets(part.column("text")))
            both = [digests(own) for own in sets]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([d for d, _ in both], pa.int64()), pa.array([d for _, d in both], pa.int64()), list_array(sets)], ["doc_id", "d1", "d2", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, d1 long, d2 long, shingles array<long>")


def false_members(rows: DataFrame, member: DataFrame, chunk_docs: int = BLOCK_DOCS) -> DataFrame:
    """Of ``doc_id, d1, d2, n_shingles, rep`` the rows whose full set is not that of the class's ``rep``, in spite of their digests.

    Members pass by their representative in chunks, so that a class may hold any share of the
    documents; its set is copied once a chunk.
    """
    sizes = member.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select("rep", F.ceil(F.col("n") / chunk_docs).cast("int").alias("chunks"))
    own = member.join(sizes, "rep")
    some = own.where("doc_id <> rep").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int"))
    lead = own.where("doc_id = rep").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    seats = cut(some.unionByName(lead).select("rep", "chunk", "doc_id", "d1", "d2"))
    sets = full_sets(join_small(rows, seats.select("doc_id").distinct(), "doc_id"))
    met = sets.join(seats, ["doc_id", "d1", "d2"]).select("rep", "chunk", (F.col("doc_id") != F.col("rep")).alias("later"), "doc_id", "d1", "d2", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first = None, None
        for batch in sliced(batches):
            out = []
            keys = zip(*(batch.column(c).to_pylist() for c in ("rep", "chunk")), strict=True)
            for i, (key, shingles) in enumerate(zip(keys, array_sets(batch.column("shingles")), strict=True)):
                if key != now:
                    now, first = key, shingles.copy()
                elif not np.array_equal(first, shingles):
                    out.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(out, pa.int64())) for c in ("doc_id", "d1", "d2")], ["doc_id", "d1", "d2"])

    order = ["rep", "chunk"]
    return met.repartition(*order).sortWithinPartitions(*order, "later").mapInArrow(run, "doc_id long, d1 long, d2 long").distinct()


def rare_values(reps: DataFrame, threshold: float) -> DataFrame:
    """``value, doc_id, n_shingles``: the inverted lists that two similar documents must share.

    Similar sketches share at least a share of ``threshold - SLACK`` of their values, so two
    such documents share one of the rarest values of each, however frequent the others are:
    passages that many documents have in common end up outside. Values that only one document
    has count as the rarest and need no list.
    """
    values = reps.select("doc_id", "n_shingles", F.size("sketch").alias("kept"), F.explode("sketch").alias("value"))
    common = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    held = values.join(common, "value").groupBy("doc_id", "n_shingles", "kept").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("shared"))
    need = F.greatest(F.lit(1), F.ceil(F.round(F.col("kept") * F.lit(threshold - SLACK), 9)))
    take = F.col("kept") - need + 1 - (F.col("kept") - F.size("shared"))
    return (
        held.withColumn("take", take.cast("int"))
        .where("take > 0")
        .select("doc_id", "n_shingles", F.explode(F.slice("shared", F.lit(1), F.col("take"))).alias("x"))
        .select(F.col("x.value").alias("value"), "doc_id", "n_shingles")
    )


def joined_lists(lists: DataFrame) -> DataFrame:
    """``value, doc_id, n_shingles`` with lists of nearly the same members made one, their union.

    Lists are joined if two MinHashes of their members agree, as those of a group of near copies mostly do: its
    documents share dozens of values and would meet again in the list of each. Lists with little in common
    agree in both hardly ever, and equal ones always. A list with one member has nobody to meet.
    """
    least = [F.min(F.xxhash64(F.lit(key), F.col("doc_id"))).alias(key) for key in ("one", "two")]
    each = lists.groupBy("value").agg(F.count("*").alias("n"), *least).where("n > 1")
    heads = each.groupBy("one", "two").agg(F.min("value").alias("head"))
    named = cut(each.select("value", "one", "two").join(heads, ["one", "two"]).select("value", "head"))
    return lists.join(named, "value").select(F.col("head").alias("value"), "doc_id", "n_shingles").distinct()


def list_sizes(lists: DataFrame, block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """``value, n, chunks`` of the lists that are compared."""
    sizes = lists.groupBy("value").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight")).where("n > 1")
    return sizes.select("value", "n", _chunks(F.col("n"), F.col("weight"), block_docs, block_shingles).alias("chunks"))


def _chunks(n: Column, weight: Column, block_docs: int, block_shingles: int) -> Column:
    return F.greatest(F.ceil(n / block_docs), F.ceil(weight / block_shingles)).cast("int")


def own_blocks(held: DataFrame) -> DataFrame:
    """Seats ``doc_id, value, low, high, in_low``: ``value, doc_id, chunks`` dealt into chunks by hash, each compared within itself."""
    chunk = F.pmod(F.xxhash64("doc_id"), F.col("chunks").cast("long")).cast("int")
    return held.select("doc_id", "value", chunk.alias("low")).select("doc_id", "value", "low", F.col("low").alias("high"), F.lit(True).alias("in_low"))


def longest_lists(held: DataFrame, lists: int = FIRST_LISTS) -> DataFrame:
    """Of ``doc_id, value, n, chunks`` up to ``lists`` rows a document: the longest list of each share of the values.

    Near copies agree on the longest lists, so that all meet in a few blocks, not in one for each value they share.
    """
    share = F.pmod(F.xxhash64("value"), F.lit(lists))
    best = [F.max(F.when(share == i, F.struct("n", "value", "chunks"))).alias(f"x{i}") for i in range(lists)]
    every = held.groupBy("doc_id").agg(*best).select("doc_id", F.explode(F.array(*[f"x{i}" for i in range(lists)])).alias("x"))
    return every.where("x is not null").select("doc_id", "x.*")


def pivot_blocks(held: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """The seats of ``own_blocks``, and of about ``pivots`` members of a long list, chosen by hash, one in each of its chunks."""
    some = held.where((F.col("chunks") > 1) & (F.pmod(F.xxhash64(F.lit("pivot"), F.col("doc_id")), F.col("n")) < pivots))
    some = some.select("doc_id", "value", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("low"))
    return own_blocks(held).unionByName(some.select("doc_id", "value", "low", F.col("low").alias("high"), F.lit(True).alias("in_low")))


def cross_blocks(held: DataFrame, block_docs: int, block_shingles: int) -> DataFrame:
    """Seats in which every two documents of a list with different labels meet.

    The documents of the list's largest label are not compared with each other, they are connected
    already: chunks of the others are compared with all chunks, so that a list whose documents are
    alike costs a copy of each, not one for every chunk.
    """
    parts = held.groupBy("value", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight"))
    top = parts.groupBy("value").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"), F.sum("weight").alias("weight"), F.count("*").alias("labels")).where("labels > 1")
    main = parts.join(top.select("value", F.col("top.label").alias("label")), ["value", "label"]).select("value", F.col("label").alias("main"), F.col("n").alias("main_n"), F.col("weight").alias("main_weight"))
    sizes = top.join(main, "value").select("value", "main", _chunks(F.col("main_n"), F.col("main_weight"), block_docs, block_shingles).alias("mains"), _chunks(F.col("n") - F.col("main_n"), F.col("weight") - F.col("main_weight"), block_docs, block_shingles).alias("others"))
    rows = held.join(sizes, "value").withColumn("is_main", F.col("label") == F.col("main"))
    # chunks of the others are numbered from 0, those of the main label from there on
    chunk = F.when(F.col("is_main"), F.col("others") + F.pmod(F.xxhash64("doc_id"), F.col("mains").cast("long"))).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("others").cast("long"))).cast("int")
    last = F.when(F.col("is_main"), F.col("others")).otherwise(F.col("others") + F.col("mains"))
    seats = rows.withColumn("chunk", chunk).select("doc_id", "value", "chunk", F.explode(F.sequence(F.lit(0), last - 1)).alias("other"))
    return seats.select("doc_id", "value", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), (F.col("chunk") == F.least("chunk", "other")).alias("in_low"))


class _Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def roots(self) -> np.ndarray:
        """Of all members, by following every pointer at once until nothing moves."""
        while True:
            step = self.up[self.up]
            if (step == self.up).all():
                return step
            self.up = step


def _union_estimate(low: np.ndarray, size: np.ndarray, i: int, others: np.ndarray, k: int) -> np.ndarray:
    """Similarity estimated from the k smallest values of the union of two sketches."""
    top = np.iinfo(np.uint64).max
    both = np.concatenate([np.broadcast_to(low[i], (len(others), low.shape[1])), low[others]], axis=1)
    both.sort(axis=1)
    real = both != top
    again = np.zeros(both.shape, bool)
    again[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
    rank = np.cumsum(real & ~again, axis=1)
    limit = np.minimum(rank[:, -1], k)[:, None]
    complete = (size[i] <= k) & (size[others] <= k)
    limit[complete] = rank[complete, -1:]
    return (again & (rank <= limit)).sum(axis=1) / np.maximum(limit[:, 0], 1)


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int, k: int) -> bool:
    """What ``link_block`` says of a pair: sketches overlap, their union's estimate is near, the full sets are alike."""
    if len(a) > len(b):
        a, b = b, a
    threshold, both = num / den, np.sort(np.concatenate([a[:k], b[:k]]))
    again = both[1:] == both[:-1]
    if again.sum() < max(1, math.ceil(min(k, len(b)) * (threshold - SLACK) - 1e-9)) or len(a) * den < len(b) * num:
        return False
    rank = np.cumsum(np.r_[True, ~again])
    limit = rank[-1] if len(b) <= k else min(k, rank[-1])
    if (again & (rank[1:] <= limit)).sum() / limit < threshold - MARGIN:
        return False
    same = len(np.intersect1d(a, b, assume_unique=True))
    return den * same >= num * (len(a) + len(b) - same)


def link_block(sets: list[np.ndarray], num: int, den: int, k: int, cross: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (index pairs) that connect what the block's true links connect, each verified exactly.

    Overlaps of retained values come from inverted lists, the union sketch rules out most, and
    the exact intersection of the full sets decides. Pairs already connected are skipped, so at
    most one link fewer than documents comes out. ``cross`` marks a side: only pairs across count.
    """
    m = len(sets)
    if m == 2:  # by far the most frequent block
        return [(0, 1)] if linked(sets[0], sets[1], num, den, k) else []
    size = np.fromiter(map(len, sets), np.int64, m)
    threshold = num / den
    low = np.full((m, k), np.iinfo(np.uint64).max, np.uint64)
    for i, s in enumerate(sets):
        low[i, : min(k, len(s))] = s[:k]
    kept = np.minimum(size, k)
    flat = np.concatenate([low[i, : kept[i]] for i in range(m)])
    owner = np.repeat(np.arange(m), kept)
    code = np.unique(flat, return_inverse=True)[1]
    by_code = np.argsort(code, kind="stable")
    posting, first = owner[by_code], np.searchsorted(code[by_code], np.arange(code.max() + 2))
    code_at = np.r_[0, np.cumsum(kept)]

    words = np.unique(np.concatenate(sets), return_inverse=True)[1]
    at = np.r_[0, np.cumsum(size)]
    mark = np.zeros(words.max() + 1, bool)
    forest, links = _Forest(m), []
    for i in range(m - 1):
        codes = code[code_at[i] : code_at[i + 1]]
        shared = np.bincount(np.concatenate([posting[first[c] : first[c + 1]] for c in codes]), minlength=m)
        need = np.ceil(np.maximum(kept[i], kept) * (threshold - SLACK) - 1e-9)
        small, large = np.minimum(size[i], size), np.maximum(size[i], size)
        ok = (shared >= np.maximum(need, 1)) & (small * den >= large * num)
        ok[: i + 1] = False
        if cross is not None:
            ok &= cross != cross[i]
        others = np.flatnonzero(ok)
        if len(others):
            roots = forest.roots()
            others = others[roots[others] != roots[i]]
        if len(others):
            others = others[_union_estimate(low, size, i, others, k) >= threshold - MARGIN]
        if not len(others):
            continue
        mark[words[at[i] : at[i + 1]]] = True
        if size[others].sum() * 2 > at[-1]:
            hits = np.add.reduceat(mark[words], at[:-1])[others]
        else:
            own = np.concatenate([words[at[j] : at[j + 1]] for j in others])
            hits = np.add.reduceat(mark[own], np.r_[0, np.cumsum(size[others])[:-1]])
        mark[words[at[i] : at[i + 1]]] = False
        for j in others[den * hits >= num * (size[i] + size[others] - hits)].tolist():
            a, b = forest.root(i), forest.root(j)
            if a != b:
                forest.up[max(a, b)] = min(a, b)
                links.append((i, j))
    return links


def block_links(rows: DataFrame, num: int, den: int, k: int) -> DataFrame:
    """``src, dst`` of verified links, from ``block, in_low, doc_id, shingles`` sorted by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        sides: list[bool] = []
        sets: list[np.ndarray] = []
        now: tuple | None = None
        out: list[tuple[int, int]] = []

        def close() -> None:
            if len(sets) > 1:
                cross = np.array(sides) if now and now[1] != now[2] else None
                out.extend((ids[i], ids[j]) for i, j in link_block(sets, num, den, k, cross))

        for batch in sliced(batches):
            keys = zip(*(batch.column(c).to_pylist() for c in ("value", "low", "high")), strict=True)
            own = zip(keys, batch.column("doc_id").to_pylist(), batch.column("in_low").to_pylist(), array_sets(batch.column("shingles")), strict=True)
            for key, doc, side, shingles in own:
                if key != now:
                    close()
                    ids, sides, sets, now = [], [], [], key
                ids.append(doc)
                sides.append(side)
                sets.append(shingles.copy())
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["src", "dst"])
            out = []
        close()
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["src", "dst"])

    return rows.mapInArrow(run, "src long, dst long")


def placed_links(rows: DataFrame, seats: DataFrame, num: int, den: int, k: int) -> DataFrame:
    """``src, dst`` of verified links among documents that share a seat."""
    seats = cut(seats.distinct())
    sets = full_sets(join_small(rows, cut(seats.select("doc_id").distinct()), "doc_id")).select("doc_id", "shingles")
    order = ["value", "low", "high"]
    placed = sets.join(seats, "doc_id").select(*order, "in_low", "doc_id", "shingles")
    return cut(block_links(placed.repartition(*order).sortWithinPartitions(*order), num, den, k))


def verified_links(rows: DataFrame, lists: DataFrame, num: int, den: int, k: int, block_docs: int, block_shingles: int) -> DataFrame:
    """Links that connect what all links among documents of one list connect.

    First every document is compared in a few of its lists, long ones in chunks that pivots join. A list
    whose documents are all connected by then needs no more; the others are compared whole in one block,
    or, if longer, across the components found. Nothing is left out: what is not compared is connected.
    """
    lists = cut(joined_lists(lists))
    sizes = cut(list_sizes(lists, block_docs, block_shingles))
    held = cut(lists.join(sizes, "value"))
    first = cut(longest_lists(held))
    links = placed_links(rows, pivot_blocks(first), num, den, k)
    met = first.groupBy("value").agg(F.count("*").alias("met"))
    rest = held.join(met, "value", "left").where("chunks > 1 or met is null or met < n").drop("met")
    labels = connected_components(links).select(F.col("node").alias("doc_id"), F.col("component").alias("label"))
    rest = cut(rest.join(labels, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id")))
    mixed = rest.groupBy("value").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("value")
    rest = cut(rest.join(mixed, "value"))
    if rest.isEmpty():
        return links
    seats = own_blocks(rest.where("chunks = 1")).unionByName(cross_blocks(rest.where("chunks > 1"), block_docs, block_shingles))
    return links.unionByName(placed_links(rows, seats, num, den, k))


def near_duplicates(
    docs: DataFrame,
    num: int = 4,
    den: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = SKETCH,
    block_docs: int = BLOCK_DOCS,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Documents are linked if the Jaccard similarity of their five-word shingle sets is at least
    ``num/den``; ``component_id`` is the smallest id that links reach. Documents of one set size and
    digest form a class once their full sets have been compared, of which one member goes on; only
    classes that share a rare sketch value are compared, inside blocks of bounded size, on their full
    sets. Documents without words are linked with nothing; rows with a null id keep a null component
    and are kept; repeated rows of one id share its component. An empty table gives no rows, and other
    columns play no part.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketches = cut(sketch_documents(rows, k))
    named = sketches.where("n_shingles > 0 and doc_id is not null")
    key = ["d1", "d2", "n_shingles"]
    classes = cut(named.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.min_by("sketch", "doc_id").alias("sketch")))
    member = cut(named.select("doc_id", *key).distinct().join(classes.select(*key, "rep"), key))
    false = cut(false_members(rows, member, block_docs))
    if not false.isEmpty():  # two sets of one digest: each such document is a class of its own
        apart = member.join(false, ["doc_id", "d1", "d2"], "left_semi").withColumn("rep", F.col("doc_id"))
        classes = classes.unionByName(named.join(false, ["doc_id", "d1", "d2"], "left_semi").select(*key, F.col("doc_id").alias("rep"), "sketch").dropDuplicates(["rep", *key]))
        member = cut(member.join(false, ["doc_id", "d1", "d2"], "left_anti").unionByName(apart))
    # the smallest id of a class stands for it; sets of one shingle are only like their equals
    reps = classes.where("n_shingles > 1").select(F.col("rep").alias("doc_id"), "n_shingles", "sketch")
    lists = cut(rare_values(reps, num / den))
    links = verified_links(rows, lists, num, den, k, block_docs, block_shingles)
    member = member.select("doc_id", "rep").distinct()
    # ids of one class, and of the rows that share an id, belong together
    own = member.where("doc_id <> rep").select(F.col("doc_id").alias("src"), F.col("rep").alias("dst"))
    repeated = member.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if not repeated.isEmpty():
        links = links.unionByName(join_small(own, repeated.withColumnRenamed("doc_id", "src"), "src", "left_semi"))
    labels = connected_components(links)
    root = join_small(member, labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
    root = root.select("doc_id", F.coalesce("component", "rep").alias("root")).groupBy("doc_id").agg(F.min("root").alias("root"))
    return (
        sketches.select("doc_id", "n_shingles")
        .join(root, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), num=85, den=100)
