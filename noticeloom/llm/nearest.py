"""Operator 3: nearest vectors by collision counting over single projections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticeloom.llm.common import table

#: Projections, the width of a window at radius 1, and the share of projections in which a vector must
#: collide with a query: one as far as the radius collides in 89 of 100, with 84.7 asked for.
PROJECTIONS, WIDTH, THRESHOLD = 160, 3.2, 0.847
#: Shares of a block that the first two windows hold on average: one for near copies, and the widest in
#: which a vector of average distance does not yet pass the threshold.
NEAR_SHARE, WIDE_SHARE = 0.05, 0.75
#: Radii that are tried, and the one from which a window holds everything: the unit sphere is 2 across.
RADII, LAST_RADIUS = 0.02 * 1.3 ** np.arange(18), 2.1
#: Bytes of an indexed block, and queries that one task answers on it.
BLOCK_BYTES, CHUNK = 64 << 20, 65_536
#: Queries handled at once, and projections whose windows are counted at once, so that counts stay in cache.
SLICE, GROUP = 64, 16
#: Distance between the projections in the one array that is searched; no projection is that far out.
APART = 64.0


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, v, dim`` of finite non-zero vectors, in the type they have."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")).where("vec_id is not null and v is not null")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~bad & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def matrix(column: pa.Array) -> np.ndarray:
    values = column.values if isinstance(column, pa.ListArray | pa.LargeListArray) else column.flatten()
    if isinstance(column, pa.ListArray | pa.LargeListArray) and len(column):
        values = values[column.offsets[0].as_py() : column.offsets[-1].as_py()]
    return values.to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


def projections(dim: int, m: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, m))


def products(base: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component to the last."""
    total = np.zeros(len(base))
    for d in range(base.shape[1]):
        total += base[:, d] * query[d]
    return total


class Block:
    """Sorted projections of a block of vectors, lifted to the unit sphere.

    With the largest norm M of the block, ``(x / M, sqrt(1 - |x|^2 / M^2))`` has length 1, and the
    smaller its distance from the unit query ``(q / |q|, 0)``, the larger the inner product.
    ``verified`` counts the vectors whose product was taken, over all queries.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, m: int = PROJECTIONS):
        n, dim = vectors.shape
        self.ids, self.vectors, self.m = ids, vectors, m
        square = (vectors * vectors).sum(axis=1)
        self.largest = float(np.sqrt(square.max()))
        self.way = projections(dim + 1, m)
        rest = np.sqrt(np.maximum(0, 1 - square / self.largest**2))
        self.order = np.empty((m, n), np.int32)
        self.flat = np.empty(m * n)  # the sorted projections one after another, each moved past the last
        self.begin, self.shift = np.arange(m) * n, np.arange(m) * APART
        for j in range(m):
            hashes = vectors @ (self.way[:-1, j] / self.largest) + rest * self.way[-1, j]
            self.order[j] = np.argsort(hashes)
            self.flat[j * n : (j + 1) * n] = np.clip(hashes[self.order[j]], -APART / 2.5, APART / 2.5) + self.shift[j]
        self.verified = 0

    def search(self, own: np.ndarray, queries: np.ndarray, k: int) -> Iterator[list[tuple[int, float]]]:
        """Per query the k vectors of the largest products found, ties to smaller ids, without its own id.

        Windows around the query's projections grow by virtual rehashing: from the radius at which
        they hold few vectors to the one at which they hold as many as tell near from far, then to
        the distance of the k-th vector found, which none of the best k is beyond. A vector is
        verified once it has collided often enough; at the last radius windows hold everything.
        """
        norms = np.sqrt((queries * queries).sum(axis=1))
        at = np.clip((queries / norms[:, None]) @ self.way[:-1], -APART / 2.5, APART / 2.5) + self.shift
        some = np.arange(0, self.m, -(-self.m // GROUP))
        half = RADII[:, None] * WIDTH / 2
        for i, query in enumerate(queries):
            held = np.searchsorted(self.flat, at[i, some] + half, "right") - np.searchsorted(self.flat, at[i, some] - half)
            first = np.interp([NEAR_SHARE, WIDE_SHARE], held.mean(axis=1) / len(self.ids), RADII).tolist()
            yield self._one(own[i], query, norms[i], at[i], first, k)

    def _windows(self, at: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Per projection the places between which a window lies in its sorted array."""
        half, n = radius * WIDTH / 2, len(self.ids)
        low = np.searchsorted(self.flat, at - half) - self.begin
        high = np.searchsorted(self.flat, at + half, "right") - self.begin
        return np.clip(low, 0, n), np.clip(high, 0, n)

    def _counted(self, runs: list[tuple[int, int, int]]) -> np.ndarray:
        """How often each vector is in the given runs (projection, from, to) of the sorted arrays."""
        count = np.zeros(len(self.ids), np.int64)
        for i in range(0, len(runs), GROUP):
            count += np.bincount(np.concatenate([self.order[j, a:b] for j, a, b in runs[i : i + GROUP]]), minlength=len(count))
        return count

    def _one(self, own: int, query: np.ndarray, norm: float, at: np.ndarray, first: list[float], k: int) -> list[tuple[int, float]]:
        n, m = len(self.ids), self.m
        need = THRESHOLD * m
        count, seen = np.zeros(n, np.int64), np.zeros(n, bool)
        rows, scores = np.zeros(0, np.int64), np.zeros(0)
        low = high = np.zeros(m, np.int64)
        radius, kth = 0.0, np.inf  # kth: distance of the k-th vector found
        while radius < min(kth, LAST_RADIUS):
            wider = first.pop(0) if first else radius * 1.1 if kth == np.inf else kth
            radius = min(wider, kth)
            if radius < LAST_RADIUS:
                left, right = self._windows(at, radius)
                inside, held = int((right - left).sum()), int((high - low).sum())
                if n * m - inside < inside - held:  # fewer lie outside the new windows than between the old and the new
                    count = m - self._counted([x for j in range(m) for x in ((j, 0, left[j]), (j, right[j], n))])
                elif held:
                    count += self._counted([x for j in range(m) for x in ((j, left[j], low[j]), (j, high[j], right[j]))])
                else:
                    count = self._counted([(j, left[j], right[j]) for j in range(m)])
                low, high = left, right
                found = np.flatnonzero((count >= need) & ~seen)
            else:
                found = np.flatnonzero(~seen)
            self.verified += len(found)
            seen[found] = True
            found = found[self.ids[found] != own]
            rows, scores = np.r_[rows, found], np.r_[scores, self.vectors[found] @ query]
            if len(rows) >= k:
                best = np.partition(scores, -k)[-k]
                kth = np.sqrt(max(0.0, 2 - 2 * best / (norm * self.largest)))
                # whatever may be among the best once its product is summed exactly
                part = np.flatnonzero(scores >= best - 1e-9 * norm * self.largest)
                rows, scores = rows[part], scores[part]
        scores = products(self.vectors[rows], query)
        top = np.lexsort((self.ids[rows], -scores))[:k]
        return list(zip(self.ids[rows[top]].tolist(), scores[top].tolist(), strict=True))


def answered(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Answers of each seat: its vectors come first and are indexed, then its queries pass by in batches."""
    seat, parts, index = None, [], None
    for batch in batches:
        seats, asks = batch.column("seat").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((seats[1:] != seats[:-1]) | (asks[1:] != asks[:-1])) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(seats)], strict=True):
            if seats[a] != seat:
                seat, parts, index = seats[a], [], None
            ids, own = batch.column("vec_id")[a:b].to_numpy(), matrix(batch.column("v")[a:b])
            if not asks[a]:
                parts.append((ids, own))
                continue
            if index is None and parts:
                index, parts = Block(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])), []
            for at in range(0, len(ids) if index else 0, SLICE):
                out: list[tuple[int, int, float]] = []
                for q, got in zip(ids[at : at + SLICE].tolist(), index.search(ids[at : at + SLICE], own[at : at + SLICE], k), strict=True):
                    out += [(q, i, s) for i, s in got]
                columns = zip(*out, strict=True) if out else ([], [], [])
                kinds = (pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["query_id", "vec_id", "score"])


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    block: int | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: per query the k vectors found with the largest inner product.

    Every vector is indexed, in blocks of ``BLOCK_BYTES`` (or ``block`` vectors); a block is built once
    and answers the queries, which pass by in batches, with its own k best; the best of those are
    ranked. Vectors go round the blocks, so that neither a frequent id nor copies fill one. Only beyond
    ``chunk`` queries is a block built again, once for each chunk, to keep tasks short.

    Vectors or queries that are null, zero or not finite take no part; those of another length
    are searched among their like. A query never finds its own id; of several queries with one id
    the smallest vector asks. Ties go to smaller ids; a repeated row is found as often as it is
    there. Fewer than k candidates are all found; empty tables give no rows, and other columns
    play no part.
    """
    base = usable(vectors, id_col, vec_col)
    asked = usable(queries, id_col, vec_col).groupBy("dim", "vec_id").agg(F.min("v").alias("v"))
    sizes = {r["dim"]: r["n"] for r in base.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    asking = {r["dim"]: r["n"] for r in asked.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    blocks, chunks, first, seats = {}, {}, {}, 0
    for dim in sorted(set(sizes) & set(asking)):
        blocks[dim] = -(-sizes[dim] // (block or max(1, BLOCK_BYTES // (8 * dim + 12 * PROJECTIONS))))
        chunks[dim] = -(-asking[dim] // chunk)
        first[dim] = seats
        seats += blocks[dim] * chunks[dim]
    of = lambda d: F.element_at(F.create_map(*[F.lit(x) for kv in (d or {0: 0}).items() for x in kv]), F.col("dim"))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    met = F.col("dim").isin(*first)

    def seated(rows: DataFrame, asks: bool) -> DataFrame:
        place: Column = of(first) + F.col("block") * of(chunks) + F.col("chunk")
        return rows.select(place.cast("int").alias("seat"), F.lit(asks).alias("asks"), "vec_id", "v")

    turn = F.monotonically_increasing_id()
    there = base.where(met).withColumn("block", F.pmod(turn, of(blocks))).withColumn("chunk", every(of(chunks)))
    here = asked.where(met).withColumn("chunk", F.pmod(F.xxhash64("vec_id"), of(chunks))).withColumn("block", every(of(blocks)))
    dealt = seated(there, False).unionByName(seated(here, True)).repartitionById(max(1, seats), F.col("seat"))
    found = dealt.sortWithinPartitions("seat", "asks").mapInArrow(lambda batches: answered(batches, k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
