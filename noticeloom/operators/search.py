"""Ranked search of whole texts for a table of queries (Q10)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeloom.session import written

#: Queries weighed at once, and cells of the matrices that a task holds for them.
BLOCK_QUERIES, CELLS = 256, 4_000_000
#: Words of queries that are handled in one pass over the texts; more queries take further passes.
PASS_WORDS = 1_000_000


def words_of(text: Column) -> Column:
    """The lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def forward_index(docs: DataFrame, terms: list[str], key: str, text: str) -> DataFrame:
    """``doc, len, terms, tfs``: each document's length, and which of the asked terms it has how often, as numbers; no row leaves its task."""
    asked = pa.array(terms, pa.string())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                lists = part.column("words")
                sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                found = pc.fill_null(pc.index_in(lists.flatten(), value_set=asked), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                of = np.repeat(np.arange(len(sizes)), sizes)[found >= 0]
                pairs, counts = np.unique(of * max(len(terms), 1) + found[found >= 0], return_counts=True)
                ends = np.searchsorted(pairs, np.arange(len(sizes) + 1) * max(len(terms), 1)).astype(np.int32)
                as_lists = lambda values: pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int32()))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(sizes, pa.int32()), as_lists(pairs % max(len(terms), 1)), as_lists(counts)], ["doc", "len", "terms", "tfs"])
            pa.default_memory_pool().release_unused()

    own = docs.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("doc"), words_of(F.col(text)).alias("words"))
    return own.mapInArrow(encode, f"doc {own.schema['doc'].dataType.simpleString()}, len int, terms array<int>, tfs array<int>")


class Best:
    """The k best documents of each query so far; ties go to the smaller key."""

    def __init__(self, queries: int, k: int):
        self.k, self.held = k, [[] for _ in range(queries)]
        self.least = np.full(queries, -np.inf)

    def add(self, query: int, found: list[tuple[float, object]]) -> None:
        best = sorted(self.held[query] + found, key=lambda x: (-round(x[0], 6), x[1]))[: self.k]
        self.held[query] = best
        if len(best) == self.k:
            self.least[query] = best[-1][0] - 2e-6  # what may still tie after rounding


def _best_of_tasks(index: DataFrame, ids: list, weights: np.ndarray, idf: np.ndarray, avg_len: float, k: int, k1: float, b: float, kind: str) -> DataFrame:
    """The best documents of each query in each task: ``query_id, doc, score``.

    Documents come in blocks. The highest weights of a block bound what any of its documents can score; queries whose k-th
    best so far lies above the bound skip the block, the others are scored exactly, all at once.
    """
    used = np.flatnonzero(weights.any(axis=1))  # terms that these queries ask for
    place = np.full(len(idf) + 1, -1)
    place[used] = np.arange(len(used))
    asked = weights[used]
    rows = max(16, min(1024, CELLS // max(len(used), 1)))
    doc_type = index.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(ids), k)
        empty = None
        for batch in batches:
            empty = batch.column("doc").slice(0, 0)
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                n = part.num_rows
                sizes = pc.list_value_length(part.column("terms")).to_numpy(zero_copy_only=False)
                of = np.repeat(np.arange(n), sizes)
                term = place[part.column("terms").flatten().to_numpy(zero_copy_only=False)]
                tf = part.column("tfs").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                norm = k1 * (1 - b + b * part.column("len").to_numpy(zero_copy_only=False) / avg_len)
                mine = term >= 0
                of, term, tf = of[mine], term[mine], tf[mine]
                block = np.zeros((n, len(used)))
                block[of, term] = idf[used][term] * tf * (k1 + 1) / (tf + norm[of])
                open_queries = np.flatnonzero(block.max(axis=0, initial=0) @ asked >= best.least)
                if not len(open_queries):
                    continue
                scores = block @ asked[:, open_queries]
                hit = (scores > 0) & (scores >= best.least[open_queries])
                if not hit.any():
                    continue
                keys = part.column("doc").to_pylist()
                for j in np.flatnonzero(hit.any(axis=0)):
                    docs = np.flatnonzero(hit[:, j])
                    if len(docs) > k:  # the rest can only tie with the last
                        cut = np.partition(scores[docs, j], len(docs) - k)[len(docs) - k]
                        docs = docs[scores[docs, j] >= cut - 2e-6]
                    best.add(open_queries[j], [(scores[d, j], keys[d]) for d in docs])
        out = [(ids[q], doc, float(score)) for q, held in enumerate(best.held) for score, doc in held]
        if out and empty is not None:
            q, d, s = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(d, empty.type), pa.array(s, pa.float64())], ["query_id", "doc", "score"])

    return index.mapInArrow(run, f"query_id {kind}, doc {doc_type}, score double")


def ranked_search(docs: DataFrame, queries: DataFrame, key: str, text: str, k: int = 50, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Q10: the ``k`` best documents of each query (``query_id, query``) by BM25 over the words of a column, exactly.

    Whole texts are split once, into an index in the shared folder of which asked term a document has how often. The queries
    are the bounded side: in blocks of ``BLOCK_QUERIES`` they go to the tasks, which keep ``k`` documents a query and pass over blocks
    of documents that cannot be among them; only these lists are shuffled. A document without a key or a text is
    left out, a query without a known word finds nothing; equal scores (six decimals) go by key; repeated keys are documents of
    their own.
    """
    spark = docs.sparkSession
    wanted = queries.select("query_id", F.explode(F.array_distinct(words_of(F.col("query")))).alias("term")).distinct()
    passes = math.ceil(wanted.count() / PASS_WORDS)
    if passes > 1:
        part = F.pmod(F.xxhash64("query_id"), F.lit(passes))
        several = [ranked_search(docs, queries.where(part == i), key, text, k, k1, b) for i in range(passes)]
        return reduce(DataFrame.unionByName, several)
    asked = wanted.collect()  # at most so many, but for a single query of more words
    terms = sorted({r.term for r in asked})
    number = {t: i for i, t in enumerate(terms)}
    index = written(forward_index(docs, terms, key, text))
    whole = index.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len")).first()
    df = np.zeros(max(len(terms), 1))
    for r in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row a term asked for
        df[r.term] = r["count"]
    idf = np.log(1 + (whole.n - df + 0.5) / (df + 0.5))
    kind = queries.schema["query_id"].dataType.simpleString()
    ids = sorted({r.query_id for r in asked}, key=lambda x: (x is None, x))
    per_block = max(1, min(BLOCK_QUERIES, 8 * CELLS // max(len(terms), 1)))
    best = spark.createDataFrame([], f"query_id {kind}, doc {index.schema['doc'].dataType.simpleString()}, score double")
    for at in range(0, len(ids), per_block):
        own = {q: i for i, q in enumerate(ids[at : at + per_block])}
        weights = np.zeros((len(terms), len(own)))
        for r in asked:
            if r.query_id in own:
                weights[number[r.term], own[r.query_id]] = 1.0
        best = best.unionByName(_best_of_tasks(index, list(own), weights, idf, whole.avg_len or 1.0, k, k1, b, kind))
    scored = best.withColumn("score", F.round("score", 6))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("doc").alias(key), "score")
