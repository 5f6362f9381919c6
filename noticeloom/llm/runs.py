"""Operator 12: maximal periodic runs of words, from longest common extensions by suffix trees."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.llm.common import sliced, table
from noticeloom.llm.tokenlengths import balanced

#: A run has at least so many words, and its period at least so many times.
LEAST_LENGTH, LEAST_EXPONENT = 6, 4

#: Bytes of text handled at once in a task; a longer text stands alone.
PART_BYTES = 4 << 20

Rewrite = Callable[[object, list[bytes]], list[bytes]]
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _times(keys: np.ndarray) -> np.ndarray:
    """How often each element occurs in ``keys``."""
    order = np.argsort(keys)
    ranked = keys[order]
    starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    counts = np.diff(np.r_[starts, len(keys)])
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(counts, counts)
    return out


def stretches(codes: np.ndarray, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> np.ndarray:
    """The places in ``codes`` that may lie in a run, ascending; nothing of a run is ever left out.

    In a run of period q and length n >= max(least_length, least_exponent * q) each word stands at least
    least_exponent times, and each three neighbouring words (n - 2) // q times. What is rarer than that in
    its stretch cannot belong to a run and cuts the stretch in two, until nothing more goes. Keys are
    mixed to 64 bits: words whose keys fall together count too often, and too much is kept, never too little.
    """
    threes = max(least_length, least_exponent) >= 3  # else a run may be shorter than that
    least = min((max(least_length, least_exponent * q) - 2) // q for q in (1, 2, least_length))
    at = np.flatnonzero(np.bincount(codes)[codes] >= least_exponent) if len(codes) else np.zeros(0, np.int64)
    codes = codes.astype(np.uint64)
    while True:
        breaks = np.flatnonzero(np.diff(at) != 1) + 1
        sizes = np.diff(np.r_[0, breaks, len(at)])
        stretch = np.repeat(np.arange(len(sizes)), sizes)
        stays = np.repeat(sizes >= least_length, sizes)
        at, stretch = at[stays], stretch[stays].astype(np.uint64)
        if len(at) < least_length:
            return at[:0]
        word = codes[at] * _MIX[0] + stretch * _MIX[3]
        frequent = _times(word) >= least_exponent
        if not threes:
            return at[frequent]
        three = np.flatnonzero((at[2:] - at[:-2] == 2) & (stretch[2:] == stretch[:-2]) & frequent[2:] & frequent[1:-1] & frequent[:-2])
        keys = word[three] + codes[at[three + 1]] * _MIX[1] + codes[at[three + 2]] * _MIX[2]
        three = three[_times(keys) >= least] if len(three) else three
        kept = np.zeros(len(at), bool)
        for k in (0, 1, 2):
            kept[three + k] = True
        if kept.all():
            return at
        at = at[kept]


def suffix_tree(s: list[int], size: int) -> tuple[dict[int, int], list[int], list[int]]:
    """Ukkonen's tree of ``s``, whose last letter stands nowhere else; letters are below ``size``.

    Returns the children by ``node * size + first letter`` and where the edge into each node starts
    and ends. Node 0 is the root.
    """
    n = len(s)
    start, end, link = [0], [0], [0]
    child: dict[int, int] = {}
    node = edge = length = due = 0
    for i, letter in enumerate(s):
        due += 1
        open_node = 0
        while due:
            if not length:
                edge = i
            key = node * size + s[edge]
            to = child.get(key)
            if to is None:
                child[key] = len(start)
                start.append(i)
                end.append(n)
                link.append(0)
                if open_node:
                    link[open_node] = node
                    open_node = 0
            else:
                along = min(end[to], i + 1) - start[to]
                if length >= along:
                    edge += along
                    length -= along
                    node = to
                    continue
                if s[start[to] + length] == letter:
                    if open_node and node:
                        link[open_node] = node
                    length += 1
                    break
                fork = len(start)
                child[key] = fork
                start += [start[to], i]
                end += [start[to] + length, n]
                link += [0, 0]
                child[fork * size + letter] = fork + 1
                start[to] += length
                child[fork * size + s[start[to]]] = to
                if open_node:
                    link[open_node] = fork
                open_node = fork
            due -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - due + 1
    return child, start, end


class Extensions:
    """Longest common extensions of the suffixes of a word sequence, each by two looks into a table.

    The depths along the Euler tour of the suffix tree; the lowest of them between two leaves is that of
    their common ancestor, found among minima over stretches of powers of two.
    """

    def __init__(self, s: list[int], size: int):
        child, start, end = suffix_tree(s, size)
        n, nodes = len(s), len(start)
        keys = np.fromiter(child.keys(), np.int64, len(child))
        to = np.fromiter(child.values(), np.int64, len(child))
        order = np.argsort(keys)
        at = np.searchsorted(keys[order] // size, np.arange(nodes + 1))
        kids, stop, at = to[order].tolist(), at[1:].tolist(), at[:-1].tolist()
        depth, tour, ranked, up, node = [0] * nodes, [0], [], [], 0
        first = [0] * n
        while True:
            if at[node] < stop[node]:
                below = kids[at[node]]
                at[node] += 1
                depth[below] = depth[node] + end[below] - start[below]
                up.append(node)
                node = below
                if end[node] == n and at[node] == stop[node]:  # a leaf
                    suffix = n - depth[node]
                    first[suffix] = len(tour)
                    ranked.append(suffix)
            elif up:
                node = up.pop()
            else:
                break
            tour.append(depth[node])
        self.first = np.array(first, np.int64)
        self.ranked = np.array(ranked, np.int64)  # suffixes in order
        self.lowest = [np.array(tour, np.int32)]
        width = 1
        while 2 * width <= len(tour):
            last = self.lowest[-1]
            self.lowest.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.first[i], self.first[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            of = level == k
            out[of] = np.minimum(self.lowest[k][a[of]], self.lowest[k][b[of] - (1 << int(k)) + 1])
        return out


def next_lower(ranks: list[int]) -> list[int]:
    """For each place the next one with a lower rank, or the length."""
    out, open_places = [len(ranks)] * len(ranks), []
    for i, r in enumerate(ranks):
        while open_places and ranks[open_places[-1]] > r:
            out[open_places.pop()] = i
        open_places.append(i)
    return out


def runs_of(codes: np.ndarray, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> np.ndarray:
    """The runs of a sequence of word numbers as rows of start, length and period, by start and period.

    Every run holds a Lyndon word as long as its period, the longest that starts there, in the order of the
    words or in the reverse one; it ends before the next suffix that is lower. Each such candidate is
    extended to the right in the tree of the sequence and to the left in that of the reversal.
    """
    none = np.zeros((0, 3), np.int64)
    n = len(codes)
    if n < least_length:
        return none
    letters, s = np.unique(codes, return_inverse=True)
    size = len(letters) + 1
    s = (s + 1).tolist()  # 0 is the end
    ahead = Extensions([*s, 0], size)
    rank = np.empty(n + 1, np.int64)
    rank[ahead.ranked] = np.arange(n + 1)
    at = np.tile(np.arange(n), 2)
    period = np.r_[next_lower(rank[:n].tolist()), next_lower((-rank[:n]).tolist())] - at
    fits = at + (least_exponent - 1) * period <= n  # a run has so much behind the start of its first Lyndon word
    at, period = at[fits], period[fits]
    right = ahead(at, at + period)
    long = right > (least_exponent - 2) * period
    at, period, right = at[long], period[long], right[long]
    del ahead
    if not len(at):
        return none
    behind = Extensions([*s[::-1], 0], size)
    left = np.zeros(len(at), np.int64)
    inner = at > 0  # words before the candidate: position k of the sequence is n - 1 - k of the reversal
    left[inner] = behind(n - at[inner], n - at[inner] - period[inner])
    length = left + period + right
    found = length >= np.maximum(least_length, least_exponent * period)
    return np.unique(np.c_[at - left, period, length][found], axis=0)[:, [0, 2, 1]]


def runs_of_texts(texts: list[list[bytes]], least_length: int, least_exponent: int) -> list[np.ndarray]:
    """The runs of each of several texts, given as words."""
    coded, base = [], 0
    for words in texts:  # a word's number is its first place among all; a number of their own stands between texts
        first: dict[bytes, int] = {}
        coded.append(np.fromiter(map(first.setdefault, words, range(base, base + len(words))), np.int64, len(words)))
        base += len(words) + 1
    flat = np.concatenate([np.r_[c, end] for c, end in zip(coded, np.cumsum([len(c) + 1 for c in coded]) - 1, strict=True)]) if coded else np.zeros(0, np.int64)
    kept = stretches(flat, least_length, least_exponent)
    bounds = np.cumsum([0, *[len(c) + 1 for c in coded]])
    cuts = np.searchsorted(kept, bounds)
    out = []
    for k, codes in enumerate(coded):
        at = kept[cuts[k] : cuts[k + 1]] - bounds[k]
        if not len(at):
            out.append(np.zeros((0, 3), np.int64))
            continue
        # stretches follow each other with words between them that stand nowhere else
        gaps = np.flatnonzero(np.diff(at) != 1) + 1
        joined = np.insert(codes[at], gaps, -1 - np.arange(len(gaps)))
        places = np.insert(at, gaps, -1)
        runs = runs_of(joined, least_length, least_exponent)
        runs[:, 0] = places[runs[:, 0]]
        out.append(runs)
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by one blank, of each run only the first period."""
    if len(runs):
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, runs[:, 0] + runs[:, 2], 1)
        np.add.at(change, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
    return b" ".join(words)


def periodic_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_length: int = LEAST_LENGTH,
    least_exponent: int = LEAST_EXPONENT,
    rewrite: Rewrite | None = None,
) -> DataFrame:
    """``doc_id, runs, collapsed`` of every row: its runs of repeated words, and its text without the repeats.

    Words are what stands between ASCII blanks. A run is a stretch of words with smallest period q (words q
    apart are equal), of at least ``least_length`` words and ``least_exponent`` (2 or more) periods, that no
    neighbouring word extends; ``runs`` holds start, length and period of each, by start and period.
    ``collapsed`` has all words but those of a run behind its first period. ``rewrite`` may change the words
    of a document first, given its id.

    What cannot lie in a run is cut out first (``stretches``); of the rest, a suffix tree a document and one of
    its reversal give every run exactly. All of it is linear in the text, but for sorting. Memory goes by the
    longest text, some 500 bytes a word of it that may lie in runs. A null or empty text has no
    runs and an empty ``collapsed``; repeated rows and ids are handled each for itself, a null id
    stays; other columns play no part, whatever their names; an empty table gives no rows.
    """
    if least_exponent < 2:
        raise ValueError("a run repeats at least once")
    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sizes = batch.column("n_bytes").to_pylist()
            for part in balanced(sizes, PART_BYTES):
                piece = batch.slice(part.start, part.stop - part.start)
                ids = piece.column("doc_id")
                texts = [t.split() for t in piece.column("text").to_pylist()]
                if rewrite:
                    texts = list(map(rewrite, ids.to_pylist(), texts))
                runs = runs_of_texts(texts, least_length, least_exponent)
                offsets = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
                flat = np.concatenate(runs)
                structs = pa.StructArray.from_arrays([pa.array(flat[:, c], pa.int64()) for c in (0, 1, 2)], fields=list(run.value_type))
                texts = pa.array(map(collapsed, texts, runs), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(offsets, structs).cast(run), texts], ["doc_id", "runs", "collapsed"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(found, f"doc_id {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def repeat_tail(doc_id: object, words: list[bytes]) -> list[bytes]:
    """One document in ten goes on, from some word, by repeating a stretch; a null id never does."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, with its tail repeated where the rule says so: its runs, the one of most periods, and digests."""
    rows = periodic_runs(table(spark, sf_dir, "documents"), rewrite=repeat_tail)
    # by start and period, so that of equal exponents the first stays
    more = lambda best, r: r["length"] * best["period"] > best["length"] * r["period"]
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(more(best, r), r).otherwise(best))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return rows.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
