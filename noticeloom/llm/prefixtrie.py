"""Operator 11: the trie of dialogue prefixes, its subtree totals by time-forward processing."""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticeloom.llm.common import join_small, table
from noticeloom.operators.ordering import running_total
from noticeloom.session import written

#: Dialogues of more turns are ordered by ranges instead of in one task each.
LONG = 100_000
#: A shard's root has up to so many times the members that the least node of its band has, and so many levels below it.
BAND, LEVELS = 1000, 1 << 16
#: Messages that a queue holds in memory before it writes them out.
QUEUE = 200_000

_WIDE = "decimal(38,0)"


def _large(rows: DataFrame, most: int) -> DataFrame | None:
    """The dialogues of more than ``most`` rows, if there are any."""
    large = rows.groupBy("conv_id").count().where(F.col("count") > most).select("conv_id")
    return None if large.isEmpty() else large


def summed_upto(rows: DataFrame, order: list[str], name: str, weight: Column, long: int = LONG) -> DataFrame:
    """The sum of ``weight`` in a dialogue up to each row; long dialogues are summed by ranges, not in one task."""
    whole = lambda df: df.withColumn(name, F.sum(weight).over(Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    large = _large(rows, long)
    if large is None:
        return whole(rows)
    cut_up = running_total(join_small(rows, large, "conv_id", "left_semi"), order, name, weight, ["conv_id"])
    return whole(join_small(rows, large, "conv_id", "left_anti")).unionByName(cut_up)


def positions(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", long: int = LONG) -> DataFrame:
    """``conv_id, depth, digest, bytes``: the turns of each dialogue numbered from 1, their texts left behind.

    By turn number, null first, ties by role and text; a null role or text is empty. Turns without a dialogue id belong to none.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text"))
    ranked = summed_upto(rows, ["turn", "role", "text"], "depth", F.lit(1).cast("long"), long)
    # the length of the role keeps it apart from the text
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    return ranked.select("conv_id", "depth", digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes"))


def prefix_sums(rows: DataFrame, long: int = LONG) -> DataFrame:
    """Each turn with ``key`` and ``above``: numbers for the prefix that ends with it, and for the one before.

    A prefix is the sum of 96-bit digests of its turns, each with its place, so that it is summed in parts.
    """
    at = F.sha2(F.concat_ws(":", "depth", "digest"), 256)
    half = lambda i: F.conv(F.substring(at, i, 12), 16, 10).cast(_WIDE)
    own = rows.withColumn("own", (half(1) * F.lit(1 << 48).cast("decimal(20,0)") + half(13)).cast(_WIDE))
    keyed = summed_upto(own, ["depth"], "key", F.col("own"), long)
    return keyed.withColumn("key", F.col("key").cast(_WIDE)).withColumn("above", (F.col("key") - F.col("own")).cast(_WIDE)).drop("own")


class SpillingQueue:
    """Takes messages in any order and gives them by their key; what goes beyond ``most`` is written out in sorted runs.

    The files have no name and go with the task that made them.
    """

    def __init__(self, most: int = QUEUE):
        self.most, self.held, self.runs, self.turn = most, [], [], 0

    def push(self, message: tuple) -> None:
        heapq.heappush(self.held, message)
        if len(self.held) > self.most:
            file = tempfile.TemporaryFile()
            for i in range(0, len(self.held), 4096):
                if not i:
                    self.held.sort()
                pickle.dump(self.held[i : i + 4096], file)
            self.held = []
            file.seek(0)
            self._lead(self._read(file))

    def _read(self, file) -> Iterator[tuple]:
        with file:
            while True:
                try:
                    part = pickle.load(file)
                except EOFError:
                    return
                yield from part

    def _lead(self, run: Iterator[tuple]) -> None:
        if first := next(run, None):
            self.turn += 1
            heapq.heappush(self.runs, (first, self.turn, run))

    def peek(self) -> tuple | None:
        return min((q[0] for q in (self.held, [r[0] for r in self.runs[:1]]) if q), default=None)

    def pop(self) -> tuple:
        if self.runs and (not self.held or self.runs[0][0] < self.held[0]):
            first, _, run = heapq.heappop(self.runs)
            self._lead(run)
            return first
        return heapq.heappop(self.held)


def pass_upwards(batches: Iterator[pa.RecordBatch], most: int = QUEUE) -> Iterator[pa.RecordBatch]:
    """Totals of nodes that come deepest level first: each sends its own on to its parent's time, unless it is a shard's root."""
    queue = SpillingQueue(most)
    for batch in batches:
        ids, depths, parents, inner = (batch.column(c).to_pylist() for c in ("conv_id", "depth", "parent_conv_id", "inner"))
        leaves, saved = (batch.column(c).to_pylist() for c in ("n_leaves", "saved_tokens"))
        for i, (conv, depth) in enumerate(zip(ids, depths, strict=True)):
            while (first := queue.peek()) and first[:2] == (-depth, conv):
                _, _, more_leaves, more_saved = queue.pop()
                leaves[i] += more_leaves
                saved[i] += more_saved
            if inner[i]:
                queue.push((1 - depth, parents[i], leaves[i], saved[i]))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "depth", "parent_conv_id", "inner")), pa.array(leaves, pa.int64()), pa.array(saved, pa.int64())], ["conv_id", "depth", "parent_conv_id", "inner", "n_leaves", "saved_tokens"])
    if queue.peek():
        raise ValueError("a message has no node")


def subtree_totals(shared: DataFrame, occurrences: DataFrame, band: int = BAND, levels: int = LEVELS, most: int = QUEUE) -> DataFrame:
    """``conv_id, depth, n_leaves, saved_tokens`` summed over subtrees, for the nodes with two members and more.

    Nodes have numbers of members that never rise from parent to child. They fall into bands, each ``band`` times as high as
    the one before, and into blocks of ``levels`` levels; what hangs together in one of these is a shard, with at most
    ``band`` nodes a level, whatever the share of its first turn. Shards of the lowest band and deepest block come first:
    nodes in reverse level order, sorted by Spark, pass totals on through a queue. Roots of shards send theirs across to the
    shards of later bands and blocks, summed by target first. There are as many rounds as bands and blocks.
    """
    spark = shared.sparkSession
    shared = shared.withColumn("band", F.floor(F.log(F.col("n_convs").cast("double")) / F.log(F.lit(float(band))) + 1e-9).cast("int")).withColumn("block", F.floor(F.col("depth") / levels))
    # the root of a node's shard: the first node of its band and block on the way of the node's first member
    heavy = shared.where("band > 0").select("depth", "key", F.col("band").alias("heavy"))
    path = join_small(occurrences, heavy, ["depth", "key"], "left")
    path = path.select("conv_id", F.coalesce("heavy", F.lit(0)).alias("band"), F.floor(F.col("depth") / levels).alias("block"), "depth", "key")
    roots = path.groupBy("conv_id", "band", "block").agg(F.min(F.struct("depth", "key")).alias("root"))
    nodes = written(
        shared.join(roots, ["conv_id", "band", "block"])
        .withColumn("inner", (F.col("depth") > F.col("root.depth")))
        .select("conv_id", "depth", "parent_conv_id", "n_leaves", "saved_tokens", "band", "block", "inner", F.xxhash64("root.depth", "root.key").alias("shard"))
    )
    rounds = sorted((r.band, -r.block) for r in nodes.select("band", "block").distinct().collect())  # a row a round
    totals, sent = [], None
    fields = "conv_id long, depth long, parent_conv_id long, inner boolean, n_leaves long, saved_tokens long"
    for number, block in rounds:
        turn = nodes.where((F.col("band") == number) & (F.col("block") == -block))
        if sent is not None:
            inbox = sent.groupBy("parent_conv_id", "depth").agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
            inbox = inbox.select(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"), "more_leaves", "more_saved")
            turn = turn.join(inbox, ["conv_id", "depth"], "left")
            turn = turn.withColumn("n_leaves", F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).withColumn("saved_tokens", F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0)))
        turn = turn.select("shard", "conv_id", "depth", "parent_conv_id", "inner", "n_leaves", "saved_tokens")
        ordered = turn.repartition("shard").sortWithinPartitions(F.desc("depth"), "conv_id")
        done = written(ordered.mapInArrow(lambda batches: pass_upwards(batches, most), fields))
        totals.append(done.select("conv_id", "depth", "n_leaves", "saved_tokens"))
        roots_of = done.where("not inner and parent_conv_id is not null")
        sent = roots_of if sent is None else sent.unionByName(roots_of)
    out = totals[0] if totals else spark.createDataFrame([], "conv_id long, depth long, n_leaves long, saved_tokens long")
    for more in totals[1:]:
        out = out.unionByName(more)
    return out


def ends_digests(ends: DataFrame) -> DataFrame:
    """``depth, key, ends_sha256``: the digest of the ids that end at a node, which stream by in order and are never gathered."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = digest = None
        out: list[tuple] = []
        for batch in batches:
            for depth, key, conv in zip(*(batch.column(c).to_pylist() for c in ("depth", "key", "conv_id")), strict=True):
                if (depth, key) == node:
                    digest.update(b",%d" % conv)
                    continue
                if node:
                    out.append((*node, digest.hexdigest()))
                node, digest = (depth, key), hashlib.sha256(b"%d" % conv)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.decimal128(38, 0), pa.string()), strict=True)], ["depth", "key", "ends_sha256"])
                out = []
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.decimal128(38, 0)), pa.array([digest.hexdigest()])], ["depth", "key", "ends_sha256"])

    placed = ends.select("depth", "key", "conv_id").repartition("depth", "key").sortWithinPartitions("depth", "key", "conv_id")
    return placed.mapInArrow(hashed, f"depth long, key {_WIDE}, ends_sha256 string")


def prefix_trie(rows: DataFrame, members: DataFrame, long: int = LONG, band: int = BAND, levels: int = LEVELS, most: int = QUEUE) -> DataFrame:
    """One row per distinct prefix of the dialogues, from ``rows`` (``conv_id, depth, digest, bytes``); ``members`` names all dialogues, turnless ones too.

    ``conv_id`` is the smallest member, and with ``depth`` the node's key; ``parent_conv_id`` its parent's; ``n_convs``
    members; ``n_children``; ``n_leaves`` childless nodes and ``saved_tokens`` what a cache would save in its subtree (the
    bytes of a node's last text for each member but one), the node included; ``ends_sha256`` the digest of the members that end here.

    A node with one member heads a chain of such: it has one leaf and saves nothing, so only shared nodes are processed in
    shards (``subtree_totals``). Nodes go by the sum of their turns' digests; that all members of a node agree in their last
    turn and their parent is checked. An empty table has no nodes.
    """
    ids = members.select(F.col("conv_id").cast("long")).where("conv_id is not null").distinct()
    zero = F.lit(0).cast(_WIDE)
    tops = ids.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit("").alias("digest"), F.lit(0).cast("long").alias("bytes"), zero.alias("key"), F.lit(None).cast(_WIDE).alias("above"))
    keyed = prefix_sums(rows, long).select("conv_id", "depth", "digest", "bytes", "key", "above")
    occurrences = written(keyed.unionByName(tops))
    agree = (F.min("digest") == F.max("digest")) & F.min("above").eqNullSafe(F.max("above"))
    nodes = occurrences.groupBy("depth", "key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("bytes").alias("bytes"), F.min("above").alias("above"), agree.alias("agree"))
    nodes = written(nodes.withColumn("agree", F.when(F.col("agree"), True).otherwise(F.raise_error(F.lit("two prefixes share a key")))))
    below = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("above").alias("key")).agg(F.count("*").alias("n_children"), F.count(F.when(F.col("n_convs") == 1, 1)).alias("alone"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    joined = nodes.join(below, ["depth", "key"], "left").join(parents, ["depth", "above"], "left")
    children = F.coalesce("n_children", F.lit(0))
    full = written(joined.select("conv_id", "depth", "key", "parent_conv_id", "n_convs", "bytes", children.alias("n_children"), F.coalesce("alone", F.lit(0)).alias("alone")))
    own = (F.col("alone") + F.when(F.col("n_children") == 0, 1).otherwise(0)).cast("long")
    shared = full.where("n_convs > 1").select("conv_id", "depth", "key", "parent_conv_id", "n_convs", own.alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    totals = subtree_totals(shared, occurrences.select("conv_id", "depth", "key"), band, levels, most)
    last = occurrences.groupBy("conv_id").agg(F.max(F.struct("depth", "key")).alias("end")).select("conv_id", "end.*")
    out = full.join(totals, ["conv_id", "depth"], "left").join(ends_digests(last), ["depth", "key"], "left")
    return out.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def dialogue_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``prefix_trie`` of a table of turns.

    Repeated rows are turns of their own; dialogues that differ only in ids share all nodes; other columns play no part, whatever
    their names. Long texts are read once and leave only a digest and their size.
    """
    return prefix_trie(positions(turns, conv_col, turn_col, role_col, text_col), turns.select(F.col(conv_col).alias("conv_id")))


def rebuilt(rows: DataFrame) -> DataFrame:
    """Each dialogue c begins with the first h turns of dialogue c - c % 5 and goes on with its own turns after its first h; h comes from the id.

    ``c % 5`` is never negative.
    """
    h = (F.crc32(F.col("conv_id").cast("string")) % 9).alias("h")
    source = (F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(5))).alias("source")
    kept = rows.withColumn("h", h).where(F.col("depth") > F.col("h")).drop("h")
    who = rows.select("conv_id").distinct().select("conv_id", source, h)
    starts = rows.where("depth <= 8").withColumnRenamed("conv_id", "source")
    led = who.join(starts, "source").where("depth <= h").select("conv_id", "depth", "digest", "bytes")
    # where the source has fewer than h turns, what follows moves up
    n = led.groupBy("conv_id").agg(F.count("*").alias("n"))
    moved = kept.join(n, "conv_id", "left").withColumn("depth", F.col("depth") - F.crc32(F.col("conv_id").cast("string")) % 9 + F.coalesce("n", F.lit(0))).drop("n")
    return led.unionByName(moved)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of the rebuilt conversations, a row per node."""
    turns = table(spark, sf_dir, "conversations")
    rows = written(positions(turns))
    return prefix_trie(rebuilt(rows), rows.select("conv_id"))
