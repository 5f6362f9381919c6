"""Duplicates, sort orders and slugs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeloom.operators.joins import matching, present
from noticeloom.session import cut, written


def identity_key(number: str = "RecallNumber", recall_id: str = "RecallID", url: str = "URL", slug: str = "slug", have: Sequence[str] = ()) -> Column:
    """One key per real-world recall: its number, else id, else address, else slug."""
    parts = [F.concat(F.lit(p), present(F.col(c))) for p, c in (("rn:", number), ("id:", recall_id), ("url:", url), ("slug:", slug)) if c in have]
    return F.coalesce(*parts)


def winners(df: DataFrame, key: Column, newest: str, languages: str, ties: Sequence[str]) -> DataFrame:
    """Of the rows of one key the latest, then that with most languages, then the smallest by ``ties``.

    A mergeable ``min_by`` over a struct, so that rows are combined before the shuffle and a hot key
    does not gather its rows. Rows without a key stay.
    """
    rank = F.struct((-F.coalesce(F.unix_seconds(F.col(newest).cast("timestamp")), F.lit(-(1 << 40)))).alias("a"), (-F.coalesce(F.col(languages), F.lit(0))).alias("b"), *ties)
    keyed = df.withColumn("dedupe_key", key)
    best = keyed.where("dedupe_key is not null").groupBy("dedupe_key").agg(F.min_by(F.struct(*df.columns), rank).alias("row")).select("row.*")
    return best.unionByName(keyed.where("dedupe_key is null").drop("dedupe_key"))


def first_of_hash(df: DataFrame, hash_col: str, order: Sequence[Column]) -> DataFrame:
    """The first row of each hash in the given order."""
    return df.groupBy(hash_col).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("row")).select("row.*")


def candidate_class(rows: DataFrame, stored: DataFrame, key: str, position: str) -> DataFrame:
    """``fresh`` if nothing is stored, ``newer`` before the first stored row of the listing, else ``backfill``."""
    seen = rows.join(stored.select(key).distinct(), key, "left_semi").agg(F.min(position).alias("first_stored"))
    some = stored.agg((F.count("*") > 0).alias("some"))
    kind = F.when(~F.col("some"), "fresh").when(F.col("first_stored").isNull() | (F.col(position) < F.col("first_stored")), "newer").otherwise("backfill")
    return rows.crossJoin(F.broadcast(seen)).crossJoin(F.broadcast(some)).withColumn("candidate_class", kind).drop("first_stored", "some")


def dated_class(rows: DataFrame, stored: DataFrame, date: str) -> DataFrame:
    """W3 for sources that list by date: ``newer`` if after the newest stored, ``fresh`` if nothing is stored, else ``backfill``; undated rows are backfill."""
    newest = stored.agg(F.max(date).alias("newest"), (F.count(F.lit(1)) > 0).alias("some"))
    kind = F.when(~F.col("some"), "fresh").when(F.col("newest").isNull() & F.col(date).isNotNull(), "newer").when(F.col(date) > F.col("newest"), "newer").otherwise("backfill")
    return rows.crossJoin(F.broadcast(newest)).withColumn("candidate_class", kind).drop("newest", "some")  # one row


def assign_orders(candidates: DataFrame, bounds: DataFrame, position: str, base: int, large: int = 0) -> DataFrame:
    """Sort orders: fresh ones fall from the base, newer ones end just above the largest, backfill goes below the smallest.

    A class may be as large as the table: one of more than ``large`` rows is ranked by ranges, not in one task.
    """
    sizes = candidates.groupBy(F.col("candidate_class").alias("class_")).agg(F.count("*").alias("class_n"))
    ranked = summed_within(candidates, "candidate_class", [position], "class_rank", large=large) if large else global_rank(candidates, [position], "class_rank", within=["candidate_class"])
    ranked = ranked.join(F.broadcast(sizes), F.col("candidate_class").eqNullSafe(F.col("class_")))
    i, n = F.col("class_rank") - 1, F.col("class_n")
    order = F.when(F.col("candidate_class") == "fresh", base - i).when(F.col("candidate_class") == "newer", F.col("max_order") + n - i).otherwise(F.col("min_order") - 1 - i)
    return ranked.crossJoin(F.broadcast(bounds.select("min_order", "max_order"))).withColumn("sortOrder", order.cast("long")).drop("min_order", "max_order", "class_", "class_n", "class_rank")


def running_total(df: DataFrame, order: Sequence[str], name: str, weight: Column | None = None, within: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """The sum of ``weight`` (1 if none, which makes a rank) up to each row in a global order, without one task that sorts them all.

    Rows are dealt by ranges of all columns of the order, so that no busy value of the first fills a
    range; equal rows are dealt by turns, as they may stand in any order. Sums inside a range move up by
    those before it. ``within`` names columns whose every value is summed by itself: only those that go
    over the end of a range need that, at most one a range. Nulls come first.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = {"r_weight": F.lit(1) if weight is None else weight, "r_turn": F.monotonically_increasing_id()}
    ranged = df.withColumns(own).repartitionByRange(parts, *within, *order, "r_turn").withColumn("r_part", F.spark_partition_id())
    placed = cut(ranged)  # a range keeps its number
    sizes = placed.groupBy("r_part", *within).agg(F.sum("r_weight").alias("r_sum"))
    upto = Window.partitionBy(*within).orderBy("r_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("r_before", F.sum("r_sum").over(upto)).where("r_before is not null")
    before = before.select(F.col("r_part").alias("b_part"), *[F.col(c).alias(f"b_{i}") for i, c in enumerate(within)], "r_before")
    met = F.col("r_part") == F.col("b_part")
    for i, c in enumerate(within):
        met = met & F.col(c).eqNullSafe(F.col(f"b_{i}"))
    inside = F.sum("r_weight").over(Window.partitionBy("r_part", *within).orderBy(*order, "r_turn").rowsBetween(Window.unboundedPreceding, 0))
    # ``before`` has a row a range without ``within``, and with it a row for each range that begins inside a value: ``parts`` at most
    summed = placed.withColumn("r_inside", inside).join(F.broadcast(before), met, "left")
    return summed.withColumn(name, F.col("r_inside") + F.coalesce("r_before", F.lit(0))).select(*df.columns, name)


def global_rank(df: DataFrame, order: Sequence[str], name: str = "rank", within: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """The rank of every row in a global order, or among the rows of one value of ``within``."""
    return running_total(df, order, name, None, within, parts)


def repair_orders(df: DataFrame, order: Sequence[str], current: str, folder: str) -> DataFrame:
    """The changes that number the rows 1..N by date and id: old and new order and folder."""
    ranked = global_rank(df, order, "new_order")
    new = F.regexp_replace(F.col(folder), r"^\d+", F.col("new_order").cast("string"))
    return ranked.where(F.col(current) != F.col("new_order")).select(*order, F.col(current).alias("old_order"), "new_order", F.col(folder).alias("old_folder"), new.alias("new_folder"))


def order_gaps(df: DataFrame, order: str, parts: int | None = None) -> DataFrame:
    """The numbers missing between the smallest and the largest.

    Each number is followed by the next one of its range, and the first number of a range by the last
    of the ranges before, so that only what is missing is made: the work goes by the rows, not by how far
    the numbers reach.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbers = df.select(F.col(order).cast("long").alias("x")).where("x is not null").distinct()
    placed = cut(numbers.repartitionByRange(parts, "x").withColumn("part", F.spark_partition_id()))
    last = F.lag("x").over(Window.partitionBy("part").orderBy("x"))
    ends = placed.groupBy("part").agg(F.min("x").alias("x"), F.max("x").alias("top"))  # a row a range
    across = ends.select("x", F.lag("top").over(Window.orderBy("part")).alias("last"))
    steps = placed.select("x", last.alias("last")).unionByName(across).where("x - last > 1")
    # a long gap is made in pieces, so that no row becomes one huge array
    piece = 1 << 20
    pieces = steps.select("x", "last", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(x - last - 2) div {piece}"))).alias("i"))
    return pieces.select(F.explode(F.sequence(F.col("last") + 1 + F.col("i") * piece, F.least(F.col("x") - 1, F.col("last") + (F.col("i") + 1) * piece))).alias("missing"))


#: Groups of more rows are summed by ranges instead of in one task each.
LARGE_GROUP = 200_000


def summed_within(df: DataFrame, group: str, order: Sequence[str], name: str, weight: Column | None = None, large: int = LARGE_GROUP) -> DataFrame:
    """``running_total`` inside each value of ``group``: a window for most, ranges only for values that have been counted as large."""
    big = df.groupBy(group).count().where(F.col("count") > large).select(group)
    upto = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    whole = lambda x: x.withColumn(name, F.sum(F.lit(1) if weight is None else weight).over(upto))
    if big.isEmpty():
        return whole(df)
    # no more of them than the table has such numbers of rows
    return whole(df.join(big, group, "left_anti")).unionByName(running_total(df.join(big, group, "left_semi"), order, name, weight, [group]))


def _numbered(slug: Column) -> tuple[Column, Column]:
    """A slug without the number at its end, and that number, if it is one that a suffix may be: 2 and above without leading zeros."""
    number = F.regexp_extract(slug, r"-([2-9]|[1-9][0-9]{1,17})$", 1)
    return F.when(number != "", F.regexp_replace(slug, "-[0-9]+$", "")), F.when(number != "", number).cast("long")


def unique_slugs(df: DataFrame, base: str, arrival: str, row_id: str, existing: DataFrame | None = None, large: int = LARGE_GROUP) -> DataFrame:
    """``row_id, slug``: the base, else ``base-2``, ``base-3`` and so on, first come first served.

    The k-th row of a base gets its k-th free number, so only what blocks a number must be known: slugs already stored,
    and other bases that are this base and a number. Such a base keeps its own slug if its first row comes before the
    row that would reach the number, which is decided edge by edge: each round finds for every edge, from the
    decisions of the round before, the row that would reach it, by its rank. A decision depends on lower numbers
    and shorter bases only, so the rounds end with the one answer that a row-by-row replay gives; most tables take two
    or three. No base, however frequent, is gathered, and bases that no other one meets are numbered at once. A null
    base has a null slug; ties of arrival go by row id.
    """
    rows = written(df.select(F.col(row_id).alias("row_id"), F.col(arrival).alias("arrival"), F.col(base).alias("base")))  # read several times
    came = F.struct("arrival", "row_id")
    stats = rows.where("base is not null").groupBy("base").agg(F.count("*").alias("n"), F.min(came).alias("first_row"))
    shorter, number = _numbered(F.col("base"))
    bases = stats.withColumns({"shorter": shorter, "number": number})
    names = bases.select(F.col("base").alias("shorter"))
    edges = bases.where("number is not null").select("shorter", "number", "base", "first_row").join(names, "shorter", "left_semi")
    none = bases.limit(0)
    held = none.select("shorter", "number")
    taken = none.select("base")
    if existing is not None:
        slugs = existing.select("slug", *[c.alias(n) for c, n in zip(_numbered(F.col("slug")), ("shorter", "number"), strict=True)])
        held = matching(slugs.where("number is not null"), names, "shorter").select("shorter", "number").distinct()
        taken = matching(slugs.select(F.col("slug").alias("base")), bases, "base").distinct()
    edges = edges.join(held, ["shorter", "number"], "left_anti")  # a stored slug blocks it whatever comes
    edges, held, taken = written(edges), written(held), written(taken)
    met = edges.select(F.col("shorter").alias("base")).union(edges.select("base")).union(held.select(F.col("shorter").alias("base"))).union(taken).distinct()
    alone = bases.join(met, "base", "left_anti")
    single = alone.where("n = 1").select(F.col("first_row.row_id").alias("row_id"), F.col("base").alias("slug"))
    repeated = summed_within(rows.join(alone.where("n > 1").select("base"), "base", "left_semi"), "base", ["arrival", "row_id"], "rank", large=large)
    plain = repeated.select("row_id", F.when(F.col("rank") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", "rank")).alias("slug"))
    out = single.unionByName(plain).unionByName(rows.where("base is null").select("row_id", F.lit(None).cast("string").alias("slug")))
    if met.isEmpty():
        return out
    ranked = written(summed_within(rows.join(met, "base", "left_semi"), "base", ["arrival", "row_id"], "rank", large=large))
    blocked = _settled(edges, held, taken, ranked)
    return out.unionByName(_kth_free(ranked, *blocked, large))


def _settled(edges: DataFrame, held: DataFrame, taken: DataFrame, ranked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The numbers that stay blocked for each base, and the bases whose own slug is gone before their first row."""
    mine = edges.select("shorter", "number", "base", "first_row", F.lit(False).alias("lost"))
    while True:
        gone = taken.select("base").union(mine.where("lost").select("base")).distinct().select(F.col("base").alias("shorter"), F.lit(1).alias("gone"))
        marks = mine.withColumn("blocks", (~F.col("lost")).cast("int")).unionByName(held.withColumn("blocks", F.lit(1)), allowMissingColumns=True)
        before = F.coalesce(F.sum("blocks").over(Window.partitionBy("shorter").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        reached = marks.withColumn("before", before).where("base is not null").join(gone, "shorter", "left")
        # the rank of the row that would reach the number: its first row takes the base itself, if that is free
        reached = reached.withColumn("rank", F.col("number") - F.col("before") - F.coalesce("gone", F.lit(0)))
        rival = ranked.select(F.col("base").alias("shorter"), "rank", F.struct("arrival", "row_id").alias("rival"))
        now = reached.join(rival, ["shorter", "rank"], "left").select("shorter", "number", "base", "first_row", F.coalesce(F.col("rival") < F.col("first_row"), F.lit(False)).alias("lost"), F.col("lost").alias("was"))
        now = written(now)
        changed = not now.where("lost <> was").isEmpty()
        mine = now.drop("was")
        if not changed:
            blocks = mine.where("not lost").select(F.col("shorter").alias("base"), "number").unionByName(held.select(F.col("shorter").alias("base"), "number"))
            return blocks, taken.select("base").union(mine.where("lost").select("base")).distinct()


def _kth_free(ranked: DataFrame, blocks: DataFrame, gone: DataFrame, large: int) -> DataFrame:
    """Each row's slug: the base, or its k-th number that nothing blocks; blocks count for the rows behind their gap."""
    rows = ranked.join(gone.withColumn("gone", F.lit(1)), "base", "left").withColumn("k", F.col("rank") - 1 + F.coalesce("gone", F.lit(0)))
    whole = rows.where("k = 0").select("row_id", F.col("base").alias("slug"))
    places = blocks.withColumn("j", F.row_number().over(Window.partitionBy("base").orderBy("number")))
    places = places.select("base", (2 * (F.col("number") - 1 - F.col("j")) + 1).alias("place"), F.lit(1).alias("block"))  # behind so many free numbers
    both = rows.where("k > 0").select("base", "row_id", (2 * F.col("k")).alias("place"), F.lit(0).alias("block")).unionByName(places, allowMissingColumns=True)
    passed = summed_within(both, "base", ["place"], "passed", F.col("block"), large)
    slug = F.concat_ws("-", "base", (F.expr("place div 2") + 1 + F.col("passed")).cast("string"))
    return whole.unionByName(passed.where("block = 0").select("row_id", slug.alias("slug")))


def recent_items(df: DataFrame, user: str, item: str, ts: str, least: int = 8, most: int = 30) -> DataFrame:
    """Per user the latest distinct items, upper-cased, of some length, newest first."""
    name = F.upper(F.btrim(item))
    seen = df.where(F.char_length(name) >= least).groupBy(user, name.alias("item")).agg(F.max(ts).alias("last_seen"))
    rank = F.row_number().over(Window.partitionBy(user).orderBy(F.col("last_seen").desc(), "item"))
    return seen.withColumn("rank", rank).where(F.col("rank") <= most)


