"""Operator 5: canonical exact digests of documents, by DataFrame functions alone."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticeloom.llm.common import cut, join_small, shuffle_width, table

#: Unicode white space, and the zero-width marks that carry no text.
BLANK = r"\s\u0085   -     　​﻿"
#: What is not folded yet: a run of blanks other than one ordinary blank.
UNFOLDED = rf" [{BLANK}]+|[{BLANK}&&[^ ]][{BLANK}]*"
#: Stands before all ids for rows without one.
NO_ID = -(1 << 63)


def canonical(text: Column) -> Column:
    """Compatibility-composed (NFKC), case-folded, composed again, blanks folded to one and trimmed.

    The two Unicode steps are static methods of the ICU library on Spark's own class path,
    called by the SQL function ``reflect``; plain ASCII texts need only lower-casing. Spark takes
    ``reflect`` for non-deterministic and repeats it for every use, so a result is given a column first.
    """
    compose = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    fold = lambda c: F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))
    wide = compose(fold(compose(text)))
    folded = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(wide)
    return F.btrim(F.regexp_replace(folded, UNFOLDED, " "))


def wide_hash(canon: Column, bits: int = 128) -> Column:
    """Two xxhash64 of differently keyed bytes as hex; ``bits`` below 128 is for tests of collisions."""
    one, two = (F.lpad(F.lower(F.hex(F.xxhash64(F.lit(key), canon))), 16, "0") for key in ("one", "two"))
    return F.substring(F.concat(one, two), 1, bits // 4)


def text_hash() -> Column:
    """52 bits of a hash of ``text`` as it is, which quantiles, computed in doubles, keep."""
    return F.shiftright(F.xxhash64("text"), 12)


def fingerprint_texts(docs: DataFrame, text: str, name: str, bits: int = 128) -> DataFrame:
    """``docs`` with ``name``: the wide hash (``key``) of the canonical form of a text, and its SHA-256 (``long``)."""
    canon = F.col(f"{name}_canon")
    made = docs.withColumn(f"{name}_canon", canonical(F.col(text)))
    return made.withColumn(name, F.struct(wide_hash(canon, bits).alias("key"), F.sha2(canon, 256).alias("long"))).drop(f"{name}_canon")


def collided(texts: DataFrame, marks: DataFrame, bits: int) -> DataFrame:
    """``key`` of the buckets that hold different canonical texts, found by comparing their bytes.

    Only buckets of more than one row are compared. Smallest and largest text of a bucket are combined
    before the shuffle, so that copies of one text travel once a task.
    """
    raws = cut(marks.groupBy("key", "raw").agg(F.count("*").alias("n")))
    several = raws.groupBy("key").agg(F.sum("n").alias("rows")).where("rows > 1").select("key")
    wanted = cut(raws.join(several, "key", "left_semi").select("raw").distinct())
    held = join_small(texts.withColumn("raw", text_hash()), wanted, "raw", "left_semi")
    held = held.select(canonical(F.col("text")).alias("canon")).select("canon", wide_hash(F.col("canon"), bits).alias("key"))
    return held.groupBy("key").agg(F.min("canon").alias("low"), F.max("canon").alias("high")).where("low <> high").select("key")


def id_ranges(rows: DataFrame, buckets: int) -> list[tuple[int, int, int]]:
    """``(id, raw, parts)``, ascending: where ranges of rows end that are ordered by id and hash of the text.

    Ids are cut at quantiles. An id that would fill several ranges is cut by the hashes of its texts, and
    one text that still would, by turns into ``parts``. The last range has no end.
    """
    share = [i / buckets for i in range(1, buckets)]
    if not share:
        return []
    cuts = Counter(rows.agg(F.percentile_approx("id", share, 20 * buckets).alias("q")).first()["q"] or [])
    often = [i for i, n in cuts.items() if n > 1]
    top = (1 << 63) - 1
    ends = [(i, top, 1) for i in cuts]
    if often:
        held = rows.where(F.col("id").isin(*often)).groupBy("id").agg(F.percentile_approx("raw", share, 20 * buckets).alias("q"))
        for r in held.collect():
            ends.append((r["id"] - 1, top, 1))
            n = cuts[r["id"]]
            for raw, parts in Counter(r["q"][(i + 1) * len(r["q"]) // (n + 1)] for i in range(n)).items():
                ends += [(r["id"], raw, parts), (r["id"], raw - 1, 1)] if parts > 1 else [(r["id"], raw, 1)]
    best: dict[tuple[int, int], int] = {}
    for i, raw, parts in ends:
        if i >= NO_ID and raw >= NO_ID:
            best[i, raw] = max(parts, best.get((i, raw), 1))
    return [(i, raw, parts) for (i, raw), parts in sorted(best.items())]


def range_number(ranges: list[tuple[int, int, int]]) -> Column:
    """The number of a row's range (see ``id_ranges``) by ``id`` and ``raw``: searched among every so many ends, then between two of these."""
    width = max(1, int(len(ranges) ** 0.5))
    ends = [F.struct(F.lit(i).cast("long").alias("id"), F.lit(raw).cast("long").alias("raw")) for i, raw, _ in ranges]
    of = lambda some: F.array(*some).cast("array<struct<id:bigint,raw:bigint>>")
    below = lambda some: F.size(F.filter(some, lambda e: e < F.struct("id", "raw")))
    block = below(of(ends[width - 1 :: width])) * width
    index = block + below(F.slice(of(ends), block + 1, F.lit(width)))
    parts = [*[n for *_, n in ranges], 1]
    first = [sum(parts[:i]) for i in range(len(parts))]
    ints = lambda values: F.array(*map(F.lit, values)).cast("array<int>")
    return F.get(ints(first), index) + F.pmod(F.monotonically_increasing_id(), F.get(ints(parts), index)).cast("int")


def dealt_by_id(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows of ``doc_id, text`` so dealt into ``bucket`` that the next one by ``doc_id``, cyclically, is in the same.

    Ties go by the hash of the text, then by the text; null ids come first. Rows are dealt by ranges,
    which neither a frequent id nor a frequent text of one id overfills; the first row of each range also
    goes to the range before it as a ``guest``, so that whole texts are shuffled once.
    """
    rows = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), text_hash().alias("raw"))
    placed = rows.withColumn("bucket", range_number(id_ranges(rows, buckets)))
    firsts = cut(placed.groupBy("bucket").agg(F.min(F.struct("id", "raw", "text")).alias("row")))  # a row a range
    ring = Window.orderBy("bucket")
    back = F.coalesce(F.lag("bucket").over(ring), F.max("bucket").over(Window.partitionBy()))
    guests = firsts.withColumn("back", back).select(F.lit(None).cast("long").alias("doc_id"), "row.text", "row.id", "row.raw", F.col("back").alias("bucket"), F.lit(True).alias("guest"))
    return placed.withColumn("guest", F.lit(False)).unionByName(guests)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 128) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, clash`` of every row.

    Texts are equal to this operator if their canonical forms are. A fingerprint is the wide hash of the
    canonical text, by which texts are grouped, with its SHA-256 behind; it depends on nothing but
    the text. The bytes of all texts of a bucket of several rows are compared, and ``clash`` marks rows in
    whose bucket they differ, as which the SHA-256 still tells them apart. ``near_edited`` and
    ``near_next`` are 1 or 0; an edited text is compared with its own document byte by byte. A null
    text is empty; a single row follows itself; repeated rows and ids follow each other, see
    ``dealt_by_id``; other columns play no part; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pairs = fingerprint_texts(dealt_by_id(rows, 4 * shuffle_width(docs.sparkSession)), "text", "own", bits)
    order = Window.partitionBy("bucket").orderBy("guest", "id", "raw", "text")
    pairs = pairs.withColumn("next", F.lead(F.struct("text", "own")).over(order)).where(~F.col("guest"))
    n = F.char_length("text")
    k = F.floor(n / 4).cast("int")
    edited = F.when(k == 0, F.col("text")).otherwise(F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 4) as int))"), F.substring("next.text", F.lit(1), k)))
    made = fingerprint_texts(pairs.withColumn("n_chars", n.cast("long")).withColumn("edited", edited), "edited", "changed", bits)
    same = F.when(F.col("own.key") != F.col("changed.key"), 0.0).when(canonical(F.col("text")) == canonical(F.col("edited")), 1.0).otherwise(0.0)
    shown = lambda c: F.concat_ws("-", F.col(f"{c}.key"), F.col(f"{c}.long"))
    marks = cut(
        made.select(
            "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), shown("own").alias("fingerprint"), shown("changed").alias("edited_fingerprint"),
            same.alias("near_edited"), (F.col("own") == F.col("next.own")).cast("double").alias("near_next"), F.col("own.key").alias("key"), "raw",
        )
    )
    clashes = cut(collided(rows, marks, bits))
    if clashes.isEmpty():
        return marks.drop("key", "raw").withColumn("clash", F.lit(False))
    found = join_small(marks, clashes.withColumn("found", F.lit(True)), "key", "left")
    return found.withColumn("clash", F.coalesce("found", F.lit(False))).drop("key", "raw", "found")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
