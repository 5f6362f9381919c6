"""Operator 10: mix sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticeloom.llm.common import WORD, cut, join_small, table

#: Bits of the document hash: two histogram levels, then the rest exactly.
HASH_BITS, LEVEL_BITS = 48, 10


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def document_hash(doc_id: Column, seed: str) -> Column:
    """A 48-bit hash of the id alone, so that reruns and other layouts select the same rows."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``(skey, source_size, target)``: weights dealt to sources in order, capped at ``most`` times a source.

    What caps cut off goes to the others by weight, which ends at one water level for all that
    are not capped. The table has a row a source, so its windows need no partitioning key.
    """
    total = Window.partitionBy()
    by_key = Window.orderBy("skey")
    fill = Window.orderBy("ratio", "skey")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    dealt = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_key) - 1) % len(weights) + 1).cast("int"))
    ranked = (
        sizes.withColumn("weight", dealt)
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(total) * F.lit(float(share)))
        .withColumn("rest", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("level", F.col("rest") / (F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    )
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "skey", "level"))).over(total)["level"]
    return ranked.select("skey", "source_size", F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap"))).alias("target"))


def _boundary(hist: DataFrame, bucket: str, budget: str) -> DataFrame:
    """Per source, the bucket in which the running sum passes the budget, and what is left for it."""
    run = Window.partitionBy("skey").orderBy(bucket)
    passed = hist.withColumn("cum", F.sum("tokens").over(run)).where(F.col("cum") > F.col(budget))
    first = passed.groupBy("skey").agg(F.min_by(F.struct(bucket, "tokens", "cum", budget), bucket).alias("x"))
    return first.select("skey", F.col(f"x.{bucket}").alias(bucket), (F.col(f"x.{budget}") - (F.col("x.cum") - F.col("x.tokens"))).alias(budget))


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def mix_plan(rows: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``skey, source_size, target, base, below`` from ``skey, size, h``: all that decides the mix.

    A source whose target is q times its size and a rest takes every document ``base`` = q times,
    and once more those whose hash lies below a threshold at which their sizes sum to the rest. The
    threshold is found from sums by hash bucket; only the bucket it falls in is looked at
    again, twice, the second time by single hash values, so that nothing is sorted and no source
    is gathered. The document at the threshold is taken if that comes nearer to the target.
    """
    low = HASH_BITS - LEVEL_BITS
    first, second = F.shiftright("h", low), F.shiftright("h", low - LEVEL_BITS)
    sizes = rows.groupBy("skey").agg(F.sum("size").alias("source_size"))
    targets = cut(
        source_targets(sizes, weights, share, most)
        .withColumn("base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("target") - F.col("base") * F.col("source_size"))
    )
    part = targets.where("rest > 0").select("skey", F.col("rest").alias("left0"))
    hist1 = rows.groupBy("skey", first.alias("b1")).agg(F.sum("size").alias("tokens"))
    edge1 = cut(_boundary(join_small(hist1, part, "skey"), "b1", "left0"))
    inside1 = join_small(rows.withColumn("b1", first), edge1, ["skey", "b1"])
    hist2 = inside1.groupBy("skey", "left0", second.alias("b2")).agg(F.sum("size").alias("tokens"))
    edge2 = cut(_boundary(hist2, "b2", "left0"))
    inside2 = join_small(rows.withColumn("b2", second), edge2, ["skey", "b2"])
    hist3 = inside2.groupBy("skey", "left0", "h").agg(F.sum("size").alias("tokens"))
    run = Window.partitionBy("skey").orderBy("h")
    crossed = hist3.withColumn("over", F.sum("tokens").over(run) - F.col("left0")).where("over > 0")
    cuts = crossed.groupBy("skey").agg(F.min_by(F.struct("h", "tokens", "over"), "h").alias("x"))
    nearer = F.col("x.over") < F.col("x.tokens") - F.col("x.over")
    cuts = cuts.select("skey", (F.col("x.h") + F.when(nearer, 1).otherwise(0)).alias("below"))
    return cut(targets.join(cuts, "skey", "left").select("skey", "source_size", "target", "base", F.coalesce("below", F.lit(0)).alias("below")))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for every row of ``docs``.

    ``copies`` is how often the mix takes the document, ``taken`` its words, repeats counted
    (see ``mix_plan``). Null texts have size 0, null sources are one source, the last; an empty table
    gives no rows. Repeated rows share a hash and are taken or left together.
    """
    rows = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            _source_key(F.col(source_col)).alias("skey"),
            word_count(F.col(text_col)).alias("size"),
            document_hash(F.col(id_col), seed).alias("h"),
        )
    )
    return (
        join_small(rows, mix_plan(rows, weights, share, most), "skey")
        .withColumn("copies", F.col("base") + F.when(F.col("h") < F.col("below"), 1).otherwise(0))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    )


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix_sources`` takes it, without moving a text.

    A row's hash and its source's threshold decide where the row is read.
    """
    key, h = _source_key(F.col(source_col)).alias("skey"), document_hash(F.col(id_col), seed).alias("h")
    rows = cut(docs.select(key, word_count(F.col(text_col)).alias("size"), h))
    plan = mix_plan(rows, weights, share, most).select("skey", "base", "below")
    held = docs.select(F.struct(*docs.columns).alias("row"), key, h)
    copies = F.col("base") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)
    taken = join_small(held, plan, "skey").select("row", copies.cast("int").alias("copies")).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS h
  FROM documents),
s AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY skey),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY skey) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
r AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio,
             (SELECT CAST(sum(source_size) AS DOUBLE) FROM s) * 1.5::DOUBLE AS budget,
             (SELECT sum(weight) FROM w) AS all_weight FROM w),
f AS (SELECT *, (budget - coalesce(sum(cap) OVER before, 0)) / (all_weight - coalesce(sum(weight) OVER before, 0)) AS level
      FROM r WINDOW before AS (ORDER BY ratio, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT level FROM f WHERE level <= ratio ORDER BY ratio, skey LIMIT 1),
t AS (SELECT skey, source_size, least(cap, coalesce((SELECT level FROM l) * weight, cap)) AS target FROM f),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS base FROM t),
p AS (SELECT *, target - base * source_size AS rest FROM b),
c AS (SELECT d.skey, h, sum(size) AS tokens FROM d GROUP BY d.skey, h),
x AS (SELECT c.skey, c.h, c.tokens, sum(c.tokens) OVER (PARTITION BY c.skey ORDER BY c.h) - p.rest AS over_by
      FROM c JOIN p ON c.skey = p.skey WHERE p.rest > 0),
e AS (SELECT skey, min(h) AS h, arg_min(tokens, h) AS tokens, arg_min(over_by, h) AS over_by FROM x WHERE over_by > 0 GROUP BY skey),
g AS (SELECT skey, h + CASE WHEN over_by < tokens - over_by THEN 1 ELSE 0 END AS below FROM e)
SELECT d.doc_id, d.size, p.source_size, p.target,
       CAST(d.size * (p.base + CASE WHEN d.h < coalesce(g.below, 0) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN p ON d.skey = p.skey LEFT JOIN g ON d.skey = g.skey
"""
