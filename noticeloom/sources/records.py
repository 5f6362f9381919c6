"""Scans and sinks."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeloom.operators.aggregates import duplicate_keys

#: Columns of a category export; fixed values.
CSV_COLUMNS = (
    "Recall Number", "Product Safety Warning Number", "Date", "Product Safety Warning Date", "Recall Heading", "Name of product",
    "Description", "Hazard Description", "Consumer Action", "Original Product Safety Warning Announcement", "Remedy Type", "Units",
    "Incidents", "Remedy", "Sold At Label", "Sold At", "Importers", "Manufacturers", "Distributors", "Manufactured In", "Custom Label",
    "Custom Field",
)
DATED_STEM = r"^(.*?)(?:_\d{4}-\d{2}-\d{2}_\d{4}-\d{2}-\d{2})?\.[A-Za-z]+$"


def file_stem() -> Column:
    """A scanned file's name without its date range and ending, which is its category."""
    return F.regexp_extract(F.col("_metadata.file_name"), DATED_STEM, 1)


def read_cpsc_csv(spark: SparkSession, path: str) -> DataFrame:
    """Category CSVs with quotes, doubled quotes, line ends inside cells and a byte-order mark; all columns text.

    A cell without anything is null, a quoted empty one the empty text: what stands for null is a name that no file holds.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', enforceSchema=False, inferSchema=False, encoding="UTF-8", nullValue=uuid.uuid4().hex)
    return raw.select("*", file_stem().alias("category"))


def read_recall_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Files of a JSON array of documents; ids of the store go, what cannot be parsed is kept aside in ``_corrupt_record``."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(full).json(path, multiLine=True, mode="PERMISSIVE").drop("_id")


def read_category_docs(spark: SparkSession, folder: str, schema: T.StructType, skip: str = "url-map.json", pattern: str = "*.json") -> DataFrame:
    """S3: files of ``{meta, recalls: [...]}``, a row per recall with its place and the file's stem; broken files are skipped."""
    wrapped = T.StructType([T.StructField("meta", T.StructType([T.StructField("slug", T.StringType())])), T.StructField("recalls", T.ArrayType(schema))])
    raw = spark.read.schema(wrapped).json(folder, multiLine=True, mode="DROPMALFORMED", pathGlobFilter=pattern, recursiveFileLookup=True)
    named = raw.select("*", F.col("_metadata.file_name").alias("file"), file_stem().alias("category")).where(F.col("file") != skip)
    return named.select("category", "file", F.posexplode("recalls").alias("pos", "r")).select("category", "file", "pos", "r.*")


def records_between(records: DataFrame, start: str, end: str, date: str = "RecallDate", recall_id: str = "RecallID") -> DataFrame:
    """Records of a date range, newest first, then by id as text downwards."""
    kept = records.where(F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return kept.orderBy(F.col(date).desc_nulls_last(), F.col(recall_id).cast("string").desc())


def replace_table(df: DataFrame, path: str, key: str, dry_run: bool = False) -> DataFrame:
    """Checks keys, then overwrites; a row of counts. Duplicate keys stop it before anything is written."""
    stats = df.agg(F.count("*").alias("rows"), F.count(F.nullif(F.btrim(F.col(key).cast("string")), F.lit(""))).alias("keyed"))
    if not duplicate_keys(df.withColumn(key, F.col(key).cast("string")), key).isEmpty():
        raise ValueError(f"duplicate values of {key}")
    if not dry_run:
        df.write.mode("overwrite").parquet(path)
    return stats.withColumn("written", F.lit(not dry_run))


def upsert(target: DataFrame, updates: DataFrame, key: str, fields: Sequence[str], run_ts: Column) -> DataFrame:
    """Target merged with updates by key: values that are there win, others stay; times of creation and change.

    ``outcome`` is kept, matched or new. Keys must be unique on both sides.
    """
    t, u = target.alias("t"), updates.alias("u")
    both = t.join(u, F.col(f"t.{key}") == F.col(f"u.{key}"), "full_outer")
    old, new = F.col(f"t.{key}").isNotNull(), F.col(f"u.{key}").isNotNull()
    value = lambda f: F.coalesce(F.col(f"u.{f}"), F.col(f"t.{f}")) if f in updates.columns else F.col(f"t.{f}")
    own = lambda f: F.col(f"t.{f}") if f in target.columns else F.lit(None).cast("timestamp")
    return both.select(
        F.coalesce(F.col(f"t.{key}"), F.col(f"u.{key}")).alias(key),
        *[value(f).alias(f) for f in fields],
        F.when(old, own("createdAt")).otherwise(run_ts).alias("createdAt"),
        F.when(new, run_ts).otherwise(own("updatedAt")).alias("updatedAt"),
        F.when(old & new, "matched").when(new, "new").otherwise("kept").alias("outcome"),
    )


def save_snapshot(df: DataFrame, path: str, order: str, partitions: int | None = None) -> None:
    """The table in descending order, dealt by ranges so that the files follow each other."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, F.col(order).desc()).sortWithinPartitions(F.col(order).desc()).write.mode("overwrite").parquet(path)


def write_sitemap(entries: DataFrame, path: str, cap: int = 50_000) -> None:
    """The entries as JSON lines, a folder per file of at most ``cap`` addresses."""
    entries.withColumn("file_no", F.floor((F.col("position") - 1) / cap)).write.mode("overwrite").partitionBy("file_no").json(path)
