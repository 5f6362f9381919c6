"""Tables that change together: new folders of rows, then one ledger entry that makes them visible."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeloom.operators.aggregates import duplicate_keys
from noticeloom.operators.joins import present
from noticeloom.sources.records import upsert

_ENTRY = "version long, batch long, parts map<string, array<string>>, schemas map<string, string>, numbers map<string, long>"


@dataclass(frozen=True)
class Snapshot:
    """What a store holds as of one entry of its ledger; later commits do not change it."""

    version: int = 0
    batch: int | None = None
    parts: Mapping[str, Sequence[str]] = field(default_factory=dict)
    schemas: Mapping[str, str] = field(default_factory=dict)
    numbers: Mapping[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class Staged:
    """Rows of a table that are written and not visible yet."""

    table: str
    folder: str
    rows: DataFrame


class Store:
    """Several tables in a folder that Spark can reach, changed by one commit at a time.

    Rows are staged in new folders; a commit is one entry of the ledger, a single file that names the folders of
    every table. That file appears whole or not at all, so readers see all of a commit or nothing, whatever is
    killed in between, and folders that no entry names are never read. Readers keep the snapshot they began
    with: folders are never overwritten. One writer at a time; of two, the second is told.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        spark.createDataFrame([], _ENTRY).write.mode("ignore").parquet(f"{self.path}/ledger")

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The last entry, or that of a version."""
        entries = self.spark.read.schema(_ENTRY).parquet(f"{self.path}/ledger")
        wanted = entries if version is None else entries.where(F.col("version") == version)
        found = wanted.orderBy(F.desc("version")).limit(2).collect()
        if len(found) == 2 and found[0].version == found[1].version:
            raise ValueError(f"two writers committed version {found[0].version} of {self.path}")
        if not found:
            if version:
                raise ValueError(f"{self.path} has no version {version}")
            return Snapshot()
        return Snapshot(*found[0])

    def read(self, table: str, at: Snapshot | None = None) -> DataFrame:
        """The rows of a table as of a snapshot, by default the last."""
        at = at or self.snapshot()
        schema = T.StructType.fromJson(json.loads(at.schemas[table]))
        return self.spark.read.schema(schema).parquet(*at.parts[table])

    def stage(self, table: str, rows: DataFrame) -> Staged:
        """Writes rows to a folder of their own and gives them back as read from there."""
        folder = f"{self.path}/{table}/{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        return Staged(table, folder, self.spark.read.schema(rows.schema).parquet(folder))

    def commit(self, since: Snapshot, appended: Sequence[Staged] = (), replaced: Sequence[Staged] = (), numbers: Mapping[str, int] | None = None, batch: int | None = None, most_parts: int = 200) -> Snapshot:
        """Adds staged rows to tables, puts others in a table's place, and sets ``numbers``, all at once.

        ``since`` is the snapshot that the rows were made from; if the ledger has moved on, nothing is committed. A table
        of more than ``most_parts`` folders is rewritten as one by the way, so that their number stays bounded.
        """
        parts, schemas = {k: list(v) for k, v in since.parts.items()}, dict(since.schemas)
        for new in replaced:
            parts[new.table], schemas[new.table] = [new.folder], new.rows.schema.json()
        for new in appended:
            if new.table in schemas and new.rows.schema.simpleString() != T.StructType.fromJson(json.loads(schemas[new.table])).simpleString():
                raise ValueError(f"rows for {new.table} have other columns")
            parts.setdefault(new.table, []).append(new.folder)
            schemas[new.table] = new.rows.schema.json()
        for table, folders in parts.items():
            if len(folders) > most_parts:
                whole = self.spark.read.schema(T.StructType.fromJson(json.loads(schemas[table]))).parquet(*folders)
                parts[table] = [self.stage(table, whole).folder]
        if self.snapshot().version != since.version:
            raise ValueError(f"{self.path} has moved on since version {since.version}")
        entry = (since.version + 1, since.batch if batch is None else batch, parts, schemas, {**since.numbers, **(numbers or {})})
        self.spark.createDataFrame([entry], _ENTRY).coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")
        return self.snapshot(since.version + 1)


def replace_load(store: Store, table: str, rows: DataFrame, key: str, dry_run: bool = False) -> dict[str, int]:
    """Checks the keys, then puts ``rows`` in the place of a table; the counts of rows and of rows with a key.

    Duplicate keys stop it before anything is visible; until the commit, and for readers that began before, the old rows stay.
    """
    since, seen = store.snapshot(), Observation()
    counted = rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count(present(F.col(key))).alias("keyed"))
    staged = None if dry_run else store.stage(table, counted)
    if not duplicate_keys((rows if staged is None else staged.rows).withColumn(key, F.col(key).cast("string")), key).isEmpty():
        raise ValueError(f"duplicate values of {key}")
    if staged is None:
        return rows.agg(F.count(F.lit(1)).alias("rows"), F.count(present(F.col(key))).alias("keyed")).first().asDict()
    store.commit(since, replaced=[staged])
    return dict(seen.get)


def upsert_load(store: Store, table: str, updates: DataFrame, key: str, fields: Sequence[str], run_ts: Column) -> dict[str, int]:
    """Merges updates into a table by key and commits the result; how many rows were new, matched and kept, as counted by the write."""
    since, seen = store.snapshot(), Observation()
    merged = upsert(store.read(table, since), updates, key, fields, run_ts)
    merged = merged.observe(seen, *[F.count_if(F.col("outcome") == o).alias(o) for o in ("new", "matched", "kept")])
    store.commit(since, replaced=[store.stage(table, merged.drop("outcome"))])
    return dict(seen.get)


def by_key(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    """A registry's rows dealt by key and sorted, so that its files hold ranges of keys that a scan can skip."""
    return rows.repartitionByRange(buckets, key).sortWithinPartitions(key)


def snapshot_load(store: Store, records: DataFrame, order: str, images: DataFrame, hashes: DataFrame, buckets: int | None = None) -> Snapshot:
    """The records in descending order, and beside them the registries of images by address and of hashes, as one commit."""
    n = buckets or int(store.spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = records.repartitionByRange(n, F.col(order).desc()).sortWithinPartitions(F.col(order).desc())
    staged = [store.stage("records", ordered), store.stage("images", by_key(images, "url", n)), store.stage("hashes", by_key(hashes, "hash", n))]
    return store.commit(store.snapshot(), replaced=staged)
