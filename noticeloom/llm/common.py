"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.session import cut, shared_folder

__all__ = ["BROADCAST_ROWS", "WORD", "cut", "fits", "fresh", "join_small", "shared_folder", "shuffle_width", "sliced", "table"]

#: The words of a text are the runs of other characters than these ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"

#: A table of at most so many narrow rows (some tens of MB) may be broadcast.
BROADCAST_ROWS = 400_000


#: Rows that an Arrow function handles at once, so that a worker holds little beside its batch.
SLICE_ROWS = 500


def sliced(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, without copying; memory that is free goes back after each."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fits(small: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether ``small`` has at most ``limit`` rows; no more than that are counted."""
    return small.limit(limit + 1).count() <= limit


def join_small(
    big: DataFrame, small: DataFrame, on: str | Sequence[str], how: str = "inner", limit: int = BROADCAST_ROWS
) -> DataFrame:
    """Equi-join with a side that is expected to be small, and broadcast only once counted.

    Beyond ``limit`` rows it is a shuffled join, whose skewed keys adaptive execution splits.
    """
    return big.join(F.broadcast(small) if fits(small, limit) else small, on, how)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or it with as many underscores behind as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
