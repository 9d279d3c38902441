"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import discard, materialize, shared_dir

__all__ = ["UPPER", "LOWER", "ascii_lower", "blocks_of", "column", "discard", "materialize", "parallelism", "pieces", "shared_dir", "table"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only; other letters stay as they are."""
    return F.translate(c, UPPER, LOWER)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def pieces(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most so many rows, to bound what numpy holds at once."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def blocks_of(items: Iterable, weight, most: int) -> Iterator[list]:
    """Consecutive items in lists of a total weight of about most; a heavier item stands alone."""
    out, total = [], 0
    for x in items:
        w = weight(x)
        if out and total + w > most:
            yield out
            out, total = [], 0
        out.append(x)
        total += w
    if out:
        yield out
