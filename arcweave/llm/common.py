"""What the text operators share: table access, lineage cuts and size checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.plans.tables import in_small_batches, scratch, shared_dir, written

__all__ = ["BROADCAST_BYTES", "held_out", "in_small_batches", "scratch", "shared_dir", "table", "written"]

#: Largest side, in bytes of its rows, that an operator broadcasts at once.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves that remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod == rest
