"""Plan helpers: tables in the shared folder, and dense numbering without a single-task window."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only a session whose executors are threads of the driver may go without: it gets
    a folder of its own beside the warehouse. On a cluster that is an error, as what one
    executor writes to its own disk the others would miss.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def unsent(df: DataFrame) -> DataFrame:
    """df, which joins shuffle: a guess at its size never has them send it whole through the driver.

    Sorted ids take a byte or two on disk and some hundred in a join's map, so the size
    of the files says little. F.broadcast on the other side still sends that one.
    """
    return df.hint("merge")


_scopes = threading.local()


def written(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """df as a table in the shared folder: ends its lineage, survives lost executors.

    lasting: what a function returns still reads it, so scratch() leaves it.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if open_scopes := getattr(_scopes, "made", None):
        open_scopes[-1].append((path, lasting))
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside go at its end, but for lasting ones, which go with the scope around it, if there is one."""
    if not hasattr(_scopes, "made"):
        _scopes.made = []
    _scopes.made.append([])
    try:
        yield
    finally:
        made = _scopes.made.pop()
        for path, lasting in made:
            if not lasting:
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            elif _scopes.made:
                _scopes.made[-1].append((path, False))


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for what is written inside."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def in_small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """So many rows at most go to Python at once in what is written inside: for rows that carry whole sets or texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """written(df), and its number of rows as the writing itself counts them."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, seen.get["n"]


def numbered(df: DataFrame, by: list[str], name: str, start: int = 0) -> DataFrame:
    """df with column name: 0, 1, 2, ... in the order of by, through a range partitioning.

    Only the number of rows of each partition goes to the driver.
    """
    parts = df.repartitionByRange(*by).sortWithinPartitions(*by).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row"))
    parts = written(parts, "numbered")
    sizes = sorted((r["_part"], r["count"]) for r in parts.groupBy("_part").count().collect())
    before, rows = start, []
    for part, n in sizes:
        rows.append((part, before))
        before += n
    offsets = df.sparkSession.createDataFrame(rows, "_part int, _before long")  # a row for each partition
    place = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    return parts.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + place).drop("_part", "_row", "_before")
