"""Results as streams of lines, and arcs that arrive over time."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Lines that are sent together.
LINES = 100


def lines(df: DataFrame) -> Iterator[str]:
    """Rows as text, columns with a space between, in blocks of LINES; one partition at a time is at the driver."""
    block = []
    for row in df.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in df.columns]).alias("line")).toLocalIterator(prefetchPartitions=True):
        block.append(row.line + "\n")
        if len(block) == LINES:
            yield "".join(block)
            block = []
    if block:
        yield "".join(block)


def append_arcs(spark: SparkSession, incoming: str, schema: str, table: str, checkpoint: str) -> StreamingQuery:
    """Arc files that appear in a folder are added, each pair once a batch, to a table by arc type.

    Ends when all files there have been read. A batch that is run again after a
    failure overwrites what it had written.
    """
    arcs = spark.readStream.schema(schema).parquet(incoming)

    def put(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(["src", "dst"]).write.mode("overwrite").partitionBy("src_type", "dst_type").parquet(f"{table}/batch={number}")

    return arcs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
