"""Sinks: sorted lists, property tables, statistics and JSON, all by Spark's commit protocol."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.operators.graph import PropertyGraph


def write_sorted_lines(df: DataFrame, column: str, path: str, rows_a_file: int = 100_000_000, codec: str = "gzip") -> None:
    """Distinct values as lines in global order, in files of at most so many lines."""
    lines = df.select(F.col(column).cast("string").alias("value")).distinct().repartitionByRange("value").sortWithinPartitions("value")
    lines.write.option("maxRecordsPerFile", rows_a_file).option("compression", codec).text(path)


def write_base64_lines(df: DataFrame, column: str, path: str) -> None:
    """Distinct binary values as base64, in the order of their bytes."""
    d = df.select(F.col(column).alias("b")).where("b is not null").distinct().repartitionByRange("b").sortWithinPartitions("b")
    d.select(F.base64("b").alias("value")).write.text(path)


def write_properties(graph: PropertyGraph, columns: list[str], path: str) -> None:
    graph.nodes.select("node_id", *columns).repartitionByRange("node_id").sortWithinPartitions("node_id").write.parquet(path)


def write_stats(stats: DataFrame, path: str) -> None:
    """One row, as JSON."""
    stats.write.json(path)


def write_stats_lines(stats: DataFrame, path: str) -> None:
    """One row as lines of key=value; the entries of its maps are lines of their own, after the name of the map."""
    maps = [c for c, t in stats.dtypes if t.startswith("map")]
    own = [F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in stats.columns if c not in maps]

    def entries(c: str) -> Column:
        return F.transform(F.map_entries(c), lambda e: F.concat(F.lit(f"{c}."), e["key"].cast("string"), F.lit("="), e["value"].cast("string")))

    each = map(entries, maps)
    stats.select(F.explode(F.filter(F.concat(F.array(*own), *each), lambda x: x.isNotNull())).alias("value")).write.text(path)


def write_json(graph: PropertyGraph, path: str) -> None:
    graph.nodes.write.json(f"{path}/nodes")
    graph.arcs.write.json(f"{path}/arcs")


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def convert(graph: PropertyGraph, path: str, kind: str) -> None:
    """Saves as "parquet" or "json"."""
    {"parquet": graph.save, "json": lambda p: write_json(graph, p)}[kind](path)


def rows(df: DataFrame) -> Iterator:
    """A stream of rows: one partition at a time is at the driver."""
    return df.toLocalIterator(prefetchPartitions=True)
