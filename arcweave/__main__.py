"""Commands over a stored graph: python -m arcweave COMMAND ...; lists are read from standard input, one a line."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.api import GraphService
from arcweave.functions.identifiers import person_key
from arcweave.operators.graph import PropertyGraph
from arcweave.parse import GraphError
from arcweave.sources.sinks import json_rows


def _rows(spark: SparkSession, lines: Iterable[str], name: str) -> DataFrame:
    return spark.createDataFrame([(line.rstrip("\n"),) for line in lines if line.strip()], f"{name} string")


def get_node(spark: SparkSession, args: argparse.Namespace, lines: Iterable[str]) -> DataFrame:
    """A node as JSON, by identifier or by number."""
    graph = PropertyGraph.load(spark, args.graph)
    service = GraphService(graph)
    if args.node.isdigit():
        return json_rows(service.described(spark.createDataFrame([(int(args.node),)], "node bigint"), args.mask))
    return json_rows(service.get_node(args.node, args.mask))


def node_ids(spark: SparkSession, args: argparse.Namespace, lines: Iterable[str]) -> DataFrame:
    """Identifier and number of each identifier of the input; of unknown ones the number is empty."""
    asked = _rows(spark, lines, "swhid")
    found = asked.join(PropertyGraph.load(spark, args.graph, properties=False, labels=False).nodes.select("swhid", "node_id"), "swhid", "left")
    return found.select(F.concat_ws(" ", "swhid", F.coalesce(F.col("node_id").cast("string"), F.lit(""))).alias("value"))


def label_ids(spark: SparkSession, args: argparse.Namespace, lines: Iterable[str]) -> DataFrame:
    """Number and name of each name of the input that labels have."""
    found = PropertyGraph.load(spark, args.graph, properties=False).label_name_ids(_rows(spark, lines, "name")).where("label_name_id is not null")
    return found.select(F.concat_ws(" ", F.col("label_name_id").cast("string"), F.col("name").cast("string")).alias("value"))


def hash_persons(spark: SparkSession, args: argparse.Namespace, lines: Iterable[str]) -> DataFrame:
    """Pseudonym of each full name of the input."""
    return _rows(spark, lines, "name").select(person_key(F.col("name").cast("binary")).alias("value"))


COMMANDS = {"get-node": get_node, "node-ids": node_ids, "label-ids": label_ids, "hash-persons": hash_persons}


def run(spark: SparkSession, argv: Sequence[str], lines: Iterable[str] = ()) -> list[str]:
    """Lines that a command prints."""
    parser = argparse.ArgumentParser(prog="arcweave", description=__doc__)
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("--graph", help="folder of a stored graph")
    parser.add_argument("--node", help="identifier or number", default="")
    parser.add_argument("--mask", help="fields, with commas between")
    args = parser.parse_args(argv)
    if args.command != "hash-persons" and not args.graph:
        parser.error("--graph is required")
    return [r.value for r in COMMANDS[args.command](spark, args, lines).toLocalIterator()]


def main() -> int:
    spark = SparkSession.builder.appName("arcweave").getOrCreate()
    try:
        for line in run(spark, sys.argv[1:], sys.stdin):
            print(line)
    except GraphError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
