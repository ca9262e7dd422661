"""Sources: relations of an ingest, lists in text files, graphs in JSON or built by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcweave.functions.identifiers import is_swhid, origin_swhid
from arcweave.operators.graph import PropertyGraph
from arcweave.plans.tables import numbered, written
from arcweave.schema import ARC_COLUMNS, LABEL, NODE_COLUMNS, RELATIONS, TARGET_TYPES


def read_relations(spark: SparkSession, path: str, kind: str = "orc", only: list[str] | None = None) -> dict[str, DataFrame]:
    """Relations by name from <path>/<name>; columns are found by name and no others are read."""
    return {name: spark.read.format(kind).schema(columns).load(f"{path}/{name}") for name, columns in RELATIONS.items() if only is None or name in only}


def row_count(df: DataFrame) -> int:
    """Of a file source: from the files' footers alone."""
    return df.count()


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files (compressed ones too), without empty ones: value."""
    return spark.read.text(path).where(F.col("value") != "")


def read_lines_in_order(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files, without empty ones, numbered by file in alphabetical order, then as they stand: place, value."""
    lines = spark.read.text(path).where(F.col("value") != "").select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_line"))
    return numbered(written(lines, "lines"), ["_file", "_start", "_line"], "place").select("place", "value")


def read_masked(spark: SparkSession, path: str) -> DataFrame:
    """Identifiers to hide, one a line; lines that aren't identifiers are passed over."""
    return read_lines(spark, path).where(is_swhid(F.col("value"))).select(F.col("value").alias("swhid"))


def read_origins(spark: SparkSession, path: str) -> DataFrame:
    """Origins, one URL a line: url, swhid."""
    return read_lines(spark, path).select(F.col("value").alias("url"), origin_swhid(F.col("value")).alias("swhid"))


def read_edge_list(spark: SparkSession, nodes: str, edges: str) -> PropertyGraph:
    """From lines of identifiers, and lines of two identifiers with a space between."""
    from arcweave.operators.extract import numbered_graph

    n = read_lines(spark, nodes).select(F.col("value").alias("swhid"))
    e = read_lines(spark, edges).select(F.split("value", " ").alias("v")).select(F.get("v", F.lit(0)).alias("src"), F.get("v", F.lit(1)).alias("dst"))
    return numbered_graph(n, e.withColumn("label", F.lit(None).cast(LABEL)))


def read_json(spark: SparkSession, path: str) -> PropertyGraph:
    """Of two folders of JSON lines, as write_json() leaves them."""
    ddl = lambda columns: ", ".join(f"{c} {t}" for c, t in columns.items())
    return PropertyGraph.of(spark.read.schema(ddl(NODE_COLUMNS)).json(f"{path}/nodes"), spark.read.schema(ddl(ARC_COLUMNS)).json(f"{path}/arcs"))


class GraphBuilder:
    """A small graph put together by hand. Labels of one arc are kept as a sorted list."""

    def __init__(self, spark: SparkSession):
        self.spark, self._nodes, self._arcs = spark, {}, {}

    def node(self, swhid: str, **properties) -> int:
        if swhid not in self._nodes:
            self._nodes[swhid] = {"node_id": len(self._nodes), "node_type": swhid.split(":")[2], "swhid": swhid, "is_skipped": False}
        self._nodes[swhid] |= properties
        return self._nodes[swhid]["node_id"]

    def arc(self, src: int, dst: int, **label) -> GraphBuilder:
        labels = self._arcs.setdefault((src, dst), [])
        if label:
            labels.append({f.name: label.get(f.name) for f in LABEL.fields})
        return self

    def entry(self, src: int, dst: int, name: bytes, permission: int | None = None) -> GraphBuilder:
        return self.arc(src, dst, name=name, permission=permission)

    def branch(self, src: int, dst: int, name: bytes) -> GraphBuilder:
        return self.arc(src, dst, name=name)

    def visit(self, src: int, dst: int, timestamp: int, full: bool = True, kind: str = "vcs") -> GraphBuilder:
        return self.arc(src, dst, visit_timestamp=timestamp, is_full_visit=full, visit_type=kind)

    def done(self) -> PropertyGraph:
        types = {n["node_id"]: n["node_type"] for n in self._nodes.values()}
        node_schema = T._parse_datatype_string(", ".join(f"{c} {t}" for c, t in NODE_COLUMNS.items()))
        arc_schema = T._parse_datatype_string(", ".join(f"{c} {t}" for c, t in ARC_COLUMNS.items()))
        nodes = [tuple(n.get(c) for c in NODE_COLUMNS) for n in self._nodes.values()]
        key = lambda x: tuple((v is not None, v) for v in x.values())
        arcs = [(s, d, types[s], types[d], sorted(labels, key=key)) for (s, d), labels in self._arcs.items()]
        return PropertyGraph.of(self.spark.createDataFrame(nodes, node_schema), self.spark.createDataFrame(arcs, arc_schema))
