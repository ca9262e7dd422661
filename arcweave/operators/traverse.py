"""Traversals: nodes reached, arcs examined, and what is filtered, limited and counted of them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.operators.graph import PropertyGraph
from arcweave.parse import InvalidArgument, NotFound, edges, natural, node_types
from arcweave.plans.frontier import UNROLLED, Walk, acyclic_depth, unrolled


@dataclass(frozen=True)
class NodeFilter:
    """Types, and numbers of successors seen in the traversal itself (0 where it goes no deeper)."""

    types: str = "*"
    min_traversal_successors: int | None = None
    max_traversal_successors: int | None = None


@dataclass(frozen=True)
class TraversalRequest:
    src: list[str]
    direction: str = "FORWARD"
    edges: str = "*"
    max_edges: int | None = None
    min_depth: int | None = None
    max_depth: int | None = None
    return_nodes: NodeFilter = field(default_factory=NodeFilter)
    max_matching_nodes: int | None = None
    ignore_node: list[str] = field(default_factory=list)


def oriented(graph: PropertyGraph, direction: str) -> PropertyGraph:
    if direction not in ("FORWARD", "BACKWARD"):
        raise InvalidArgument(f"unknown direction {direction}")
    return graph if direction == "FORWARD" else graph.transpose()


def usable_arcs(graph: PropertyGraph, direction: str, restriction: str, ignore: list[int]) -> DataFrame:
    """Arcs of these types in the direction of traversal, without those at ignored nodes."""
    arcs = oriented(graph, direction).with_edges(restriction).arcs
    if ignore:
        arcs = arcs.where(~F.col("src").isin(*ignore) & ~F.col("dst").isin(*ignore))
    return arcs.select("src", "dst")


def source_rows(graph: PropertyGraph, ids: list[int]) -> DataFrame:
    return graph.spark.createDataFrame([(n, i) for i, n in enumerate(ids)], "node bigint, rank bigint")


class Traversal:
    """A checked request against a graph; its results are lazy but for the layers of the walk."""

    def __init__(self, graph: PropertyGraph, request: TraversalRequest):
        r = self.request = request
        for name in ("max_edges", "min_depth", "max_depth", "max_matching_nodes"):
            natural(getattr(r, name), name)
        for name in ("min_traversal_successors", "max_traversal_successors"):
            natural(getattr(r.return_nodes, name), name)
        self.graph = graph
        self.types = node_types(r.return_nodes.types)
        self.sources = graph.node_ids(list(r.src))
        self.ignored = graph.node_ids(list(r.ignore_node)) if r.ignore_node else []
        self.arcs = usable_arcs(graph, r.direction, r.edges, self.ignored)
        self.limit = r.max_matching_nodes or None
        self.ranked = r.max_edges is not None or self.limit is not None
        self._walk: Walk | None = None

    def _visited(self) -> DataFrame:
        """node, depth and ns, the number of arcs examined from it (0 at the last depth)."""
        r = self.request
        rows = source_rows(self.graph, self.sources)
        if self.ranked:
            walk = self._walk = Walk(self.arcs, rows, r.max_edges, ranked=True)
            visited = walk.run(r.max_depth)
            ns = [a.groupBy(F.col("src").alias("node"), F.lit(d).alias("depth"), "rank").agg(F.count("*").alias("ns"), F.max("seq").alias("seq")) for d, a in enumerate(walk.arc_rows)]
            if not ns:
                return visited.select("node", "depth", "rank", F.lit(0).cast("bigint").alias("ns"), F.lit(None).cast("bigint").alias("seq"))
            every = ns[0]
            for one in ns[1:]:
                every = every.unionByName(one)
            return visited.join(every, ["node", "depth", "rank"], "left").select("node", "depth", "rank", F.coalesce("ns", F.lit(0)).alias("ns"), "seq")
        kinds = {r0.node_type for r0 in self.graph.nodes.where(F.col("node_id").isin(*self.sources)).select("node_type").distinct().collect()} if self.sources else set()
        depth = acyclic_depth(edges(r.edges), frozenset(kinds), r.direction == "BACKWARD")
        depth = min(x for x in (depth, r.max_depth, 1 << 30) if x is not None)
        self.bounded = depth <= max(UNROLLED, 4)
        visited = unrolled(self.arcs, rows, self.sources, depth) if self.bounded else Walk(self.arcs, rows).run(r.max_depth).select("node", "depth")
        return visited

    def _with_ns(self, visited: DataFrame) -> DataFrame:
        if "ns" in visited.columns:
            return visited
        n = self.arcs.groupBy("src").agg(F.count("*").alias("n"))
        deep = F.lit(True) if self.request.max_depth is None else F.col("depth") < self.request.max_depth
        return visited.join(n, visited["node"] == n["src"], "left").select("node", "depth", F.when(deep, F.coalesce("n", F.lit(0))).otherwise(0).cast("bigint").alias("ns"))

    def _matching(self, visited: DataFrame) -> DataFrame:
        f, r = self.request.return_nodes, self.request
        if f.min_traversal_successors is not None or f.max_traversal_successors is not None:
            visited = self._with_ns(visited)
            if f.min_traversal_successors is not None:
                visited = visited.where(F.col("ns") >= f.min_traversal_successors)
            if f.max_traversal_successors is not None:
                visited = visited.where(F.col("ns") <= f.max_traversal_successors)
        if r.min_depth:
            visited = visited.where(F.col("depth") >= r.min_depth)
        if self.types is not None:
            kept = self.graph.nodes.where(F.col("node_type").isin(*self.types)).select(F.col("node_id").alias("node"))
            visited = visited.join(kept, "node", "left_semi")
        return visited

    def nodes(self) -> DataFrame:
        """node and depth of each emitted node; sources reached again and repeated ones come again."""
        found = self._matching(self._visited())
        if self.limit is not None:
            found = found.orderBy("depth", "rank").limit(self.limit)
        return found.select("node", "depth")

    def count_nodes(self) -> DataFrame:
        return self.nodes().agg(F.count("*").alias("count"))

    def count_edges(self) -> DataFrame:
        """Arcs examined; where the number of nodes is limited, up to the last of these."""
        visited = self._visited()
        if self.limit is None:
            return self._with_ns(visited).agg(F.coalesce(F.sum("ns"), F.lit(0)).alias("count"))
        last = self._matching(visited).orderBy("depth", "rank").limit(self.limit).agg(F.count("*").alias("n"), F.max(F.struct("depth", "rank")).alias("last")).first()
        if last.n == self.limit:
            depth, rank = last["last"]
            visited = visited.where((F.col("depth") < depth) | ((F.col("depth") == depth) & (F.col("rank") <= rank)))
        return visited.agg(F.coalesce(F.sum("ns"), F.lit(0)).alias("count"))

    def edges(self) -> DataFrame:
        """(src, dst) of all usable arcs of each emitted node."""
        return self.arcs.join(self.nodes().select(F.col("node").alias("src")), "src").select("src", "dst")

    def labelled_edges(self) -> DataFrame:
        """(src, dst, labels) of all usable arcs of each emitted node."""
        labels = oriented(self.graph, self.request.direction).with_edges(self.request.edges).arcs.select("src", "dst", "labels")
        return self.edges().join(labels, ["src", "dst"]).select("src", "dst", "labels")


def closure(graph: PropertyGraph, origins: list[str] | DataFrame, retry_protocols: bool = False) -> tuple[PropertyGraph, DataFrame]:
    """The subgraph reached from origins, by url, and the urls that aren't in the graph.

    retry_protocols: an unknown url is looked up with git:// for https:// and the other way.
    """
    from arcweave.functions.identifiers import origin_swhid, swapped_protocol

    urls = origins if not isinstance(origins, list) else graph.spark.createDataFrame([(u,) for u in origins], "url string")
    ids = graph.nodes.where(F.col("node_type") == "ori").select("node_id", "swhid")
    names = urls.select("url", origin_swhid(F.col("url")).alias("swhid")).distinct()
    found = names.join(ids, "swhid", "left")
    if retry_protocols:
        other = ids.select(F.col("swhid").alias("_other"), F.col("node_id").alias("_id"))
        found = found.withColumn("_other", origin_swhid(swapped_protocol(F.col("url")))).join(other, "_other", "left").withColumn("node_id", F.coalesce("node_id", "_id"))
    unknown = found.where("node_id is null").select("url")
    walk = Walk(graph.arcs.select("src", "dst"), found.where("node_id is not null").select(F.col("node_id").alias("node")).distinct(), mark_sources=True)
    kept = walk.run(None).select(F.col("node").alias("node_id")).distinct()
    return graph.subgraph(lambda nodes: nodes.join(kept, "node_id", "left_semi").select(*nodes.columns)), unknown


def visit_paths(graph: PropertyGraph, src: str, direction: str = "FORWARD", restriction: str = "*", most: int = 100_000) -> DataFrame:
    """path, for each path from src to a node without successors; more than most at once is an error, as their number can be exponential."""
    (start,) = graph.node_ids([src])
    arcs = usable_arcs(graph, direction, restriction, [])
    from arcweave.plans.tables import written

    open_paths = graph.spark.createDataFrame([([start],)], "path array<bigint>")
    done = None
    while True:
        at = F.element_at("path", -1)
        ends = open_paths.join(arcs.select("src").distinct(), at == F.col("src"), "left_anti")
        done = ends if done is None else done.union(ends)
        longer = open_paths.join(arcs, at == F.col("src")).select(F.concat("path", F.array("dst")).alias("path"))
        longer = written(longer.limit(most + 1), "paths")
        n = longer.count()
        if n > most:
            raise InvalidArgument(f"more than {most} paths")
        if not n:
            return done
        open_paths = longer
