"""The service: requests by name, results as DataFrames."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.operators import paths, stats
from arcweave.operators.graph import PropertyGraph
from arcweave.operators.traverse import NodeFilter, Traversal, TraversalRequest, oriented
from arcweave.parse import InvalidArgument, Swhid

#: Field paths of a node by what they need.
_DATA = {
    "cnt": {"length": "length", "is_skipped": "is_skipped"},
    "rev": {"author": "author_id", "author_date": "author_ts", "author_date_offset": "author_ts_offset", "committer": "committer_id", "committer_date": "committer_ts", "committer_date_offset": "committer_ts_offset", "message": "message"},
    "rel": {"author": "author_id", "author_date": "author_ts", "author_date_offset": "author_ts_offset", "name": "tag_name", "message": "message"},
    "ori": {"url": "url"},
}
_LABEL = ("name", "permission", "visit_timestamp", "is_full_visit", "visit_type")
FIELDS = ("swhid", "successor", "successor.swhid", "successor.label", *(f"successor.label.{x}" for x in _LABEL), "num_successors", *(k for k in _DATA), *(f"{k}.{f}" for k, fs in _DATA.items() for f in fs))


def mask_of(text: str | list[str] | None) -> set[str]:
    """Fields asked for, prefixes spelled out; None or nothing is all of them, unknown ones are passed over."""
    wanted = text.split(",") if isinstance(text, str) else list(text or ())
    wanted = [w for w in wanted if w] or ["successor", "num_successors", *_DATA]
    out = {"swhid"}
    for w in wanted:
        out |= {f for f in FIELDS if f == w or f.startswith(w + ".")}
        if w in ("successor", "successor.label"):
            out.add("successor.swhid" if w == "successor" else w)
    return out


class GraphService:
    """All operators by name over one graph; hidden: swhids that requests can't see."""

    def __init__(self, graph: PropertyGraph, hidden: DataFrame | None = None):
        self.graph = graph if hidden is None else graph.masked(hidden)

    # nodes

    def described(self, nodes: DataFrame, mask: str | list[str] | None = None, direction: str = "FORWARD", edges: str = "*", keep: tuple[str, ...] = ()) -> DataFrame:
        """nodes (node, and keep) as nested rows of the fields that the mask names; only what these need is read."""
        fields = mask_of(mask)
        columns = ["node_id", "node_type", "swhid", *dict.fromkeys(c for k, fs in _DATA.items() for f, c in fs.items() if f"{k}.{f}" in fields)]
        rows = nodes.join(self.graph.nodes.select(*columns), nodes["node"] == F.col("node_id"))
        out = [F.col("swhid")]
        for k, fs in _DATA.items():
            parts = [F.col(c).alias(f) for f, c in fs.items() if f"{k}.{f}" in fields]
            if parts:
                out.append(F.when(F.col("node_type") == k, F.struct(*parts)).alias(k))
        if fields & {"num_successors"} or any(f.startswith("successor") for f in fields):
            arcs = oriented(self.graph, direction).with_edges(edges).arcs.join(nodes.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
            labels = [x for x in _LABEL if f"successor.label.{x}" in fields]
            parts = []
            if "successor.swhid" in fields or labels or "successor" in fields:
                arcs = arcs.join(self.graph.nodes.select(F.col("node_id").alias("dst"), F.col("swhid").alias("to")), "dst")
                parts = [F.col("to").alias("swhid")] + ([F.transform("labels", lambda x: F.struct(*[x[c].alias(c) for c in labels])).alias("label")] if labels else [])
            successors = arcs.groupBy("src").agg(F.count("*").alias("num_successors"), *([F.sort_array(F.collect_list(F.struct(*parts))).alias("successor")] if parts else []))
            rows = rows.join(successors, rows["node"] == successors["src"], "left")
            if parts:
                out.append(F.coalesce("successor", F.array()).alias("successor"))
            if "num_successors" in fields:
                out.append(F.coalesce("num_successors", F.lit(0)).alias("num_successors"))
        return rows.select(*keep, *out)

    def get_node(self, swhid: str, mask: str | list[str] | None = None) -> DataFrame:
        (node,) = self.graph.node_ids([swhid])
        return self.described(self.graph.spark.createDataFrame([(node,)], "node bigint"), mask)

    # traversals

    def traverse(self, request: TraversalRequest, mask: str | list[str] | None = None) -> DataFrame:
        return self.described(Traversal(self.graph, request).nodes(), mask, request.direction, request.edges)

    def count_nodes(self, request: TraversalRequest) -> DataFrame:
        return Traversal(self.graph, request).count_nodes()

    def count_edges(self, request: TraversalRequest) -> DataFrame:
        return Traversal(self.graph, request).count_edges()

    def find_path_to(self, request: paths.FindPathToRequest) -> DataFrame:
        return paths.path_rows(self.graph, paths.find_path_to(self.graph, request))

    def find_path_between(self, request: paths.FindPathBetweenRequest) -> DataFrame:
        path = paths.find_path_between(self.graph, request)
        return paths.path_rows(self.graph, path).withColumn("is_midpoint", F.col("pos") == path.midpoint)

    def find_context(self, swhid: str, origin: str | None = None, qualified: bool = True) -> list[str]:
        return paths.find_context(self.graph, swhid, origin, qualified)

    def walk(self, src: str, dst: str, direction: str = "forward", edges: str = "*", limit: int | None = None) -> list[str]:
        """A shortest walk to a node or to the next node of a type; limit cuts it, a negative one to its end."""
        return self._swhids(paths.walk_to(self.graph, src, dst, direction.upper(), edges, limit))

    def random_walk(self, src: str, dst: str, direction: str = "forward", edges: str = "*", limit: int | None = None, seed: int = 0) -> list[str]:
        return self._swhids(paths.random_walk(self.graph, src, dst, direction.upper(), edges, limit, seed))

    def _swhids(self, path: list[int]) -> list[str]:
        names = {r.node_id: r.swhid for r in self.graph.nodes.where(F.col("node_id").isin(*set(path))).select("node_id", "swhid").collect()}
        return [names[n] for n in path]

    def stats(self) -> DataFrame:
        return stats.report(self.graph)

    # derived operators, with the parameters of the web interface

    @staticmethod
    def _request(src: str, direction: str, edges: str, return_types: str, max_edges: int, max_matching_nodes: int) -> TraversalRequest:
        if direction not in ("forward", "backward"):
            raise InvalidArgument(f"unknown direction {direction}")
        Swhid.parse(src)
        types = "*" if "*" in return_types.split(",") else return_types
        return TraversalRequest([src], direction.upper(), edges, max_edges or None, return_nodes=NodeFilter(types), max_matching_nodes=max_matching_nodes)

    def visit_nodes(self, src: str, direction: str = "forward", edges: str = "*", return_types: str = "*", max_edges: int = 0, max_matching_nodes: int = 0) -> DataFrame:
        return self.traverse(self._request(src, direction, edges, return_types, max_edges, max_matching_nodes), "swhid")

    def leaves(self, src: str, direction: str = "forward", edges: str = "*", return_types: str = "*", max_edges: int = 0, max_matching_nodes: int = 0) -> DataFrame:
        return self.traverse(self._leaves(self._request(src, direction, edges, return_types, max_edges, max_matching_nodes)), "swhid")

    def neighbors(self, src: str, direction: str = "forward", edges: str = "*", return_types: str = "*", max_edges: int = 0, max_matching_nodes: int = 0) -> DataFrame:
        return self.traverse(self._near(self._request(src, direction, edges, return_types, max_edges, max_matching_nodes)), "swhid")

    def visit_edges(self, src: str, direction: str = "forward", edges: str = "*", return_types: str = "*", max_edges: int = 0, max_matching_nodes: int = 0) -> DataFrame:
        """src and dst of every arc of the emitted nodes; max_edges limits the nodes, not their arcs."""
        found = Traversal(self.graph, self._request(src, direction, edges, return_types, max_edges, max_matching_nodes)).edges()
        ids = self.graph.nodes.select("node_id", "swhid")
        for end in ("src", "dst"):
            found = found.join(ids.withColumnRenamed("node_id", end).withColumnRenamed("swhid", f"_{end}"), end)
        return found.select(F.col("_src").alias("src"), F.col("_dst").alias("dst"))

    def count_visit_nodes(self, src: str, **more) -> DataFrame:
        return self.count_nodes(self._request(src, **_defaults(more)))

    def count_leaves(self, src: str, **more) -> DataFrame:
        return self.count_nodes(self._leaves(self._request(src, **_defaults(more))))

    def count_neighbors(self, src: str, **more) -> DataFrame:
        return self.count_nodes(self._near(self._request(src, **_defaults(more))))

    @staticmethod
    def _leaves(request: TraversalRequest) -> TraversalRequest:
        return replace(request, return_nodes=replace(request.return_nodes, max_traversal_successors=0))

    @staticmethod
    def _near(request: TraversalRequest) -> TraversalRequest:
        return replace(request, min_depth=1, max_depth=1)


def _defaults(more: dict) -> dict:
    return {"direction": "forward", "edges": "*", "return_types": "*", "max_edges": 0, "max_matching_nodes": 0} | more
