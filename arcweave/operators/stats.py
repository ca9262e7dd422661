"""Statistics over whole graphs, and distributions over all roots at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.operators.graph import PropertyGraph
from arcweave.parse import reverse_edges
from arcweave.plans.frontier import small
from arcweave.plans.tables import counted, unsent, written


def nodes_by_type(graph: PropertyGraph) -> DataFrame:
    return graph.nodes.groupBy("node_type").agg(F.count("*").alias("count"))


def arcs_by_type(graph: PropertyGraph) -> DataFrame:
    return graph.arcs.groupBy("src_type", "dst_type").agg(F.count("*").alias("count"))


def degree_stats(graph: PropertyGraph, direction: str = "out") -> DataFrame:
    """min, max and mean degree, nodes without arcs included."""
    d = graph.outdegrees() if direction == "out" else graph.indegrees()
    return d.agg(F.min("degree").alias("min"), F.max("degree").alias("max"), F.avg("degree").alias("avg"))


def degree_distribution(graph: PropertyGraph, direction: str = "out") -> DataFrame:
    d = graph.outdegrees() if direction == "out" else graph.indegrees()
    return d.groupBy("degree").agg(F.count("*").alias("nodes"))


def average_degree(graph: PropertyGraph) -> DataFrame:
    nodes, arcs = graph.nodes.agg(F.count("*").alias("n")), graph.arcs.agg(F.count("*").alias("m"))
    return nodes.crossJoin(arcs).select((F.col("m") / F.col("n")).alias("avg"))  # one row each


def multi_arcs(graph: PropertyGraph) -> DataFrame:
    """Arcs with more than one label."""
    return graph.arcs.where(F.size("labels") > 1).select("src", "dst", F.size("labels").cast("bigint").alias("labels"))


def content_counters(graph: PropertyGraph) -> DataFrame:
    """Nodes by type, and for contents the total length and the longest (the smallest swhid of these)."""
    length = F.coalesce("length", F.lit(0))
    longest = F.max_by("swhid", F.struct(length, -F.col("node_id")))
    return graph.nodes.groupBy("node_type").agg(
        F.count("*").alias("count"), F.sum(F.when(F.col("node_type") == "cnt", length)).alias("total_length"), F.when(F.first("node_type") == "cnt", longest).alias("longest")
    )


def _entries(df: DataFrame, key, value: str) -> DataFrame:
    return df.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value)))).alias("m"))


def report(graph: PropertyGraph, export_started_at: int | None = None, export_ended_at: int | None = None) -> DataFrame:
    """One row: numbers of nodes and arcs, degree statistics, and counts by type as maps. All parts are single rows."""
    n = graph.nodes.agg(F.count("*").alias("num_nodes"))
    m = graph.arcs.agg(F.count("*").alias("num_edges"))
    out = degree_stats(graph).select(*[F.col(c).alias(f"outdegree_{c}") for c in ("min", "max", "avg")])
    into = degree_stats(graph, "in").select(*[F.col(c).alias(f"indegree_{c}") for c in ("min", "max", "avg")])
    by_node = _entries(nodes_by_type(graph), F.col("node_type"), "count").toDF("num_nodes_by_type")
    by_arc = _entries(arcs_by_type(graph), F.concat_ws(":", "src_type", "dst_type"), "count").toDF("num_arcs_by_type")
    one = n.crossJoin(m).crossJoin(out).crossJoin(into).crossJoin(by_node).crossJoin(by_arc)
    return one.withColumn("export_started_at", F.lit(export_started_at).cast("bigint")).withColumn("export_ended_at", F.lit(export_ended_at).cast("bigint"))


def distinct_counts(graph: PropertyGraph) -> DataFrame:
    """One row: how many persons are authors or committers, and how many names labels have."""
    persons = graph.nodes.select(F.explode(F.array("author_id", "committer_id")).alias("p")).agg(F.count_distinct("p").alias("persons"))
    return persons.crossJoin(graph.flat_labels().agg(F.count_distinct("name").alias("label_names")))  # one row each


def count_of_types(graph: PropertyGraph, types: str) -> DataFrame:
    from arcweave.parse import node_types

    kept = node_types(types)
    nodes = graph.nodes if kept is None else graph.nodes.where(F.col("node_type").isin(*kept))
    return nodes.agg(F.count("*").alias("count"))


def _inner_and_last(arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, dst) of arcs to nodes of types that arcs lead on from, and of arcs to types without: only the first need a round after round."""
    on = [r.src_type for r in arcs.select("src_type").distinct().collect()]  # six types at most
    further = F.col("dst_type").isin(*on)
    return arcs.where(further).select("src", "dst"), arcs.where(~further).select("src", "dst")


def reach_counts(graph: PropertyGraph, roots: DataFrame, targets: str, restriction: str = "*", direction: str = "FORWARD", leaves: bool = False, carry: str = "roots") -> DataFrame:
    """For every root (node) at once, how many nodes of these types it reaches: root, count (zeros included).

    The walk carries its start: the root, or with carry "targets" each target, walked
    back from; the answer is the same, and the side from which a node is reached by
    fewer starts costs less. Pairs (start, node) are made distinct in each task before
    they are shuffled. All pairs found are kept until the end, as exact numbers of
    distinct nodes need them: as many rows as the sum of what is reached, in tables of
    the shared folder, not in memory. leaves: count only nodes without usable arcs.
    """
    from arcweave.operators.traverse import oriented
    from arcweave.parse import InvalidArgument, node_types

    if carry not in ("roots", "targets"):
        raise InvalidArgument(f"carry is roots or targets, not {carry}")
    arcs = oriented(graph, direction).with_edges(restriction).arcs
    kept = node_types(targets)
    ends = (graph.nodes if kept is None else graph.nodes.where(F.col("node_type").isin(*kept))).select(F.col("node_id").alias("node"))
    if leaves:
        ends = ends.join(arcs.select(F.col("src").alias("node")).distinct(), "node", "left_anti")
    roots = roots.select("node").distinct()
    back = carry == "targets"
    if back:
        other = {"FORWARD": "BACKWARD", "BACKWARD": "FORWARD"}[direction]
        arcs = oriented(graph, other).with_edges(reverse_edges(restriction)).arcs
    seen = written((ends if back else roots).select(F.col("node").alias("start"), "node"), "reach")
    layer, rounds, n = seen, 0, None
    inner, last = _inner_and_last(arcs)

    def reached(arcs: DataFrame, layer: DataFrame, n: int | None) -> DataFrame:
        near = layer.withColumnRenamed("node", "src")
        return arcs.join(unsent(near) if n is None else small(near, n), "src").select("start", F.col("dst").alias("node")).distinct()

    while True:
        layer, n = counted(reached(inner, layer, n).join(unsent(seen), ["start", "node"], "left_anti"), "reach")
        if not n:
            break
        seen, rounds = seen.union(layer), rounds + 1
        if rounds % 10 == 0:
            seen = written(seen, "reach")
    seen = seen.union(written(reached(last, seen, None), "reach"))  # no node of these types is in seen, but for a start, which has no arcs to itself
    found = unsent(seen).join(roots if back else ends, "node", "left_semi")
    n = found.groupBy(F.col("node" if back else "start").alias("root")).agg(F.count("*").alias("count"))
    return roots.select(F.col("node").alias("root")).join(n, "root", "left").select("root", F.coalesce("count", F.lit(0)).alias("count"))


def earliest_revisions(graph: PropertyGraph, objects: DataFrame) -> DataFrame:
    """For every object (node), the revision among its ancestors of the least committer_ts, ties to the smaller id: node, revision, committer_ts.

    Each revision's date flows down with the walk; a node keeps the least that
    reached it, so only one pair a node is moved in a round, whatever its ancestors.
    """
    best = F.min(F.struct("committer_ts", "revision")).alias("best")
    layer = graph.nodes.where("node_type = 'rev' and committer_ts is not null").select(F.col("node_id").alias("node"), "committer_ts", F.col("node_id").alias("revision"))
    known = layer = written(layer, "earliest")
    inner, last = _inner_and_last(graph.arcs)
    down = lambda arcs, layer: arcs.join(unsent(layer.withColumnRenamed("node", "src")), "src").groupBy(F.col("dst").alias("node")).agg(best).select("node", "best.*")
    while True:
        moved = down(inner, layer)
        old = known.select("node", F.struct("committer_ts", "revision").alias("old"))
        better = moved.join(unsent(old), "node", "left").where(F.col("old").isNull() | (F.struct("committer_ts", "revision") < F.col("old"))).drop("old")
        layer = written(better, "earliest")
        if layer.isEmpty():
            break
        known = written(known.unionByName(layer).groupBy("node").agg(best).select("node", "best.*"), "earliest")
    known = known.unionByName(down(last, known)).groupBy("node").agg(best).select("node", "best.*")
    return objects.select("node").join(unsent(known), "node").select("node", "revision", "committer_ts")


def shared_root_forks(graph: PropertyGraph, swhid: str) -> DataFrame:
    """Origins that share a root revision with an object: forward to revisions without parents, back to origins."""
    from arcweave.operators.traverse import source_rows, usable_arcs
    from arcweave.plans.frontier import Walk

    start = graph.node_ids([swhid])
    forward = Walk(usable_arcs(graph, "FORWARD", "ori:snp,snp:rev,snp:rel,rel:rev,rel:rel,rev:rev", []), source_rows(graph, start), mark_sources=True).run(None)
    parents = graph.arcs.where("src_type = 'rev' and dst_type = 'rev'").select(F.col("src").alias("node"))
    roots = forward.join(graph.nodes.where("node_type = 'rev'").select(F.col("node_id").alias("node")), "node", "left_semi").join(parents, "node", "left_anti").select("node")
    back = Walk(usable_arcs(graph, "BACKWARD", "rev:rev,rev:snp,rev:rel,rel:rel,rel:snp,snp:ori", []), roots, mark_sources=True).run(None)
    return back.join(graph.nodes.where("node_type = 'ori'").select(F.col("node_id").alias("node"), "swhid"), "node").select("node", "swhid").distinct()
