"""Shortest paths: to a node that a filter fits, between two sets of nodes, and qualified identifiers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.functions.identifiers import lossy_text
from arcweave.operators.graph import PropertyGraph
from arcweave.operators.traverse import NodeFilter, source_rows, usable_arcs
from arcweave.parse import InvalidArgument, NotFound, natural, node_types, reverse_edges
from arcweave.plans.frontier import Walk, small
from arcweave.plans.tables import counted, numbered, unsent, written
from arcweave.schema import NODE_TYPES


@dataclass(frozen=True)
class Path:
    """Node ids from first to last; midpoint: place of the node where the two halves of a search met."""

    nodes: list[int]
    midpoint: int | None = None


@dataclass(frozen=True)
class FindPathToRequest:
    src: list[str]
    target: NodeFilter | None = None
    direction: str = "FORWARD"
    edges: str = "*"
    max_edges: int | None = None
    max_depth: int | None = None
    ignore_node: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class FindPathBetweenRequest:
    src: list[str]
    dst: list[str]
    direction: str = "FORWARD"
    direction_reverse: str | None = None
    edges: str = "*"
    edges_reverse: str | None = None
    max_edges: int | None = None
    max_depth: int | None = None
    ignore_node: list[str] = field(default_factory=list)


def _back(walk: Walk, node: int, depth: int) -> list[int]:
    """From a source to node, which is in the layer of that depth: one looked-up row a layer."""
    out = [node]
    for layer in reversed(walk.layers[1 : depth + 1]):
        out.append(layer.where(F.col("node") == out[-1]).select("parent").first()[0])
    return out[::-1]


def _first_match(walk: Walk, layer: DataFrame, matching: DataFrame | None, degrees: DataFrame | None, f: NodeFilter, last: bool) -> int | None:
    rows = layer if matching is None else layer.join(matching, "node", "left_semi")
    if f.min_traversal_successors is not None or f.max_traversal_successors is not None:
        rows = rows.withColumn("n", F.lit(0)) if last else rows.join(degrees, "node", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        rows = rows.where((F.col("n") >= (f.min_traversal_successors or 0)) & (F.col("n") <= (1 << 60 if f.max_traversal_successors is None else f.max_traversal_successors)))
    found = rows.orderBy("rank" if "rank" in rows.columns else "node").select("node").first()
    return found[0] if found else None


def find_path_to(graph: PropertyGraph, request: FindPathToRequest) -> Path:
    """A shortest path from any source to a node that target fits; a source itself may be it.

    Of the nodes of the first layer with one, the first in order of the walk is
    taken. With max_edges only arcs within that budget are walked.
    """
    r = request
    if r.target is None:
        raise InvalidArgument("target is required")
    for name in ("max_edges", "max_depth"):
        natural(getattr(r, name), name)
    types = node_types(r.target.types)
    sources = graph.node_ids(r.src)
    arcs = usable_arcs(graph, r.direction, r.edges, graph.node_ids(r.ignore_node) if r.ignore_node else [])
    matching = None if types is None else graph.nodes.where(F.col("node_type").isin(*types)).select(F.col("node_id").alias("node"))
    degrees = arcs.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"))
    walk = Walk(arcs, source_rows(graph, sources), r.max_edges, mark_sources=True)
    while True:
        depth = len(walk.layers) - 1
        last = r.max_depth is not None and depth >= r.max_depth
        node = _first_match(walk, walk.last, matching, degrees, r.target, last)
        if node is not None:
            return Path(_back(walk, node, depth))
        if last or not walk.step():
            raise NotFound(f"no path to a matching node from {', '.join(r.src[:5])}")


def find_path_between(graph: PropertyGraph, request: FindPathBetweenRequest) -> Path:
    """A shortest path between two sets, walked from both sides, a layer of each in turn.

    With equal directions it leads over a common ancestor or descendant, the
    midpoint. Limits hold for each side. Arc types are given in the direction in
    which their side walks; unset, those of the other side's are the same for equal
    directions, else reversed.
    """
    r = request
    for name in ("max_edges", "max_depth"):
        natural(getattr(r, name), name)
    other = r.direction_reverse or {"FORWARD": "BACKWARD", "BACKWARD": "FORWARD"}.get(r.direction, "")
    back_edges = r.edges_reverse if r.edges_reverse is not None else r.edges if other == r.direction else reverse_edges(r.edges)
    ignored = graph.node_ids(r.ignore_node) if r.ignore_node else []
    starts = (graph.node_ids(r.src), graph.node_ids(r.dst))
    sides = [
        Walk(usable_arcs(graph, d, e, ignored), source_rows(graph, ids), r.max_edges, mark_sources=True)
        for d, e, ids in ((r.direction, r.edges, starts[0]), (other, back_edges, starts[1]))
    ]
    running = [True, True]

    def met(mine: Walk, theirs: Walk) -> tuple[int, int, int] | None:
        """The first node of my last layer that they have found: node, my depth, their depth."""
        near = small(mine.last, mine.nodes).join(theirs.visited().select("node", F.col("depth").alias("theirs")), "node")
        found = near.groupBy("node").agg(F.min("theirs").alias("theirs")).orderBy("theirs", "node").first()
        return None if found is None else (found.node, len(mine.layers) - 1, found.theirs)

    found = met(sides[0], sides[1])
    order = found and (found[0], found[1], found[2])
    while order is None and any(running):
        for me in (0, 1):
            if running[me]:
                deep = len(sides[me].layers) - 1
                running[me] = (r.max_depth is None or deep < r.max_depth) and sides[me].step()
                if running[me] and (found := met(sides[me], sides[1 - me])):
                    node, mine, theirs = found
                    order = (node, mine, theirs) if me == 0 else (node, theirs, mine)
                    break
    if order is None:
        raise NotFound(f"no path between {', '.join(r.src[:5])} and {', '.join(r.dst[:5])}")
    node, a, b = order
    first, second = _back(sides[0], node, a), _back(sides[1], node, b)
    return Path(first + second[::-1][1:], len(first) - 1)


def path_rows(graph: PropertyGraph, path: Path) -> DataFrame:
    """pos, node_id, swhid, node_type, and the labels of the arc to the next node, whichever way it goes; the last has none."""
    steps = graph.spark.createDataFrame(list(zip(range(len(path.nodes)), path.nodes, path.nodes[1:] + [None])), "pos int, node_id bigint, next bigint")
    near = graph.arcs.where(F.col("src").isin(*path.nodes) & F.col("dst").isin(*path.nodes)).select("src", "dst", "labels")
    both = near.union(near.select("dst", "src", "labels")).toDF("a", "b", "labels")
    labels = F.broadcast(steps).join(both, (F.col("node_id") == F.col("a")) & (F.col("next") == F.col("b"))).select("pos", "labels")
    nodes = graph.nodes.where(F.col("node_id").isin(*path.nodes)).select("node_id", "swhid", "node_type")
    return steps.join(nodes, "node_id").join(labels.groupBy("pos").agg(F.first("labels").alias("labels")), "pos", "left").select("pos", "node_id", "swhid", "node_type", "labels").orderBy("pos")


def qualified_swhid(graph: PropertyGraph, path: Path, qualified: bool = True) -> str:
    """Identifier of the path's first node, with where it was seen: origin, visit, anchor and path.

    The path leads back from the object to an origin. The anchor is the first
    revision on it, else the first release; the path is made of the entries' names.
    """
    rows = path_rows(graph, path).collect()
    core = rows[0].swhid
    if not qualified:
        return core
    origin = next((r for r in rows if r.node_type == "ori"), None)
    snapshot = next((r for r in rows if r.node_type == "snp"), None)
    anchor = next((r for r in rows if r.node_type == "rev"), None) or next((r for r in rows if r.node_type == "rel"), None)
    inside = rows[0].node_type in ("cnt", "dir")
    names = [bytes(r.labels[0]["name"]).decode(errors="replace") for r, after in zip(rows, rows[1:]) if r.node_type in ("cnt", "dir") and after.node_type == "dir" and r.labels]
    out = core
    if origin is not None:
        out += ";origin=" + graph.nodes.where(F.col("node_id") == origin.node_id).select("url").first()[0]
    if snapshot is not None and rows[0].pos != snapshot.pos:
        out += f";visit={snapshot.swhid}"
    if inside:
        out += f";anchor={anchor.swhid}" if anchor is not None else ""
        out += ";path=/" + "/".join(reversed(names))
    return out


#: Arc types on which an object's origins are looked for.
CONTEXT_EDGES = "cnt:dir,dir:dir,dir:rev,rev:rev,rev:snp,rev:rel,rel:snp,snp:ori"


def origin_paths(graph: PropertyGraph, swhid: str, restriction: str = CONTEXT_EDGES) -> DataFrame:
    """origin and path (ids from the object to it) of every origin that an object is reached from, each a shortest one.

    One walk back from the object finds all of them; the paths follow its parents,
    a join a layer, for all origins at once.
    """
    walk = Walk(usable_arcs(graph, "BACKWARD", restriction, []), source_rows(graph, graph.node_ids([swhid])), mark_sources=True)
    walk.run(None)
    origins = graph.nodes.where("node_type = 'ori'").select(F.col("node_id").alias("node"))
    found = None
    for layer in reversed(walk.layers):
        ends = layer.join(origins, "node", "left_semi").select(F.col("node").alias("origin"), F.array("node").alias("path"), F.col("parent").alias("next"))
        if found is not None:
            steps = layer.select(F.col("node").alias("next"), F.col("parent").alias("above"))
            ends = ends.unionByName(unsent(found).join(steps, "next").select("origin", F.concat(F.array("next"), "path").alias("path"), F.col("above").alias("next")))
        found = written(ends, "origin-paths")
    return found.select("origin", "path")


def contexts(graph: PropertyGraph, found: DataFrame, qualified: bool = True) -> DataFrame:
    """origin and context, the qualified identifier of each path's first node, for all rows (origin, path) at once; the path ends at the origin."""
    steps = found.select("origin", F.posexplode("path").alias("pos", "node_id"), F.col("path").alias("_p")).withColumn("next", F.get("_p", F.col("pos") + 1)).drop("_p")
    steps = steps.join(graph.nodes.select("node_id", "swhid", "node_type", "url"), "node_id")
    names = graph.arcs.select(F.col("src").alias("next"), F.col("dst").alias("node_id"), F.get(F.col("labels.name"), F.lit(0)).alias("name"))
    steps = steps.join(names, ["node_id", "next"], "left")
    rows = steps.groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("pos", "swhid", "node_type", "url", "name"))).alias("r"))
    first = lambda kind: F.get(F.filter("r", lambda x: x.node_type == kind), F.lit(0))
    core, snapshot, anchor = F.get("r", F.lit(0)), first("snp"), F.coalesce(first("rev"), first("rel"))
    inside = F.filter("r", lambda x, i: x.node_type.isin("cnt", "dir") & (F.get(F.col("r.node_type"), i + 1) == "dir") & x["name"].isNotNull())
    path = F.array_join(F.reverse(F.transform(inside, lambda x: lossy_text(x["name"]))), "/")
    within = F.concat(F.coalesce(F.concat(F.lit(";anchor="), anchor.swhid), F.lit("")), F.lit(";path=/"), path)
    text = F.concat(
        core.swhid, F.coalesce(F.concat(F.lit(";origin="), first("ori").url), F.lit("")),
        F.when(snapshot.isNotNull() & (snapshot.pos > 0), F.concat(F.lit(";visit="), snapshot.swhid)).otherwise(""),
        F.when(core.node_type.isin("cnt", "dir"), within).otherwise(""),
    )
    return rows.select("origin", (text if qualified else core.swhid).alias("context"))


def find_context(graph: PropertyGraph, swhid: str, origin: str | None = None, qualified: bool = True) -> list[str]:
    """Where an object was seen: from one origin ("" for any, a url), or from all ("*").

    Qualified identifiers, else the origins' urls.
    """
    from arcweave.parse import Swhid

    if origin == "*":
        found = origin_paths(graph, swhid)
        if not qualified:
            urls = found.select(F.col("origin").alias("node_id")).join(graph.nodes.select("node_id", "url"), "node_id")
            return [r.url for r in urls.select("url").distinct().orderBy("url").toLocalIterator()]
        return [r.context for r in contexts(graph, found).orderBy("context").toLocalIterator()]
    if not origin:
        path = find_path_to(graph, FindPathToRequest([swhid], NodeFilter("ori"), "BACKWARD"))
    else:
        from hashlib import sha1

        path = find_path_between(graph, FindPathBetweenRequest([swhid], [str(Swhid("ori", sha1(origin.encode()).hexdigest()))], "BACKWARD"))
    if not qualified:
        return [r.url for r in graph.nodes.where((F.col("node_id") == path.nodes[-1]) & F.col("url").isNotNull()).select("url").collect()]
    return [qualified_swhid(graph, path)]


def _cut(path: list[int], limit: int | None) -> list[int]:
    """The whole path, its first nodes, or with a negative limit its last."""
    return path if not limit else path[:limit] if limit > 0 else path[limit:]


def walk_to(graph: PropertyGraph, src: str, dst: str, direction: str = "FORWARD", edges: str = "*", limit: int | None = None) -> list[int]:
    """Ids of a shortest walk from src to a node, or to the next node of a type, cut to limit."""
    if ":" in dst:
        path = find_path_between(graph, FindPathBetweenRequest([src], [dst], direction, edges=edges))
    else:
        path = find_path_to(graph, FindPathToRequest([src], NodeFilter(dst), direction, edges))
    return _cut(path.nodes, limit)


def random_walk(graph: PropertyGraph, src: str, dst: str, direction: str = "FORWARD", edges: str = "*", limit: int | None = None, seed: int = 0, walkers: int = 32, most: int = 1000) -> list[int]:
    """Ids of a random walk from src that ends at a node, or at the first node of a type, cut to limit.

    So many walkers go at once, each on to one of its node's successors, drawn by a
    hash of seed, walker and step; the first to arrive is taken. One that can't go on
    is given up. If none arrives within most steps, there is no such walk.
    """
    (start,) = graph.node_ids([src])
    arcs = usable_arcs(graph, direction, edges, [])
    ends = graph.nodes.where(F.col("node_id") == graph.node_ids([dst])[0]) if ":" in dst else graph.nodes.where(F.col("node_type").isin(*(node_types(dst) or NODE_TYPES)))
    ends = ends.select(F.col("node_id").alias("node"))
    layer = graph.spark.range(walkers).select(F.col("id").alias("walker"), F.lit(start).alias("node"), F.array(F.lit(start)).alias("path"))
    for step in range(most + 1):
        done = layer.join(ends, "node", "left_semi").orderBy("walker").select("path").first()
        if done:
            return _cut(list(done.path), limit)
        drawn = F.min_by("dst", F.xxhash64(F.lit(seed), "walker", F.lit(step), "dst")).alias("to")
        layer = arcs.join(F.broadcast(layer.select("walker", F.col("node").alias("src"))), "src").groupBy("walker").agg(drawn).join(layer, "walker")  # walkers rows at most
        layer, n = counted(layer.select("walker", F.col("to").alias("node"), F.concat("path", F.array("to")).alias("path")), "walkers")
        if not n:
            break
    raise NotFound(f"no walk from {src} to {dst}")


def bfs_order(graph: PropertyGraph, roots: list[str] | None = None) -> DataFrame:
    """node_id and place: an order of all nodes in which what is reached from one root stands together, by depth.

    Roots are those given, in their order, then nodes without predecessors, then
    what is left in cycles, each for itself. A node reached from several belongs to
    the first root that reaches it in the fewest steps. All roots of one of the three
    kinds are walked from at once.
    """
    arcs = graph.arcs.select("src", "dst")
    given = [(n, i) for i, n in enumerate(graph.node_ids(list(roots or [])))]
    reached = graph.transpose().arcs.select(F.col("src").alias("node")).distinct()
    every = graph.nodes.select(F.col("node_id").alias("node"))
    kinds = [
        graph.spark.createDataFrame(given, "node bigint, root bigint").groupBy("node").agg(F.min("root").alias("root")),
        every.join(reached, "node", "left_anti").select("node", F.col("node").alias("root")),
        every.select("node", F.col("node").alias("root")),
    ]
    seen = None
    for kind, layer in enumerate(kinds):
        depth = 0
        while True:
            if seen is not None:
                layer = layer.join(unsent(seen.select("node")), "node", "left_anti")
            layer, n = counted(layer.select("node", F.lit(kind).alias("kind"), "root", F.lit(depth).alias("depth")), "order")
            if n:
                seen = layer if seen is None else seen.union(layer)
            if not n or kind == 2:
                break
            depth += 1
            if depth % 10 == 0:
                seen = written(seen, "order-seen")
            layer = arcs.join(layer.select(F.col("node").alias("src"), "root"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("root").alias("root"))
    return numbered(seen, ["kind", "root", "depth", "node"], "place").select(F.col("node").alias("node_id"), "place")
