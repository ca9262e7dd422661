"""Registered graph queries over the star schema, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.api import GraphService
from arcweave.functions import identifiers as fn
from arcweave.operators import extract, paths, stats
from arcweave.operators.graph import PropertyGraph
from arcweave.operators.traverse import NodeFilter, Traversal, TraversalRequest, closure
from arcweave.parse import NotFound
from arcweave.plans.tables import numbered
from arcweave.schema import LABEL_DDL, LEGAL_ARCS
from arcweave.sources import example
from arcweave.sources.commerce import stored_graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def query(sql: str | None = None):
    """Registers a function of the graph, and SQL on the views nodes and arcs."""

    def add(f: Callable[[PropertyGraph], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(stored_graph(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = VIEWS + sql
        return f

    return add


_ID = {t: f"{c}000000000" for t, c in (("cnt", 0), ("dir", 1), ("ori", 2), ("rel", 3), ("rev", 4), ("snp", 5))}


def _node(kind: str, table: str, key: str, more: str = "NULL::BIGINT AS length, NULL::BIGINT AS committer_ts") -> str:
    return f"SELECT CAST({_ID[kind]} + {key} AS BIGINT) AS node_id, '{kind}' AS node_type, 'swh:1:{kind}:' || sha1('{table}:' || CAST({key} AS VARCHAR)) AS swhid, {more} FROM {table}"


_NONE = "NULL::VARCHAR AS name, NULL::INTEGER AS permission, NULL::BIGINT AS visit_timestamp, NULL::BOOLEAN AS is_full_visit, NULL::VARCHAR AS visit_type"


def _arc(kinds: str, table: str, src: str, dst: str, label: str = _NONE) -> str:
    a, b = kinds.split(":")
    return f"SELECT CAST({_ID[a]} + {src} AS BIGINT) AS src, CAST({_ID[b]} + {dst} AS BIGINT) AS dst, '{a}' AS src_type, '{b}' AS dst_type, {label} FROM {table}"


def _named(name: str, permission: str = "NULL::INTEGER") -> str:
    return f"CAST({name} AS VARCHAR) AS name, {permission} AS permission, NULL::BIGINT AS visit_timestamp, NULL::BOOLEAN AS is_full_visit, NULL::VARCHAR AS visit_type"


#: The graph as SQL: nodes, label rows (a row for each parallel arc), distinct arcs.
VIEWS = f"""
WITH RECURSIVE firsts AS (SELECT o_custkey, (MIN(o_orderdate)::DATE - DATE '1970-01-01') * 86400 AS t FROM orders GROUP BY 1),
chain AS (SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders),
nodes AS (
  {_node("ori", "region", "r_regionkey")} UNION ALL {_node("snp", "nation", "n_nationkey")} UNION ALL {_node("rel", "supplier", "s_suppkey")}
  UNION ALL SELECT n.* REPLACE (CAST(t AS BIGINT) AS committer_ts) FROM ({_node("rev", "customer", "c_custkey")}) n LEFT JOIN firsts ON n.node_id = {_ID["rev"]} + o_custkey
  UNION ALL {_node("dir", "orders", "o_orderkey")} UNION ALL {_node("cnt", "part", "p_partkey", "CAST(p_size AS BIGINT) AS length, NULL::BIGINT AS committer_ts")}),
label_rows AS (
  {_arc("ori:snp", "nation", "n_regionkey", "n_nationkey", "NULL::VARCHAR AS name, NULL::INTEGER AS permission, CAST(1000000000 + n_nationkey AS BIGINT) AS visit_timestamp, n_nationkey % 2 = 0 AS is_full_visit, 'vcs' AS visit_type")}
  UNION ALL {_arc("snp:rev", "customer", "c_nationkey", "c_custkey", _named("c_name"))} UNION ALL {_arc("snp:rel", "supplier", "s_nationkey", "s_suppkey", _named("s_name"))}
  UNION ALL {_arc("rev:dir", "orders", "o_custkey", "o_orderkey")} UNION ALL {_arc("dir:dir", "(SELECT * FROM chain WHERE nxt IS NOT NULL)", "o_orderkey", "nxt")}
  UNION ALL {_arc("dir:cnt", "lineitem", "l_orderkey", "l_partkey", _named("l_linenumber", "CASE WHEN l_linestatus = 'O' THEN 33188 ELSE 33261 END"))} UNION ALL {_arc("rel:cnt", "lineitem", "l_suppkey", "l_partkey")}),
arcs AS (SELECT DISTINCT src, dst, src_type, dst_type FROM label_rows)
"""

CUSTOMER, CUSTOMERS, NATION, REGION, PART, ORDER, SUPPLIER = 4_000_000_007, (4_000_000_001, 4_000_000_002, 4_000_000_003), 5_000_000_003, 2_000_000_001, 10, 1_000_000_005, 3_000_000_004


def _swhid(table: str, kind: str, key: int) -> str:
    from hashlib import sha1

    return f"swh:1:{kind}:" + sha1(f"{table}:{key}".encode()).hexdigest()


CUSTOMER_ID, NATION_ID, REGION_ID, PART_ID, ORDER_ID = _swhid("customer", "rev", 7), _swhid("nation", "snp", 3), _swhid("region", "ori", 1), _swhid("part", "cnt", 10), _swhid("orders", "dir", 5)


def reach(starts: str, where: str = "TRUE", backward: bool = False, depth: int | None = None) -> str:
    """More views: walk (node, depth) by depth if bounded, else the set walk (node) reached by one arc or more."""
    s, d = ("dst", "src") if backward else ("src", "dst")
    if depth is None:
        return f", step AS (SELECT {s} AS s, {d} AS d FROM arcs WHERE {where}), walk AS (SELECT d AS node FROM step WHERE s IN ({starts}) UNION SELECT d FROM walk JOIN step ON node = s)"
    return f", step AS (SELECT {s} AS s, {d} AS d FROM arcs WHERE {where}), walk AS (SELECT node_id AS node, 0 AS depth FROM nodes WHERE node_id IN ({starts}) UNION SELECT d, depth + 1 FROM walk JOIN step ON node = s WHERE depth < {depth})"


def types_sql(edges: str) -> str:
    return "(" + " OR ".join("(src_type = '{}' AND dst_type = '{}')".format(*e.split(":")) for e in edges.split(",")) + ")"


def _traversal(g: PropertyGraph, **request) -> Traversal:
    return Traversal(g, TraversalRequest(**request))


def _swhids(g: PropertyGraph, nodes: DataFrame) -> DataFrame:
    return nodes.join(g.nodes.select(F.col("node_id").alias("node"), "swhid"), "node").select("swhid")


_BOTH = "SELECT swhid FROM nodes JOIN (SELECT node FROM walk UNION ALL SELECT node_id FROM nodes WHERE node_id IN ({0})) r ON node = node_id"

# static algebra


@query("SELECT node_type, count(*) AS count FROM nodes GROUP BY 1")
def nodes_by_type(g):
    return stats.nodes_by_type(g)


@query("SELECT src_type, dst_type, count(*) AS count FROM arcs GROUP BY 1, 2")
def arcs_by_type(g):
    return stats.arcs_by_type(g)


@query("SELECT src_type, dst_type, count(*) AS count FROM label_rows GROUP BY 1, 2")
def label_rows_by_type(g):
    return g.arcs.groupBy("src_type", "dst_type").agg(F.sum(F.greatest(F.size("labels"), F.lit(1))).alias("count")).where("src_type <> 'rel'").unionByName(
        g.arcs.where("src_type = 'rel'").groupBy("src_type", "dst_type").agg(F.count("*").alias("count"))
    )


ORACLES["label_rows_by_type"] = VIEWS + "SELECT src_type, dst_type, count(*) AS count FROM label_rows WHERE src_type <> 'rel' GROUP BY 1, 2 UNION ALL SELECT src_type, dst_type, count(*) FROM arcs WHERE src_type = 'rel' GROUP BY 1, 2"

_DEGREES = ", degrees AS (SELECT node_id, node_type, count(src) AS degree FROM nodes LEFT JOIN {0} ON node_id = src GROUP BY 1, 2)"
_IN = "(SELECT dst AS src FROM arcs)"


@query(_DEGREES.format("arcs") + "SELECT min(degree) AS min, max(degree) AS max, round(avg(degree), 9) AS avg FROM degrees")
def degree_stats_out(g):
    return stats.degree_stats(g).withColumn("avg", F.round("avg", 9))


@query(_DEGREES.format(_IN) + "SELECT min(degree) AS min, max(degree) AS max, round(avg(degree), 9) AS avg FROM degrees")
def degree_stats_in(g):
    return stats.degree_stats(g, "in").withColumn("avg", F.round("avg", 9))


@query(_DEGREES.format("arcs") + "SELECT degree, count(*) AS nodes FROM degrees GROUP BY 1")
def degree_distribution_out(g):
    return stats.degree_distribution(g)


@query(_DEGREES.format(_IN) + "SELECT degree, count(*) AS nodes FROM degrees GROUP BY 1")
def degree_distribution_in(g):
    return stats.degree_distribution(g, "in")


@query("SELECT round((SELECT count(*) FROM arcs) / (SELECT count(*) FROM nodes), 9) AS avg")
def average_degree(g):
    return stats.average_degree(g).select(F.round("avg", 9).alias("avg"))


@query("SELECT src, dst, count(*) AS labels FROM label_rows WHERE name IS NOT NULL OR visit_timestamp IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def multi_arcs(g):
    return stats.multi_arcs(g)


@query("SELECT src, dst, src_type, dst_type, name, permission, visit_timestamp, is_full_visit, visit_type FROM label_rows WHERE name IS NOT NULL OR visit_timestamp IS NOT NULL")
def flat_labels(g):
    return g.flat_labels().withColumn("name", F.col("name").cast("string"))


@query("SELECT DISTINCT CAST(row_number() OVER (ORDER BY name) - 1 AS BIGINT) AS label_name_id, name FROM (SELECT DISTINCT name FROM label_rows WHERE name IS NOT NULL)")
def label_names(g):
    return g.label_names().select("label_name_id", F.col("name").cast("string").alias("name"))


@query(f"SELECT dst AS node_id FROM arcs WHERE src = {ORDER}")
def successors_of_order(g):
    return g.successors(ORDER)


@query(f"SELECT src AS node_id FROM arcs WHERE dst = {PART}")
def predecessors_of_part(g):
    return g.predecessors(PART)


@query(f"SELECT dst AS node_id, name, permission FROM label_rows WHERE src = {ORDER} AND name IS NOT NULL")
def labelled_successors_of_order(g):
    return g.labelled_successors(ORDER).select("node_id", F.explode("labels").alias("l")).select("node_id", F.col("l.name").cast("string").alias("name"), "l.permission")


@query("SELECT n.node_id, n.swhid FROM nodes n WHERE n.node_type IN ('rev', 'rel')")
def node_ids_of_types(g):
    return g.with_types("rev,rel").nodes.select("node_id", "swhid")


@query(f"SELECT count(*) > 0 AS found FROM arcs WHERE src = {REGION} AND dst = {NATION}")
def has_arc(g):
    return g.spark.createDataFrame([(g.has_arc(REGION, NATION),)], "found boolean")


@query("SELECT src, dst FROM arcs WHERE src_type IN ('dir', 'cnt') AND dst_type IN ('dir', 'cnt')")
def subgraph_types(g):
    return g.with_types("cnt,dir").arcs.select("src", "dst")


@query("SELECT a.src, a.dst FROM arcs a JOIN nodes s ON s.node_id = a.src JOIN nodes d ON d.node_id = a.dst WHERE coalesce(s.length, 99) > 25 AND coalesce(d.length, 99) > 25 AND (a.src + a.dst) % 3 = 0")
def subgraph_filters(g):
    return g.subgraph(F.coalesce("length", F.lit(99)) > 25, (F.col("src") + F.col("dst")) % 3 == 0).arcs.select("src", "dst")


@query("SELECT dst_type AS src_type, src_type AS dst_type, count(*) AS count FROM arcs GROUP BY 1, 2")
def transposed_arcs_by_type(g):
    return stats.arcs_by_type(g.transpose())


@query(", new AS (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS n FROM nodes WHERE node_type IN ('dir', 'rev')) SELECT a.n AS src, b.n AS dst FROM arcs JOIN new a ON a.node_id = src JOIN new b ON b.node_id = dst")
def contiguous_ids(g):
    return g.with_types("dir,rev").contiguous().arcs.select("src", "dst")


@query(", s AS (SELECT src, dst FROM arcs UNION SELECT dst, src FROM arcs), n AS (SELECT src, count(*) AS degree FROM s GROUP BY 1) SELECT degree, count(*) AS nodes FROM n GROUP BY 1")
def symmetric_degrees(g):
    return g.symmetric().groupBy("src").agg(F.count("*").alias("degree")).groupBy("degree").agg(F.count("*").alias("nodes"))


@query("SELECT 'left' AS side, 'arc' AS kind, count(*) AS n FROM arcs WHERE dst_type = 'cnt' AND dst % 10 = 0 HAVING count(*) > 0 UNION ALL SELECT 'left', 'node', count(*) FROM nodes WHERE node_type = 'cnt' AND node_id % 10 = 0 HAVING count(*) > 0")
def graph_difference(g):
    other = g.subgraph(~((F.col("node_type") == "cnt") & (F.col("node_id") % 10 == 0)))
    return g.difference(other).groupBy("side", "kind").agg(F.count("*").alias("n"))


@query("SELECT node_type, count(*) AS count, sum(CASE WHEN node_type = 'cnt' THEN coalesce(length, 0) END)::BIGINT AS total_length, CASE WHEN node_type = 'cnt' THEN arg_max(swhid, coalesce(length, 0) * 1000000000000 - node_id) END AS longest FROM nodes GROUP BY node_type")
def content_counters(g):
    return stats.content_counters(g)


@query("SELECT count(*) AS count FROM nodes WHERE node_type IN ('cnt', 'dir')")
def count_of_types(g):
    return stats.count_of_types(g, "cnt,dir")


_REPORT = ", o AS (SELECT node_id, count(src) AS degree FROM nodes LEFT JOIN arcs ON node_id = src GROUP BY 1), i AS (SELECT node_id, count(dst) AS degree FROM nodes LEFT JOIN arcs ON node_id = dst GROUP BY 1)"
_ENTRIES = "(SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM (SELECT {0} AS k, count(*) AS n FROM {1} GROUP BY 1))"


@query(
    _REPORT + "SELECT (SELECT count(*) FROM nodes) AS num_nodes, (SELECT count(*) FROM arcs) AS num_edges, "
    + ", ".join(f"(SELECT {f}(degree) FROM {t}) AS {name}_{f}" for t, name in (("o", "outdegree"), ("i", "indegree")) for f in ("min", "max"))
    + ", (SELECT round(avg(degree), 9) FROM o) AS outdegree_avg, (SELECT round(avg(degree), 9) FROM i) AS indegree_avg, "
    + _ENTRIES.format("node_type", "nodes") + " AS num_nodes_by_type, " + _ENTRIES.format("src_type || ':' || dst_type", "arcs") + " AS num_arcs_by_type, 1::BIGINT AS export_started_at, 2::BIGINT AS export_ended_at"
)
def stats_report(g):
    entries = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias(c)
    r = stats.report(g, 1, 2)
    return r.select(*[F.round(c, 9).alias(c) if c.endswith("_avg") else entries(c) if c.endswith("_by_type") else c for c in r.columns])


@query("SELECT * FROM (VALUES ('loops', (SELECT count(*) FROM nodes WHERE node_type = 'rel')), ('illegal arcs', (SELECT count(*) FROM nodes WHERE node_type = 'snp')), ('repeated ids', (SELECT count(*) FROM nodes WHERE node_type = 'ori')), ('ends without node', (SELECT count(*) FROM nodes WHERE node_type = 'snp'))) t(problem, n)")
def build_problems(g):
    """Of a graph with planted faults: loops at releases, arcs from snapshots to ids that are none, of types that aren't legal, and origins that stand twice."""
    empty = F.array().cast(f"array<{LABEL_DDL}>").alias("labels")
    loops = g.nodes.where("node_type = 'rel'").select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.col("node_type").alias("src_type"), F.col("node_type").alias("dst_type"), empty)
    lost = g.nodes.where("node_type = 'snp'").select(F.col("node_id").alias("src"), (-F.col("node_id")).alias("dst"), F.col("node_type").alias("src_type"), F.lit("ori").alias("dst_type"), empty)
    faulty = PropertyGraph(g.nodes.unionByName(g.nodes.where("node_type = 'ori'")), g.arcs.unionByName(loops).unionByName(lost))
    return extract.problems(faulty, LEGAL_ARCS)


@query("SELECT 'x' AS problem, count(*) AS n FROM arcs WHERE src = dst OR (src_type || ':' || dst_type) NOT IN (" + ", ".join(f"'{a}'" for a in LEGAL_ARCS) + ") HAVING count(*) > 0")
def build_without_problems(g):
    return extract.problems(g, LEGAL_ARCS)


@query("SELECT node_id, swhid, 'swh:1:' || node_type AS prefix, true AS valid, lower(hex(unhex(substr(swhid, 11)))) AS digest FROM nodes")
def identifiers(g):
    back = fn.swhid_of_bytes(fn.swhid_bytes(F.col("swhid")))
    return g.nodes.select("node_id", back.alias("swhid"), F.concat(F.lit("swh:1:"), fn.type_name(fn.type_code(F.col("node_type")))).alias("prefix"), fn.is_swhid(F.col("swhid")).alias("valid"), fn.swhid_hash(F.col("swhid")).alias("digest"))


@query("SELECT 'swh:1:cnt:' || sha1('nothing:' || CAST(p_partkey AS VARCHAR)) AS swhid FROM part WHERE p_partkey % 3 = 0")
def unknown_identifiers(g):
    """Of a list of parts, a third of which have names that nothing in the graph has."""
    made = F.when(F.col("node_id") % 3 == 0, fn.swhid("cnt", F.sha1(F.concat(F.lit("nothing:"), F.col("node_id").cast("string")).cast("binary")))).otherwise(F.col("swhid"))
    return g.unknown(g.with_types("cnt").nodes.select(made.alias("swhid")))


@query(f", kept AS (SELECT dst AS k FROM arcs WHERE src = {NATION} UNION ALL SELECT dst FROM arcs WHERE src IN (SELECT dst FROM arcs WHERE src = {NATION}) AND src_type = 'rev') SELECT DISTINCT src, dst FROM arcs WHERE src IN (SELECT k FROM kept) AND dst IN (SELECT k FROM kept)")
def subset_restriction(g):
    """To the customers and suppliers of a nation and the customers' orders, by their identifiers."""
    near = g.successors(NATION)
    orders = g.with_edges("rev:dir").arcs.join(near.withColumnRenamed("node_id", "src"), "src").select(F.col("dst").alias("node_id"))
    return g.only(g.nodes.join(near.union(orders), "node_id", "left_semi")).arcs.select("src", "dst")


@query("SELECT (SELECT count(DISTINCT name) FROM label_rows) AS label_names, 0::BIGINT AS persons")
def distinct_counts(g):
    return stats.distinct_counts(g)


# traversals


@query(reach(str(CUSTOMER), types_sql("rev:dir,dir:dir,dir:cnt")) + "SELECT swhid FROM walk JOIN nodes ON node = node_id WHERE node_type = 'cnt'")
def traverse_customer_parts(g):
    t = _traversal(g, src=[CUSTOMER_ID], edges="rev:dir,dir:dir,dir:cnt", return_nodes=NodeFilter("cnt"))
    return _swhids(g, t.nodes())


@query(reach(str(PART), backward=True) + _BOTH.format(PART))
def traverse_part_backward(g):
    return _swhids(g, _traversal(g, src=[PART_ID], direction="BACKWARD").nodes())


@query(reach(str(NATION)) + "SELECT count(*) + 1 AS count FROM walk")
def count_nodes_nation(g):
    return _traversal(g, src=[NATION_ID]).count_nodes()


@query(reach(str(NATION)) + f"SELECT count(*) AS count FROM step WHERE s IN (SELECT node FROM walk) OR s = {NATION}")
def count_edges_nation(g):
    return _traversal(g, src=[NATION_ID]).count_edges()


@query(reach(str(REGION), "src_type <> 'dir' AND dst_type <> 'dir'") + "SELECT count(*) + 1 AS count FROM walk")
def count_nodes_region_unrolled(g):
    return _traversal(g, src=[REGION_ID], edges="ori:snp,snp:rev,snp:rel,rel:cnt").count_nodes()


@query(f"SELECT swhid FROM arcs JOIN nodes ON node_id = dst WHERE src = {ORDER}")
def neighbors_forward(g):
    return GraphService(g).neighbors(ORDER_ID)


@query(f"SELECT swhid FROM arcs JOIN nodes ON node_id = src WHERE dst = {PART} AND src_type = 'rel'")
def neighbors_backward(g):
    return GraphService(g).neighbors(PART_ID, "backward", "cnt:rel")


@query(f"SELECT count(*) AS count FROM arcs WHERE src = {NATION}")
def count_neighbors(g):
    return GraphService(g).count_neighbors(NATION_ID)


@query(reach(str(CUSTOMER)) + "SELECT swhid FROM walk JOIN nodes ON node = node_id WHERE node NOT IN (SELECT s FROM step)")
def leaves_forward(g):
    return GraphService(g).leaves(CUSTOMER_ID)


@query(reach(str(PART), backward=True) + "SELECT swhid FROM walk JOIN nodes ON node = node_id WHERE node NOT IN (SELECT s FROM step) AND node_type = 'ori'")
def leaves_backward(g):
    return GraphService(g).leaves(PART_ID, "backward", return_types="ori")


@query(reach(str(NATION), types_sql("snp:rev,rev:dir")) + f"SELECT count(*) AS count FROM walk WHERE node NOT IN (SELECT s FROM step)")
def count_leaves(g):
    return GraphService(g).count_leaves(NATION_ID, edges="snp:rev,rev:dir")


@query(reach(str(CUSTOMER)) + f"SELECT a.swhid AS src, b.swhid AS dst FROM step JOIN nodes a ON a.node_id = s JOIN nodes b ON b.node_id = d WHERE s IN (SELECT node FROM walk) OR s = {CUSTOMER}")
def visit_edges(g):
    return GraphService(g).visit_edges(CUSTOMER_ID)


@query(reach(str(NATION), depth=2) + "SELECT node, min(depth) AS depth FROM walk GROUP BY node")
def max_depth_two(g):
    return _traversal(g, src=[NATION_ID], max_depth=2).nodes()


@query(reach(str(CUSTOMER), types_sql("rev:dir,dir:dir"), depth=100_000) + "SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY node HAVING min(depth) >= 1")
def depths_of_orders(g):
    return _traversal(g, src=[CUSTOMER_ID], edges="rev:dir,dir:dir", min_depth=1).nodes()


@query(reach(f"{ORDER}", types_sql("dir:dir"), depth=100_000) + "SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY node")
def order_chain(g):
    return _traversal(g, src=[ORDER_ID], edges="dir:dir").nodes()


@query(reach(str(CUSTOMER), types_sql("rev:dir,dir:dir,dir:cnt") + " AND dst <> 10 AND dst <> 20") + _BOTH.format(CUSTOMER))
def ignored_nodes(g):
    return _swhids(g, _traversal(g, src=[CUSTOMER_ID], edges="rev:dir,dir:dir,dir:cnt", ignore_node=[PART_ID, _swhid("part", "cnt", 20)]).nodes())


@query(reach(", ".join(map(str, CUSTOMERS)), types_sql("rev:dir,dir:cnt")) + _BOTH.format(", ".join(map(str, CUSTOMERS))))
def multi_source(g):
    return _swhids(g, _traversal(g, src=[_swhid("customer", "rev", k) for k in (1, 2, 3)], edges="rev:dir,dir:cnt").nodes())


@query(reach(str(PART), backward=True) + "SELECT swhid FROM walk JOIN nodes ON node = node_id WHERE node_type = 'ori'")
def origins_of_part(g):
    return _swhids(g, _traversal(g, src=[PART_ID], direction="BACKWARD", return_nodes=NodeFilter("ori")).nodes())


@query(reach(str(NATION), types_sql("snp:rev,rev:dir")) + ", n AS (SELECT s, count(*) AS c FROM step GROUP BY s) SELECT swhid FROM walk JOIN nodes ON node = node_id JOIN n ON s = node WHERE c BETWEEN 5 AND 12")
def successors_between(g):
    return _swhids(g, _traversal(g, src=[NATION_ID], edges="snp:rev,rev:dir", return_nodes=NodeFilter("rev", 5, 12)).nodes())


@query("SELECT least(count(*), 40) AS count FROM arcs WHERE src = " + str(NATION))
def limited_edges(g):
    return _traversal(g, src=[NATION_ID], edges="snp:rev,snp:rel", max_edges=40).count_edges()


@query(f", o AS (SELECT dst AS node FROM arcs WHERE src = {NATION} ORDER BY dst LIMIT 9) SELECT node_id AS node FROM nodes WHERE node_id = {NATION} OR node_id IN (SELECT node FROM o)")
def limited_nodes(g):
    return _traversal(g, src=[NATION_ID], edges="snp:rev,snp:rel", max_matching_nodes=10).nodes().select("node")


@query(reach(str(CUSTOMER), types_sql("rev:dir,dir:dir")) + ", n AS (SELECT src, count(*) AS c FROM arcs WHERE src_type = 'dir' GROUP BY 1) SELECT swhid, coalesce(c, 0) AS num_successors FROM walk JOIN nodes ON node = node_id LEFT JOIN n ON src = node_id WHERE node_type = 'dir'")
def described_nodes(g):
    t = _traversal(g, src=[CUSTOMER_ID], edges="rev:dir,dir:dir", return_nodes=NodeFilter("dir"))
    return GraphService(g).described(t.nodes(), "swhid,num_successors").select("swhid", "num_successors")


@query(f", o AS (SELECT dst FROM arcs WHERE src = {ORDER}) SELECT swhid, length FROM nodes JOIN o ON dst = node_id WHERE node_type = 'cnt'")
def described_contents(g):
    t = _traversal(g, src=[ORDER_ID], edges="dir:cnt", return_nodes=NodeFilter("cnt"))
    return GraphService(g).described(t.nodes(), "swhid,cnt.length").select("swhid", "cnt.length")


@query(f"SELECT a.swhid, b.swhid AS successor, CAST(list(name ORDER BY name) AS VARCHAR[])[1] AS first_label FROM label_rows r JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst WHERE src = {ORDER} AND dst_type = 'cnt' GROUP BY 1, 2")
def node_with_successors(g):
    node = GraphService(g.with_edges("dir:cnt")).get_node(ORDER_ID, "successor.swhid,successor.label.name,num_successors")
    return node.select("swhid", F.explode("successor").alias("s")).select("swhid", F.col("s.swhid").alias("successor"), F.element_at("s.label", 1)["name"].cast("string").alias("first_label"))


@query(reach(str(REGION)) + "SELECT node AS node_id FROM walk UNION SELECT " + str(REGION))
def closure_of_origin(g):
    urls = g.nodes.where(F.col("node_id") == REGION).select("url")
    renamed = PropertyGraph(g.nodes.withColumn("swhid", F.when(F.col("node_type") == "ori", fn.origin_swhid(F.col("url"))).otherwise(F.col("swhid"))), g.arcs)
    return closure(renamed, urls)[0].nodes.select("node_id")


# paths

#: After reach() with a depth: the least depth of each node, its parent of the least id, and back() of one end to the start.
_TREE = ", near AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node), up AS (SELECT b.node, b.depth, min(a.node) AS parent FROM near b JOIN step ON d = b.node JOIN near a ON a.node = s AND a.depth = b.depth - 1 GROUP BY 1, 2)"


def _back(ends: str) -> str:
    return _TREE + f", back AS (SELECT node, depth FROM ({ends}) UNION ALL SELECT parent, depth - 1 FROM back JOIN up USING (node, depth))"


#: back as rows of a path: place, node and first label of the arc to the next node.
_PATH = (
    ", names AS (SELECT src AS a, dst AS b, min(name) AS name FROM label_rows GROUP BY 1, 2), both_ways AS (SELECT a, b, name FROM names UNION ALL SELECT b, a, name FROM names)"
    " SELECT CAST(x.depth AS INTEGER) AS pos, swhid, name FROM back x JOIN nodes ON node_id = x.node LEFT JOIN back y ON y.depth = x.depth + 1 LEFT JOIN both_ways ON a = x.node AND b = y.node"
)


def _path(g: PropertyGraph, p: paths.Path) -> DataFrame:
    return paths.path_rows(g, p).select("pos", "swhid", F.get(F.col("labels.name"), F.lit(0)).cast("string").alias("name"))


@query(reach(str(PART), backward=True, depth=4) + _back("SELECT node, depth FROM near JOIN nodes ON node = node_id WHERE node_type = 'ori' ORDER BY depth, node LIMIT 1") + _PATH)
def shortest_path_to_origin(g):
    return _path(g, paths.find_path_to(g, paths.FindPathToRequest([PART_ID], NodeFilter("ori"), "BACKWARD")))


@query(reach(str(ORDER), backward=True, depth=4) + _back("SELECT node, depth FROM near JOIN nodes ON node = node_id WHERE node_type = 'ori' ORDER BY depth, node LIMIT 1") + _PATH)
def shortest_path_between(g):
    """From an order to any region, over its customer and nation: of this length there is one path."""
    regions = [_swhid("region", "ori", k) for k in range(5)]
    return _path(g, paths.find_path_between(g, paths.FindPathBetweenRequest([ORDER_ID], regions, "BACKWARD")))


@query(f", n AS (SELECT src AS nation FROM arcs WHERE dst = {CUSTOMER} AND src_type = 'snp'), o AS (SELECT min(dst) AS other FROM arcs JOIN n ON src = nation WHERE dst_type = 'rev' AND dst <> {CUSTOMER}), r AS (SELECT 0 AS pos, CAST({CUSTOMER} AS BIGINT) AS node FROM o WHERE other IS NOT NULL UNION ALL SELECT 1, nation FROM n, o WHERE other IS NOT NULL UNION ALL SELECT 2, other FROM o WHERE other IS NOT NULL) SELECT CAST(pos AS INTEGER) AS pos, swhid, pos = 1 AS is_midpoint FROM r JOIN nodes ON node_id = node")
def common_ancestor(g):
    """Of one customer and the first other one of its nation."""
    nation = g.predecessors(CUSTOMER).where(F.col("node_id") >= 5 * 10**9)
    other = g.arcs.where("dst_type = 'rev'").join(nation, F.col("src") == F.col("node_id")).where(F.col("dst") != CUSTOMER).agg(F.min("dst").alias("node_id"))
    ids = [r.swhid for r in g.nodes.join(other, "node_id").select("swhid").collect()]
    request = paths.FindPathBetweenRequest([CUSTOMER_ID], ids, "BACKWARD", "BACKWARD")
    return GraphService(g).find_path_between(request).select("pos", "swhid", "is_midpoint")


@query("SELECT 'none' AS found")
def no_path(g):
    """Parts have no arcs of their own: what isn't found is an error."""
    try:
        paths.find_path_between(g, paths.FindPathBetweenRequest([PART_ID], [REGION_ID]))
    except NotFound:
        return g.spark.createDataFrame([("none",)], "found string")
    return g.spark.createDataFrame([("a path",)], "found string")


@query(reach(str(ORDER), backward=True) + "SELECT r.swhid AS origin, o.swhid || ';visit=' || s.swhid || ';anchor=' || c.swhid || ';path=/' AS context FROM nodes o JOIN arcs a1 ON a1.dst = o.node_id AND a1.src_type = 'rev' JOIN nodes c ON c.node_id = a1.src JOIN arcs a2 ON a2.dst = c.node_id JOIN nodes s ON s.node_id = a2.src JOIN arcs a3 ON a3.dst = s.node_id JOIN nodes r ON r.node_id = a3.src WHERE o.node_id = " + str(ORDER))
def contexts_of_order(g):
    found = paths.origin_paths(g, ORDER_ID)
    text = F.regexp_replace("context", ";origin=[^;]*", "")
    return paths.contexts(g, found).join(g.nodes.select(F.col("node_id").alias("origin"), "swhid"), "origin").select(F.col("swhid").alias("origin"), text.alias("context"))


@query(reach(str(ORDER), types_sql("dir:cnt"), depth=1) + _back("SELECT node, depth FROM near JOIN nodes ON node = node_id WHERE node_type = 'cnt' ORDER BY depth, node LIMIT 1") + " SELECT CAST(depth AS INTEGER) AS pos, swhid FROM back JOIN nodes ON node_id = node")
def walk_to_content(g):
    path = GraphService(g).walk(ORDER_ID, "cnt", edges="dir:cnt")
    return g.spark.createDataFrame(list(enumerate(path)), "pos int, swhid string")


@query(reach(str(PART), backward=True) + "SELECT true AS arcs_hold, true AS ends_in_an_origin, swhid AS first FROM nodes WHERE node_id = " + str(PART))
def random_walk_to_origin(g):
    """A walk of any length: each step is an arc, and the last node is an origin."""
    ids = paths.random_walk(g, PART_ID, "ori", "BACKWARD")
    steps = g.spark.createDataFrame(list(zip(ids[1:], ids)), "src bigint, dst bigint")
    held = g.arcs.join(F.broadcast(steps), ["src", "dst"], "left_semi").agg((F.count("*") == len(ids) - 1).alias("arcs_hold"))
    ends = g.nodes.where(F.col("node_id") == ids[-1]).select((F.col("node_type") == "ori").alias("ends_in_an_origin"))
    return held.crossJoin(ends).crossJoin(g.nodes.where(F.col("node_id") == ids[0]).select(F.col("swhid").alias("first")))  # one row each


@query("SELECT node_type, count(*) AS count, 0::BIGINT AS before FROM nodes GROUP BY 1")
def breadth_first_order(g):
    """A numbering of all nodes: dense, each once; in a graph without cycles no origin is reached from another, so origins are first of their own trees."""
    order = paths.bfs_order(g).join(g.nodes.select("node_id", "node_type"), "node_id")
    n = g.num_nodes()
    wrong = F.count_if((F.col("place") < 0) | (F.col("place") >= n))
    return order.groupBy("node_type").agg(F.count_distinct("place").alias("count"), wrong.alias("before"))


@query("SELECT node_id, length FROM nodes")
def property_of_nodes(g):
    return g.property("length")


@query(", l AS (SELECT name, CAST(row_number() OVER (ORDER BY name) - 1 AS BIGINT) AS label_name_id FROM (SELECT DISTINCT name FROM label_rows WHERE name IS NOT NULL)) SELECT n AS name, label_name_id FROM (VALUES ('1'), ('Customer#000000007'), ('nowhere')) a(n) LEFT JOIN l ON name = n")
def label_name_lookup(g):
    asked = g.spark.createDataFrame([("1",), ("Customer#000000007",), ("nowhere",)], "name string")
    return g.label_name_ids(asked).select(F.col("name").cast("string").alias("name"), "label_name_id")


# distributions over all roots


#: Every revision with the directories under it, at any depth.
_DIRS = ", w AS (SELECT src AS rev, dst AS node FROM arcs WHERE src_type = 'rev' AND dst_type = 'dir' UNION SELECT rev, dst FROM w JOIN arcs ON src = node WHERE src_type = 'dir' AND dst_type = 'dir'), held AS (SELECT DISTINCT rev, dst AS cnt FROM w JOIN arcs ON src = node WHERE dst_type = 'cnt')"


@query(_DIRS + " SELECT node_id AS root, count(cnt) AS count FROM nodes LEFT JOIN held ON rev = node_id WHERE node_type = 'rev' GROUP BY 1")
def revision_sizes(g):
    return stats.reach_counts(g, g.nodes.where("node_type = 'rev'").select(F.col("node_id").alias("node")), "cnt", leaves=True)


@query(_DIRS + " SELECT node_id AS root, count(rev) AS count FROM nodes LEFT JOIN held ON cnt = node_id WHERE node_type = 'cnt' GROUP BY 1")
def content_popularity(g):
    return stats.reach_counts(g, g.nodes.where("node_type = 'cnt'").select(F.col("node_id").alias("node")), "rev", "cnt:dir,dir:dir,dir:rev", "BACKWARD", leaves=True, carry="targets")


@query(", o AS (SELECT c.dst AS root, a.src AS node FROM arcs c JOIN arcs a ON a.dst = c.src WHERE c.src_type = 'snp' AND c.dst_type = 'rev' AND a.src_type = 'ori') SELECT node_id AS root, count(DISTINCT node) AS count FROM nodes LEFT JOIN o ON root = node_id WHERE node_type = 'rev' GROUP BY 1")
def commit_popularity(g):
    return stats.reach_counts(g, g.nodes.where("node_type = 'rev'").select(F.col("node_id").alias("node")), "ori", "*", "BACKWARD", leaves=True)


@query(", o AS (SELECT a.src AS root, b.dst AS node FROM arcs a JOIN arcs b ON a.dst = b.src WHERE a.src_type = 'ori' AND b.dst_type = 'rev') SELECT node_id AS root, count(DISTINCT node) AS count FROM nodes LEFT JOIN o ON root = node_id WHERE node_type = 'ori' GROUP BY 1")
def origin_sizes(g):
    return stats.reach_counts(g, g.nodes.where("node_type = 'ori'").select(F.col("node_id").alias("node")), "rev", "ori:snp,snp:rel,snp:rev,rel:rev,rev:rev", leaves=True)


@query(", o AS (SELECT DISTINCT src AS rev, dst AS node FROM arcs WHERE src_type = 'rev'), w AS (SELECT rev, node FROM o UNION SELECT rev, dst FROM w JOIN arcs ON src = node WHERE src_type = 'dir') SELECT p.node_id AS node, arg_min(w.rev, CAST(r.committer_ts AS HUGEINT) * 10000000000 + w.rev) AS revision, min(r.committer_ts) AS committer_ts FROM nodes p JOIN w ON w.node = p.node_id JOIN nodes r ON r.node_id = w.rev WHERE p.node_type = 'cnt' AND r.committer_ts IS NOT NULL GROUP BY 1")
def earliest_revisions(g):
    return stats.earliest_revisions(g, g.nodes.where("node_type = 'cnt'").select(F.col("node_id").alias("node")))


# functions


def _pages(f):
    QUERIES[f.__name__] = lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return f


@_pages
def url_functions(pages):
    url = F.col("url")
    return pages.select("page_id", fn.origin_swhid(url).alias("swhid"), fn.reversed_path(url).alias("key"), fn.swapped_protocol(url).alias("swapped"))


ORACLES["url_functions"] = "SELECT page_id, 'swh:1:ori:' || sha1(url) AS swhid, array_to_string(list_reverse(string_split(rtrim(url, '/'), '/')), '/') AS key, CASE WHEN url LIKE 'https://%' THEN 'git://' || substr(url, 9) WHEN url LIKE 'git://%' THEN 'https://' || substr(url, 7) END AS swapped FROM pages"


@_pages
def origins_in_order(pages):
    """Urls numbered in the order of their reversed paths, ties by page."""
    keyed = pages.select("page_id", fn.reversed_path(F.col("url")).alias("key"))
    return numbered(keyed, ["key", "page_id"], "place").select("page_id", "place")


ORACLES["origins_in_order"] = "SELECT page_id, CAST(row_number() OVER (ORDER BY array_to_string(list_reverse(string_split(rtrim(url, '/'), '/')), '/') NULLS FIRST, page_id NULLS FIRST) - 1 AS BIGINT) AS place FROM pages"


def person_functions(spark, sf_dir):
    name = F.when(F.col("c_custkey") % 5 == 0, F.col("c_name")).otherwise(F.concat("c_name", F.lit(" <user"), F.col("c_custkey").cast("string"), F.lit("@example.org>")))
    p = fn.parsed_fullname(F.col("full"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", name.alias("full")).select("c_custkey", fn.person_key(F.col("full")).alias("pseudonym"), p["name"].alias("name"), p["email"].alias("email"), p["local"].alias("local"), p["domain"].alias("domain"))


QUERIES["person_functions"] = person_functions
ORACLES["person_functions"] = r"""
WITH f AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_name ELSE c_name || ' <user' || c_custkey || '@example.org>' END AS f FROM customer), m AS (SELECT *, regexp_matches(f, '^(.+)\s+<((.+)@(.+))>$') AS ok FROM f)
SELECT c_custkey, to_base64(unhex(sha256(f))) AS pseudonym, CASE WHEN ok THEN regexp_extract(f, '^(.+)\s+<((.+)@(.+))>$', 1) END AS name, CASE WHEN ok THEN regexp_extract(f, '^(.+)\s+<((.+)@(.+))>$', 2) END AS email,
CASE WHEN ok THEN regexp_extract(f, '^(.+)\s+<((.+)@(.+))>$', 3) END AS local, CASE WHEN ok THEN regexp_extract(f, '^(.+)\s+<((.+)@(.+))>$', 4) END AS domain FROM m
"""


def label_functions(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    packed = fn.packed_entry(F.col("l_partkey"), F.col("l_linenumber") % 8)
    back = fn.unpacked_entry(packed)
    mode = F.element_at(F.array(*[F.lit(m) for m in (0o100644, 0o100755, 0o120000, 0o040000, 0o160000, 0o100600, 7)]), F.col("l_linenumber") % 7 + 1)
    visit = fn.packed_visit(F.col("l_orderkey").cast("bigint") + 10**9, F.col("l_linenumber") % 2 == 0, F.col("l_linenumber") % 8)
    seen = fn.unpacked_visit(visit)
    return items.select(
        "l_orderkey", "l_linenumber", packed.alias("packed"), back["name_id"].alias("name_id"), back["permission_code"].alias("code"), fn.permission_name(mode).alias("permission"),
        visit.alias("visit"), seen["visit_timestamp"].alias("visited"), seen["is_full_visit"].alias("full"), seen["visit_code"].alias("visit_code"), fn.packed_branch(F.col("l_partkey")).alias("branch"),
    )


QUERIES["label_functions"] = label_functions
ORACLES["label_functions"] = "SELECT l_orderkey, l_linenumber, l_partkey * 8 + l_linenumber % 8 AS packed, (l_orderkey + 1000000000) * 32 + (CASE WHEN l_linenumber % 2 = 0 THEN 16 ELSE 0 END) + 8 + l_linenumber % 8 AS visit, l_orderkey + 1000000000 AS visited, l_linenumber % 2 = 0 AS \"full\", CAST(l_linenumber % 8 AS INTEGER) AS visit_code, l_partkey * 8 AS branch, l_partkey AS name_id, CAST(l_linenumber % 8 AS INTEGER) AS code, CASE l_linenumber % 7 WHEN 0 THEN 'content' WHEN 1 THEN 'executable' WHEN 2 THEN 'symlink' WHEN 3 THEN 'directory' WHEN 4 THEN 'revision' ELSE 'none' END AS permission FROM lineitem"


# the ingest, on the small relations that it is given


def example_build(spark, sf_dir):
    g = extract.build(example.relations(spark))
    return stats.arcs_by_type(g).select(F.concat_ws(":", "src_type", "dst_type").alias("kind"), "count").unionByName(stats.nodes_by_type(g).toDF("kind", "count"))


QUERIES["example_build"] = example_build
ORACLES["example_build"] = "SELECT * FROM (VALUES ('dir:cnt', 8::BIGINT), ('dir:dir', 3), ('ori:snp', 2), ('rel:rev', 3), ('rev:dir', 4), ('rev:rev', 3), ('snp:rel', 3), ('snp:rev', 2), ('cnt', 7), ('dir', 6), ('ori', 2), ('rel', 3), ('rev', 4), ('snp', 2)) t(kind, count)"
