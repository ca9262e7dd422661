"""Plans that must hold on tables of any size."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from arcweave.api import GraphService
from arcweave.operators import extract, stats
from arcweave.operators.graph import PropertyGraph
from arcweave.operators.traverse import Traversal, TraversalRequest
from arcweave.plans import frontier
from arcweave.schema import LEGAL_ARCS
from arcweave.sources import commerce
from arcweave.sources.example import ident, relations


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("graph")) + "/g"
    extract.build(relations(spark)).save(path)
    return PropertyGraph.load(spark, path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sent(df):
    """What the plan sends whole through the driver."""
    return plan(df).count("BroadcastExchange")


def test_tables_of_the_graph_are_never_sent_by_a_guess(graph):
    """millions of arcs or nodes lie in a few MB, which Spark takes for small."""
    start = ident("snp", 20)
    assert sent(GraphService(graph).count_neighbors(start)) == 0
    assert sent(GraphService(graph).neighbors(start)) == 0
    assert sent(Traversal(graph, TraversalRequest([start], max_depth=2)).nodes()) == 0
    assert sent(graph.outdegrees()) == sent(graph.subgraph("node_id > 3").arcs) == 0


def test_few_sources_are_given_to_the_scan(graph):
    assert "Join" not in plan(Traversal(graph, TraversalRequest([ident("snp", 20)], max_depth=1)).nodes())


def test_statistics_of_all_roots_send_nothing(graph):
    """F3, F6."""
    objects = graph.nodes.where("node_type = 'cnt'").select("node_id").toDF("node")
    assert sent(stats.earliest_revisions(graph, objects)) == 0
    roots = graph.nodes.where("node_type = 'rev'").select("node_id").toDF("node")
    assert sent(stats.reach_counts(graph, roots, "cnt", leaves=True)) == 0


def test_build_is_the_graph_that_save_would_leave(spark):
    """F7 to F14: arcs are dealt once and made where they are stored, without an aggregate by maps; no part grows with the input."""
    stored, lazy = commerce.stored_graph(spark, SF), commerce.commerce_graph(spark, SF)
    for a, b in ((stored.arcs, lazy.arcs), (stored.back, lazy.transpose().arcs)):
        rows = lambda df: sorted((r.src, r.dst, r.src_type, r.dst_type, r.labels) for r in df.collect())
        assert rows(a) == rows(b)
    assert {tuple(r) for r in stored.nodes.collect()} == {tuple(r) for r in lazy.nodes.collect()}
    rows = commerce.arc_parts(spark, SF)[5][1]
    assert plan(commerce._arcs(rows.repartitionByRange(3, "src", "dst"), commerce.arc_parts(spark, SF)[5][2])).count("Exchange") == 1


def test_problems_count_ends_by_node(graph):
    """an end is shuffled once for each node and task, not for each arc."""
    assert "Generate" not in plan(extract.problems(graph, ()))
    lost = PropertyGraph(graph.nodes.where("node_type <> 'cnt'"), graph.arcs)
    want = graph.arcs.where("dst_type = 'cnt'").count()
    assert {r.problem: r.n for r in extract.problems(lost, LEGAL_ARCS).collect()} == {"ends without node": want}


def test_large_layers_are_shuffled_in_many_parts(graph, monkeypatch):
    """parts by the number of arcs, whatever the session's."""
    arcs = graph.arcs.select("src", "dst")
    sources = graph.nodes.where("node_type = 'snp'").select("node_id").toDF("node")
    want = sorted(map(tuple, frontier.Walk(arcs, sources, mark_sources=True).run(None).collect()))
    for name, value in (("SMALL", 0), ("FEW", 0), ("PART", 3)):
        monkeypatch.setattr(frontier, name, value)
    walk = frontier.Walk(arcs, sources, mark_sources=True)
    assert sorted(map(tuple, walk.run(None).collect())) == want and walk.parts == 10


def test_difference_counts_once(spark, graph):
    """no row is shuffled once for each side; repeats, other ids and missing ends count as they did."""
    other = graph.subgraph("node_type <> 'cnt' or node_id % 2 = 0")
    assert "replicaterows" not in plan(graph.difference(other))

    def by_rows(a, b, labels):
        """As sets of identifiers and arcs, row by row, in Python."""
        def rows(g):
            nodes = g.nodes.collect()
            return Counter([("node", n.swhid, n.node_type) for n in nodes] + [("arc", x.swhid, y.swhid, str(arc.labels) if labels else "") for arc in g.arcs.collect() for x in nodes if x.node_id == arc.src for y in nodes if y.node_id == arc.dst])

        left, right = rows(a), rows(b)
        return Counter({(side, kind): n for side, more in (("left", left - right), ("right", right - left)) for kind in ("node", "arc") if (n := sum(v for k, v in more.items() if k[0] == kind))})

    shifted = PropertyGraph.of(other.nodes.withColumn("node_id", F.col("node_id") + 3), other.arcs.withColumn("src", F.col("src") + 3).withColumn("dst", F.col("dst") + 3))
    twice = PropertyGraph.of(graph.nodes.unionByName(graph.nodes.where("node_type = 'rev'")), graph.arcs.unionByName(graph.arcs.where("src % 3 = 0")))
    lost = PropertyGraph.of(graph.nodes.where("node_type <> 'dir'"), graph.arcs)
    for a, b in ((graph, other), (graph, shifted), (graph, twice), (lost, graph), (twice, lost)):
        for labels in (True, False):
            assert Counter((r.side, r.kind) for r in a.difference(b, labels, properties=False).collect()) == by_rows(a, b, labels)


def shuffled(spark, work):
    """Rows that work() writes to shuffles."""
    sc = spark.sparkContext
    store, java = sc._jsc.sc().statusStore(), sc._gateway

    def rows():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, java.new_array(java.jvm.double, 0), java.jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    before = rows()
    work()
    return sum(n for stage, n in rows().items() if stage not in before)


def test_build_shuffles_each_row_once(spark, monkeypatch):
    """F8: what rows are made of is computed once for both directions, and identifiers are made where they are stored."""
    monkeypatch.setattr(commerce, "_STORED", {})
    n = {t: spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    nodes = sum(n.values()) - n["lineitem"]
    arcs = n["nation"] + n["customer"] + n["supplier"] + 2 * n["orders"] + 2 * n["lineitem"]
    first, chain, one_a_task = n["orders"] + n["customer"], n["orders"], 1_000
    assert shuffled(spark, lambda: commerce.stored_graph(spark, SF)) <= nodes + 2 * arcs + first + chain + one_a_task
    made, dealt = plan(commerce.named(commerce.node_rows(spark, SF).repartitionByRange(3, "node_id"))).split("Exchange rangepartitioning", 1)
    assert "sha1(" in made and "sha1(" not in dealt


def test_large_layers_meet_arcs_before_what_is_seen(graph, monkeypatch):
    """arcs are shuffled by their source alone, and only those in the layer's range of ids."""
    arcs = graph.arcs.select("src", "dst")
    sources = graph.nodes.where("node_type = 'snp'").select("node_id").toDF("node")
    want, plans, counted = sorted(map(tuple, frontier.Walk(arcs, sources, mark_sources=True).run(None).collect())), [], frontier.counted
    for name, value in (("SMALL", 0), ("FEW", 0), ("PART", 3)):
        monkeypatch.setattr(frontier, name, value)
    monkeypatch.setattr(frontier, "counted", lambda df, name: (plans.append(plan(df)), counted(df, name))[1])
    assert sorted(map(tuple, frontier.Walk(arcs, sources, mark_sources=True).run(None).collect())) == want
    for step in plans[1:]:
        assert step.count("Exchange hashpartitioning(dst") == 1 and "LeftAnti" not in step and "GreaterThanOrEqual(src," in step


def test_difference_of_a_view_shuffles_what_may_differ(spark):
    """nodes once from each side, and of the arcs only those of nodes that stand on one side."""
    graph = commerce.stored_graph(spark, SF)
    other = graph.subgraph("node_type <> 'cnt' or node_id % 10 <> 0")
    nodes, arcs = graph.num_nodes(), graph.arcs.where("dst_type = 'cnt' and dst % 10 = 0").count()
    checked, ends, small = nodes, 2 * nodes + 2 * arcs, 1_000
    assert shuffled(spark, lambda: graph.difference(other).groupBy("side", "kind").count().collect()) <= 2 * nodes + checked + ends + small
    assert "Join" not in plan(other.loose)


@pytest.mark.parametrize("blocks", [20_000, 0])
def test_difference_of_views_is_that_of_their_rows(graph, monkeypatch, blocks):
    """as sets of identifiers and arcs, whatever was left out, and however the ids that differ are sent."""
    monkeypatch.setattr(frontier, "BLOCKS", blocks)

    def rows(g):
        nodes = g.nodes.collect()
        at = {i: [n.swhid for n in nodes if n.node_id == i] for i in {n.node_id for n in nodes}}
        arcs = [(a, b) for arc in g.arcs.collect() for a in at.get(arc.src, []) for b in at.get(arc.dst, [])]
        return Counter([("node", n.swhid) for n in nodes] + [("arc", *x) for x in arcs])

    def found(df):
        keys = [(r.side, r.kind, json.loads(r.key)) for r in df.collect()]
        return Counter((side, kind, *((k["swhid"],) if kind == "node" else (k["a"], k["b"]))) for side, kind, k in keys)

    few = graph.subgraph("node_type <> 'cnt' or node_id % 2 = 0")
    cut = PropertyGraph(graph.nodes.where("node_type <> 'dir'"), graph.arcs)
    again = PropertyGraph(graph.nodes.unionByName(graph.nodes.where("node_type = 'rev'").withColumn("node_id", F.col("node_id") + 10_000)), graph.arcs.unionByName(graph.arcs.where("src_type = 'rev'").withColumn("src", F.col("src") + 10_000)))
    loud = PropertyGraph(graph.nodes.withColumn("swhid", F.when(F.col("node_id") % 3 == 0, F.upper("swhid")).otherwise(F.col("swhid"))), graph.arcs)
    pairs = [
        (few, few.subgraph("node_type <> 'rev'")), (few, few.subgraph(lambda nodes: graph.nodes)), (graph, graph.subgraph("node_id > 2", F.col("src") % 2 == 0)),
        (few.transpose(), graph.transpose()), (graph.with_types("rev,dir"), few.with_edges("dir:cnt")), (cut, cut.subgraph("node_id > 3")),
        (again, again.subgraph("node_id < 10000")), (again, graph), (graph, loud),
    ]
    for a, b in pairs if blocks else pairs[:1]:
        left, right = rows(a), rows(b)
        assert found(a.difference(b, labels=False)) == Counter({("left", *k): n for k, n in (left - right).items()}) + Counter({("right", *k): n for k, n in (right - left).items()})
