"""Results on the example relations."""

import pytest
from pyspark.sql import functions as F

from arcweave import __main__ as commands
from arcweave.api import GraphService
from arcweave.operators import extract, paths, stats
from arcweave.operators.graph import PropertyGraph
from arcweave.operators.traverse import NodeFilter, Traversal, TraversalRequest, closure, visit_paths
from arcweave.parse import InvalidArgument, MissingProperty, NotFound, http_status
from arcweave.schema import LEGAL_ARCS
from arcweave.sources import relations as sources
from arcweave.sources import sinks
from arcweave.sources.example import URLS, ident, relations
from base64 import b64encode
from hashlib import sha1, sha256

ORI1, ORI2 = (f"swh:1:ori:{sha1(u.encode()).hexdigest()}" for u in URLS)


@pytest.fixture(scope="module")
def rel(spark):
    return {k: v.cache() for k, v in relations(spark).items()}


@pytest.fixture(scope="module")
def graph(spark, rel, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("graph")) + "/g"
    extract.build(rel).save(path)
    return PropertyGraph.load(spark, path)


def swhids(df):
    return sorted(r.swhid for r in df.collect())


def run(graph, src, **more):
    return Traversal(graph, TraversalRequest(src if isinstance(src, list) else [src], **more))


def one(df):
    return df.first()[0]


def test_tables(graph, rel):
    assert graph.num_nodes() == 24 and graph.num_arcs() == 28
    assert {(r.node_type, r["count"]) for r in stats.nodes_by_type(graph).collect()} == {("cnt", 7), ("dir", 6), ("ori", 2), ("rel", 3), ("rev", 4), ("snp", 2)}
    assert extract.label_name_rows(rel).count() == 11 and extract.persons(rel).count() == 3
    assert extract.person_fullnames(rel).count() == 3
    assert graph.label_names().count() == 11
    assert extract.problems(graph, LEGAL_ARCS).count() == 0
    assert {(r.degree, r.nodes) for r in stats.degree_distribution(graph).collect()} == {(0, 7), (1, 8), (2, 7), (3, 2)}
    r = stats.report(graph, 1, 2).first()
    assert (r.num_nodes, r.num_edges, r.outdegree_max, r.indegree_max) == (24, 28, 3, 4) and abs(r.outdegree_avg - 28 / 24) < 1e-12
    assert r.num_arcs_by_type["dir:cnt"] == 8
    assert extract.edge_counts(rel).count() == 8 and extract.estimates(rel) == {"nodes": 24, "arcs": 28 + 0}


def test_types_of_an_ingest(rel):
    g = extract.build(rel, "cnt,dir")
    assert {r.node_type for r in stats.nodes_by_type(g).collect()} == {"cnt", "dir"} and g.num_arcs() == 11


@pytest.mark.parametrize(("src", "more", "nodes", "edges"), [
    (ORI1, {}, 12, 13), (ident("dir", 12), {}, 8, 7), (ident("dir", 12), {"direction": "BACKWARD"}, 7, 6),
    (ident("cnt", 4), {"direction": "BACKWARD"}, 14, 17), (ident("rev", 3), {"direction": "BACKWARD", "edges": "rev:rev,rev:rel"}, 7, 6),
])
def test_counts(graph, src, more, nodes, edges):
    assert one(run(graph, src, **more).count_nodes()) == nodes and one(run(graph, src, **more).count_edges()) == edges


def test_limits(graph):
    assert [one(run(graph, ORI1, max_matching_nodes=k).count_edges()) for k in (1, 2)] == [1, 3]
    assert [one(run(graph, ident("rel", 19), max_depth=k).count_nodes()) for k in range(4)] == [1, 2, 4, 8]
    assert [one(run(graph, ident("rel", 19), max_edges=k).count_nodes()) for k in (1, 3, 7)] == [2, 4, 8]
    assert one(run(graph, ORI1, max_edges=0).count_nodes()) == 1 and one(run(graph, ORI1, max_matching_nodes=0).count_nodes()) == 12
    assert one(run(graph, ident("rel", 19), max_depth=2, return_nodes=NodeFilter(max_traversal_successors=0)).count_nodes()) == 2
    assert one(run(graph, ORI1, edges="").count_nodes()) == 1


def test_sources_are_a_bag(graph):
    twice = run(graph, [ident("rev", 9), ident("rev", 9), ident("rev", 3)], edges="rev:rev")
    assert one(twice.count_nodes()) == 4 and one(twice.count_edges()) == 2


def test_ignored_and_masked(graph, spark):
    assert swhids(GraphService(graph).traverse(TraversalRequest([ident("dir", 6)], ignore_node=[ident("cnt", 4)]), "swhid")) == [ident("cnt", 5), ident("dir", 6)]
    assert one(run(graph, ident("dir", 6), ignore_node=[ident("dir", 6)]).count_nodes()) == 1
    hidden = spark.createDataFrame([(ORI1,), (ident("cnt", 5),), (ident("cnt", 404),)], "swhid string")
    masked = GraphService(graph, hidden)
    assert swhids(masked.leaves(ident("dir", 6))) == [ident("cnt", 4)]
    with pytest.raises(NotFound):
        masked.get_node(ORI1)


def test_web_operators(graph):
    s = GraphService(graph)
    assert swhids(s.leaves(ident("snp", 20))) == [ident("cnt", n) for n in (1, 4, 5, 7)]
    assert swhids(s.neighbors(ident("dir", 8))) == [ident("cnt", 1), ident("cnt", 7), ident("dir", 6)]
    assert one(s.count_leaves(ident("snp", 20))) == 4 and one(s.count_neighbors(ident("dir", 8))) == 3 and one(s.count_visit_nodes(ORI1)) == 12
    assert s.visit_edges(ident("dir", 12)).count() == 7
    assert swhids(s.visit_nodes(ident("rev", 13), edges="rev:rev")) == [ident("rev", n) for n in (3, 9, 13)]
    with pytest.raises(InvalidArgument):
        s.visit_nodes(ORI1, direction="sideways")


def test_get_node(graph):
    s = GraphService(graph)
    n = s.get_node(ident("rev", 9)).first()
    assert (n.rev.author_date, n.rev.committer_date, n.rev.author_date_offset, bytes(n.rev.message), n.num_successors) == (1111144440, 1111155550, 120, b"Add parser", 2)
    assert n.cnt is None and {x.swhid for x in n.successor} == {ident("rev", 3), ident("dir", 8)}
    assert s.get_node(ident("cnt", 15), "cnt").first().cnt == (404, True) and s.get_node(ident("cnt", 1), "cnt.length").first().cnt == (42,)
    assert s.get_node(ORI1, "ori.url").first().ori.url == URLS[0] and s.get_node(ORI1, "nothing").columns == ["swhid"]
    label = s.get_node(ORI1, "successor.label").first().successor[0].label[0]
    assert (label.visit_timestamp, label.is_full_visit, label.visit_type) == (1367900441, True, "vcs")
    entries = {(x.swhid, bytes(x.label[0].name), x.label[0].permission) for x in s.get_node(ident("dir", 8)).first().successor}
    assert {(ident("dir", 6), b"tests"), (ident("cnt", 1), b"README.md"), (ident("cnt", 7), b"parser.c")} == {e[:2] for e in entries}
    for bad, error in (("swh:1:rev:00", InvalidArgument), ("", InvalidArgument), (ident("rev", 404), NotFound)):
        with pytest.raises(error):
            s.get_node(bad)


def test_paths(graph):
    ids = {r.node_id: r.swhid for r in graph.nodes.collect()}
    to = lambda *a, **k: [ids[n] for n in paths.find_path_to(graph, paths.FindPathToRequest(*a, **k)).nodes]
    assert to([ident("rev", 9)], NodeFilter("cnt"))[0] == ident("rev", 9) and len(to([ident("rev", 9)], NodeFilter("cnt"))) == 3
    assert to([ident("cnt", 4)], NodeFilter("cnt")) == [ident("cnt", 4)]
    assert to([ident("cnt", 4)], NodeFilter("ori"), "BACKWARD")[-1] in (ORI1, ORI2)
    with pytest.raises(NotFound):
        to([ident("cnt", 4)], NodeFilter("ori"))
    with pytest.raises(NotFound):
        to([ident("cnt", 4)], NodeFilter("ori"), "BACKWARD", max_depth=2)
    with pytest.raises(InvalidArgument):
        to([ident("cnt", 4)])
    between = lambda a, b, *c, **k: paths.find_path_between(graph, paths.FindPathBetweenRequest([a], [b], *c, **k))
    p = between(ORI1, ident("cnt", 4))
    assert [ids[n] for n in p.nodes] == [ORI1, ident("snp", 20), ident("rev", 9), ident("dir", 8), ident("dir", 6), ident("cnt", 4)]
    same = between(ident("cnt", 4), ident("cnt", 4))
    assert len(same.nodes) == 1 and same.midpoint == 0
    p = between(ident("cnt", 4), ident("cnt", 15), "BACKWARD", "BACKWARD", edges="cnt:dir,dir:dir,dir:rev,rev:rev")
    assert ids[p.nodes[p.midpoint]] == ident("rev", 18) and len(p.nodes) == 9
    assert len(between(ORI1, ident("cnt", 7), max_depth=2).nodes) == 5
    with pytest.raises(NotFound):
        between(ORI1, ident("cnt", 4), max_depth=2)
    rows = paths.path_rows(graph, between(ORI1, ident("cnt", 4))).collect()
    assert [bytes(r.labels[0].name) if r.labels and r.labels[0].name else None for r in rows] == [None, b"refs/heads/master", None, b"tests", b"README.rst", None]


def test_context(graph):
    find = lambda *a: paths.find_context(graph, *a)
    tail = f";origin={URLS[0]};visit={ident('snp', 20)}"
    assert find(ident("cnt", 1), URLS[0]) == [f"{ident('cnt', 1)}{tail};anchor={ident('rev', 9)};path=/README.md"]
    assert find(ident("cnt", 14)) == [f"{ident('cnt', 14)};origin={URLS[1]};visit={ident('snp', 22)};anchor={ident('rev', 18)};path=/TODO.txt"]
    assert find(ident("dir", 12)) == [f"{ident('dir', 12)};origin={URLS[1]};visit={ident('snp', 22)};anchor={ident('rev', 13)};path=/"]
    assert find(ident("rev", 9), URLS[0]) == [ident("rev", 9) + tail]
    assert find(ident("snp", 20)) == [f"{ident('snp', 20)};origin={URLS[0]}"]
    both = find(ident("cnt", 4), "*")
    assert len(both) == 2 and set(both) == {find(ident("cnt", 4), u)[0] for u in URLS}
    assert paths.find_context(graph, ident("cnt", 4), "*", False) == sorted(URLS) and paths.find_context(graph, ident("cnt", 14), "", False) == [URLS[1]]
    assert find(ident("cnt", 15), "*") == find(ident("cnt", 15))


def test_walks(graph):
    s = GraphService(graph)
    args = (ident("dir", 16), "rel", "backward", "dir:dir,dir:rev,rev:*")
    assert s.walk(*args) == [ident("dir", 16), ident("dir", 17), ident("rev", 18), ident("rel", 19)]
    assert s.walk(*args, -1) == [ident("rel", 19)] and s.walk(*args, 2) == [ident("dir", 16), ident("dir", 17)] and s.walk(*args, 0) == s.walk(*args)
    for dst in ("rel", ident("rel", 19)):
        path = s.random_walk(ident("cnt", 15), dst, "backward")
        assert len(path) > 1 and path[0] == ident("cnt", 15) and path[-1] == ident("rel", 19)
        ids = graph.node_ids(path)
        assert all(graph.has_arc(b, a) for a, b in zip(ids, ids[1:]))
        assert s.random_walk(ident("cnt", 15), dst, "backward", limit=-1) == [ident("rel", 19)] and len(s.random_walk(ident("cnt", 15), dst, "backward", limit=-2)) == 2
        assert len(s.random_walk(ident("cnt", 15), dst, "backward", limit=3)) == 3
    with pytest.raises(NotFound):
        s.random_walk(ident("cnt", 15), "ori", "forward")


def test_bfs_order(graph):
    order = {r.node_id: r.place for r in paths.bfs_order(graph, [ident("dir", 12), ident("dir", 6)]).collect()}
    assert sorted(order.values()) == list(range(24))
    ids = {r.swhid: r.node_id for r in graph.nodes.collect()}
    assert order[ids[ident("dir", 12)]] == 0
    assert max(order[ids[ident(k, n)]] for k, n in (("dir", 12), ("dir", 8), ("dir", 6), ("cnt", 1), ("cnt", 4), ("cnt", 5), ("cnt", 7), ("cnt", 11))) == 7


def test_properties_by_group(graph, spark, tmp_path):
    graph.save(str(tmp_path / "g"))
    some = PropertyGraph.load(spark, str(tmp_path / "g"), ["contents", "strings"])
    some.save(str(tmp_path / "less"))
    assert {r.length for r in some.property("length").collect()} >= {42, None}
    assert [r.message_base64 for r in some.property("message", base64=True).where("message_base64 is not null").collect()].count("QWRkIHBhcnNlcg==") == 1
    for bad in ("committer_ts", "nonsense"):
        with pytest.raises(MissingProperty):
            some.property(bad)
    with pytest.raises(MissingProperty):
        PropertyGraph.load(spark, str(tmp_path / "less"), ["timestamps"])
    with pytest.raises(MissingProperty):
        PropertyGraph.load(spark, str(tmp_path / "less"), ["nonsense"])
    lenient = PropertyGraph.load(spark, str(tmp_path / "less"), ["contents", "timestamps"], optional=["timestamps"])
    assert lenient.groups == {"contents"} and lenient.nodes.where("committer_ts is not null").isEmpty()
    names = graph.label_names().collect()
    asked = spark.createDataFrame([(names[3].name,), (b"nowhere",)], "name binary")
    assert {(bytes(r.name), r.label_name_id) for r in graph.label_name_ids(asked).collect()} == {(bytes(names[3].name), names[3].label_name_id), (b"nowhere", None)}
    back = graph.names_of_labels(spark.createDataFrame([(names[3].label_name_id,), (999,)], "label_name_id bigint")).collect()
    assert {(r.label_name_id, r.name and bytes(r.name)) for r in back} == {(names[3].label_name_id, bytes(names[3].name)), (999, None)}


def test_both_layouts_are_one_graph(graph):
    swapped = graph.arcs.select("dst", "src", "dst_type", "src_type", "labels")
    assert graph.back is not None and swapped.exceptAll(graph.transpose().arcs).isEmpty() and graph.transpose().arcs.exceptAll(swapped).isEmpty()
    for view in (graph.with_types("dir,cnt"), graph.with_edges("dir:cnt,rev:dir"), graph.subgraph(F.col("node_id") % 2 == 0), graph.subgraph(arc_filter=F.col("src") % 2 == 0), graph.without_labels(), graph.transpose()):
        there, back = view.arcs.select("src", "dst"), view.transpose().arcs.select("dst", "src")
        assert there.exceptAll(back).isEmpty() and back.exceptAll(there).isEmpty()


def test_commands(graph, spark, tmp_path):
    import json

    path = str(tmp_path / "g")
    graph.save(path)
    node = json.loads(commands.run(spark, ["get-node", "--graph", path, "--node", ident("cnt", 1)])[0])
    assert node["swhid"] == ident("cnt", 1) and node["cnt"]["length"] == 42 and node["num_successors"] == 0
    number = str(graph.node_ids([ident("cnt", 1)])[0])
    assert json.loads(commands.run(spark, ["get-node", "--graph", path, "--node", number, "--mask", "cnt.length"])[0]) == {"swhid": ident("cnt", 1), "cnt": {"length": 42}}
    assert set(commands.run(spark, ["node-ids", "--graph", path], [ident("cnt", 1) + "\n", "\n", ident("cnt", 404)])) == {f"{ident('cnt', 1)} {number}", f"{ident('cnt', 404)} "}
    assert len(commands.run(spark, ["label-ids", "--graph", path], ["README.md", "nowhere"])) == 1
    assert commands.run(spark, ["hash-persons"], ["Jane Doe <jane@example.org>"]) == [b64encode(sha256(b"Jane Doe <jane@example.org>").digest()).decode()]
    with pytest.raises(NotFound):
        commands.run(spark, ["get-node", "--graph", path, "--node", ident("rev", 404)])


def test_labelled_edges(graph):
    rows = run(graph, ident("dir", 8), edges="dir:dir,dir:cnt").labelled_edges().collect()
    assert sorted(bytes(r.labels[0].name) for r in rows) == [b"README.md", b"README.rst", b"main.py", b"parser.c", b"tests"]
    back = run(graph, ident("cnt", 1), direction="BACKWARD", edges="cnt:dir", max_depth=1).labelled_edges().where(F.size("labels") > 0).collect()
    assert {bytes(r.labels[0].name) for r in back} == {b"README.md"}


def test_statuses():
    assert [http_status(e) for e in (InvalidArgument("x"), NotFound("x"), ValueError("x"))] == [400, 400, 503] and http_status(NotFound("x"), checking=False) == 503


def test_closure_forks_paths(graph):
    sub, unknown = closure(graph, [URLS[0].replace("https", "git"), "https://nowhere.org"], retry_protocols=True)
    assert sub.num_nodes() == 12 and [r.url for r in unknown.collect()] == ["https://nowhere.org"]
    assert swhids(stats.shared_root_forks(graph, ORI1)) == sorted([ORI1, ORI2])
    assert visit_paths(graph, ident("dir", 8)).count() == 4
    with pytest.raises(InvalidArgument):
        visit_paths(graph, ORI1, most=3)
    ids = {r.swhid: r.node_id for r in graph.nodes.collect()}
    first = stats.earliest_revisions(graph, graph.nodes.select(F.col("node_id").alias("node")).where(F.col("node") == ids[ident("cnt", 1)])).first()
    assert first.revision == ids[ident("rev", 3)] and first.committer_ts == 1111122220
    sizes = stats.reach_counts(graph, graph.nodes.where("node_type = 'rev'").select(F.col("node_id").alias("node")), "cnt", "rev:dir,dir:dir,dir:cnt")
    assert {r.root: r["count"] for r in sizes.collect()} == {ids[ident("rev", n)]: c for n, c in ((3, 1), (9, 4), (13, 5), (18, 2))}


def test_degraded(graph, spark, tmp_path):
    graph.save(str(tmp_path / "g"))
    bare = PropertyGraph.load(spark, str(tmp_path / "g"), properties=False, labels=False)
    assert GraphService(bare).get_node(ident("cnt", 1), "cnt.length").first().cnt == (None,) and bare.flat_labels().count() == 0
    assert graph.difference(bare, labels=False, properties=False).count() == 0 and graph.difference(bare).count() > 0


def test_sources_and_sinks(graph, spark, tmp_path):
    sinks.convert(graph, str(tmp_path / "json"), "json")
    assert graph.difference(sources.read_json(spark, str(tmp_path / "json"))).count() == 0
    sinks.write_sorted_lines(graph.nodes, "swhid", str(tmp_path / "lines"))
    assert sources.read_lines(spark, str(tmp_path / "lines")).count() == 24
    edges = graph.arcs.join(graph.nodes.select(F.col("node_id").alias("src"), F.col("swhid").alias("a")), "src").join(graph.nodes.select(F.col("node_id").alias("dst"), F.col("swhid").alias("b")), "dst")
    edges.select(F.concat_ws(" ", "a", "b")).write.text(str(tmp_path / "edges"))
    assert graph.difference(sources.read_edge_list(spark, str(tmp_path / "lines"), str(tmp_path / "edges")), labels=False, properties=False).count() == 0
    (tmp_path / "texts").mkdir()
    for name, lines in (("b.txt", "3\n\n1\n"), ("a.txt", "9\n8\n"), ("c.txt", "".join(f"{i}\n" for i in range(50)))):
        (tmp_path / "texts" / name).write_text(lines)
    assert [r.value for r in sources.read_lines_in_order(spark, str(tmp_path / "texts")).orderBy("place").collect()] == ["9", "8", "3", "1", *map(str, range(50))]
    sinks.write_stats_lines(stats.report(graph, 1, 2), str(tmp_path / "stats"))
    lines = {r.value for r in spark.read.text(str(tmp_path / "stats")).collect()}
    assert {"num_nodes=24", "num_edges=28", "num_arcs_by_type.dir:cnt=8", "export_started_at=1"} <= lines
    assert tuple(stats.distinct_counts(graph).first()) == (3, 11)
    asked = spark.createDataFrame([(ident("cnt", 1),), (ident("cnt", 404),), (ident("dir", 8),), (ident("cnt", 404),)], "swhid string")
    assert swhids(graph.unknown(asked)) == [ident("cnt", 404)] and graph.only(asked).num_nodes() == 2 and graph.only(asked).num_arcs() == 1
    (tmp_path / "mask.txt").write_text(f"{ORI1}\nnonsense\n")
    assert swhids(sources.read_masked(spark, str(tmp_path / "mask.txt"))) == [ORI1]
    (tmp_path / "origins.txt").write_text(URLS[0] + "\n")
    assert swhids(sources.read_origins(spark, str(tmp_path / "origins.txt"))) == [ORI1]
    sinks.write_base64_lines(graph.label_names(), "name", str(tmp_path / "names"))
    sinks.write_properties(graph, ["length"], str(tmp_path / "p"))
    sinks.write_stats(stats.report(graph), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 24 and sinks.json_rows(graph.nodes).count() == 24 and len(list(sinks.rows(graph.arcs))) == 28
    from arcweave.streaming import responses

    assert "".join(responses.lines(graph.arcs.select("src", "dst"))).count("\n") == 28
    graph.arcs.drop("labels").write.parquet(str(tmp_path / "in"))
    q = responses.append_arcs(spark, str(tmp_path / "in"), "src bigint, dst bigint, src_type string, dst_type string", str(tmp_path / "table"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "table")).count() == 28


def test_orc(rel, spark, tmp_path):
    for name, df in rel.items():
        df.write.orc(f"{tmp_path}/{name}")
    read = sources.read_relations(spark, str(tmp_path))
    assert sources.row_count(read["directory_entry"]) == 11 and extract.build(read).num_arcs() == 28


def test_builder_and_views(spark):
    b = sources.GraphBuilder(spark)
    a, c, d = (b.node(ident(k, n)) for k, n in (("dir", 10), ("dir", 20), ("cnt", 30)))
    b.entry(a, c, b"run.sh", 0o100755).entry(a, c, b"README.txt", 0o100644).entry(c, d, b"x", 0o100644).arc(a, d)
    g = b.done()
    assert [(bytes(r.name), r.permission) for r in g.flat_labels().where(f"src = {a} and dst = {c}").collect()] == [(b"README.txt", 0o100644), (b"run.sh", 0o100755)]
    assert g.flat_labels().count() == 3 and g.num_arcs() == 3 and g.has_arc(a, d) and not g.has_arc(d, a) and g.has_node(d)
    assert [r.node_id for r in g.successors(a).collect()] == [c, d] and [r.node_id for r in g.predecessors(d).collect()] == [a, c]
    assert g.transpose().has_arc(d, a) and g.transpose().transposed
    assert g.symmetric().count() == 6
    part = g.subgraph(F.col("node_id") != a).contiguous()
    assert [(r.src, r.dst) for r in part.arcs.collect()] == [(0, 1)]
    assert g.labelled_predecessors(c).count() == 1
