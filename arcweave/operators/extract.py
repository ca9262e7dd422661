"""From relations to a graph: arcs, labels, nodes, persons and properties."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.functions.identifiers import origin_swhid, permission, person_key, seconds, swhid, swhid_type, target_type, visit_class
from arcweave.operators.graph import PropertyGraph
from arcweave.parse import node_types
from arcweave.plans.tables import numbered, unsent, written
from arcweave.schema import LABEL, LABEL_DDL

#: Which relations hold the nodes of a type, and what they own.
OWNED = {
    "cnt": ("content", "skipped_content"), "dir": ("directory", "directory_entry"), "ori": ("origin", "origin_visit_status"),
    "rel": ("release",), "rev": ("revision", "revision_history"), "snp": ("snapshot", "snapshot_branch"),
}


def allowed_relations(relations: dict[str, DataFrame], types: str = "*") -> dict[str, DataFrame]:
    """Relations owned by these types; the types of their targets aren't looked at."""
    kept = node_types(types)
    names = {r for t, owned in OWNED.items() if kept is None or t in kept for r in owned}
    return {k: v for k, v in relations.items() if k in names}


def _label(**fields: Column) -> Column:
    return F.struct(*[fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in LABEL.fields])


def arc_rows(relations: dict[str, DataFrame]) -> DataFrame:
    """(src, dst, label) with identifiers as text, repeats included; label is null for unlabelled arcs."""
    none = F.lit(None).cast(LABEL)
    made = {
        "directory_entry": lambda t: t.select(swhid("dir", F.col("directory_id")), swhid(target_type(F.col("type")), F.col("target")), _label(name=F.col("name"), permission=permission(F.col("perms")))),
        "origin_visit_status": lambda t: t.where("snapshot is not null").select(
            origin_swhid(F.col("origin")), swhid("snp", F.col("snapshot")),
            _label(visit_timestamp=F.coalesce(seconds(F.col("date")), F.lit(0)), is_full_visit=F.coalesce(F.col("status") == "full", F.lit(False)), visit_type=visit_class(F.col("type"), F.col("origin"))),
        ),
        "release": lambda t: t.select(swhid("rel", F.col("id")), swhid(target_type(F.col("target_type")), F.col("target")), none),
        "revision": lambda t: t.select(swhid("rev", F.col("id")), swhid("dir", F.col("directory")), none),
        "revision_history": lambda t: t.select(swhid("rev", F.col("id")), swhid("rev", F.col("parent_id")), none),
        "snapshot_branch": lambda t: t.where("target_type <> 'alias'").select(swhid("snp", F.col("snapshot_id")), swhid(target_type(F.col("target_type")), F.col("target")), _label(name=F.col("name"))),
    }
    parts = [f(relations[name]).toDF("src", "dst", "label") for name, f in made.items() if name in relations]
    return reduce(DataFrame.unionByName, parts).where("src is not null and dst is not null")


def node_rows(relations: dict[str, DataFrame]) -> DataFrame:
    """Distinct identifiers: of all objects, and of all ends of arcs, so that targets that are nowhere else are nodes."""
    own = {"content": "sha1_git", "skipped_content": "sha1_git", "directory": "id", "release": "id", "revision": "id", "snapshot": "id"}
    types = {"content": "cnt", "skipped_content": "cnt", "directory": "dir", "release": "rel", "revision": "rev", "snapshot": "snp"}
    parts = [relations[r].select(swhid(types[r], F.col(c)).alias("swhid")) for r, c in own.items() if r in relations]
    if "origin" in relations:
        parts.append(origins(relations).select("swhid"))
    arcs = arc_rows(relations)
    parts.append(arcs.select(F.explode(F.array("src", "dst")).alias("swhid")))
    return reduce(DataFrame.unionByName, parts).where("swhid is not null").distinct()


def origins(relations: dict[str, DataFrame]) -> DataFrame:
    return relations["origin"].select("url", origin_swhid(F.col("url")).alias("swhid"))


def label_name_rows(relations: dict[str, DataFrame]) -> DataFrame:
    """Distinct names of directory entries and of branches that aren't aliases."""
    return arc_rows({k: v for k, v in relations.items() if k in ("directory_entry", "snapshot_branch")}).where("label.name is not null").select("label.name").distinct()


def person_rows(relations: dict[str, DataFrame]) -> DataFrame:
    """Distinct full names of authors and committers."""
    parts = [relations[r].select(F.explode(F.array(*c)).alias("fullname")) for r, c in (("revision", ["author", "committer"]), ("release", ["author"])) if r in relations]
    return reduce(DataFrame.unionByName, parts).where("fullname is not null").distinct()


def persons(relations: dict[str, DataFrame]) -> DataFrame:
    """person_id and pseudonym, numbered by pseudonym."""
    return numbered(person_rows(relations).select(person_key(F.col("fullname")).alias("pseudonym")).distinct(), ["pseudonym"], "person_id").select("person_id", "pseudonym")


def person_fullnames(relations: dict[str, DataFrame]) -> DataFrame:
    """person_id and full name, for those who may see them; a wrong hash in the relation is an error."""
    rows = relations["person"].where("fullname is not null")
    right = F.assert_true(F.sha2("fullname", 256) == F.lower(F.hex("sha256_fullname")), "the hash of a full name is wrong")
    rows = rows.select("fullname", right.alias("checked"), person_key(F.col("fullname")).alias("pseudonym")).where("checked is null").drop("checked")
    return persons(relations).join(rows, "pseudonym").select("person_id", "fullname").distinct()


def edge_counts(relations: dict[str, DataFrame]) -> DataFrame:
    """Rows, not distinct arcs, by the types of their ends."""
    return arc_rows(relations).groupBy(swhid_type(F.col("src")).alias("src_type"), swhid_type(F.col("dst")).alias("dst_type")).agg(F.count("*").alias("count"))


def estimates(relations: dict[str, DataFrame]) -> dict[str, int]:
    """Upper bounds of the numbers of nodes and arcs, from row counts alone."""
    objects, links = ("content", "skipped_content", "directory", "release", "revision", "snapshot", "origin"), ("directory_entry", "origin_visit_status", "release", "revision", "revision_history", "snapshot_branch")
    n = {name: df.count() for name, df in relations.items() if name in {*objects, *links}}
    return {"nodes": sum(n.get(x, 0) for x in objects), "arcs": sum(n.get(x, 0) for x in links)}


def numbered_graph(nodes: DataFrame, arcs: DataFrame) -> PropertyGraph:
    """Nodes (swhid, properties) numbered by identifier; arc rows (src, dst, label) grouped to one arc a pair.

    Labels of an arc are sorted and keep their repeats. An end that is no node is an error.
    """
    nodes = written(numbered(nodes, ["swhid"], "node_id").withColumn("node_type", swhid_type(F.col("swhid"))), "nodes")
    labels = F.sort_array(F.collect_list("label"))  # nulls, of unlabelled arcs, aren't collected
    arcs = arcs.groupBy("src", "dst").agg(labels.alias("labels"))
    ids = nodes.select("node_id", "swhid", "node_type")
    for end in ("src", "dst"):
        found = ids.select(F.col("swhid").alias(end), F.col("node_id").alias(f"{end}_id"), F.col("node_type").alias(f"{end}_type"))
        arcs = arcs.join(found, end, "left")
    known = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit("an end of an arc is no node"))).otherwise(F.col(c))
    arcs = arcs.select(known("src_id").alias("src"), known("dst_id").alias("dst"), "src_type", "dst_type", F.col("labels").cast(f"array<{LABEL_DDL}>").alias("labels"))
    return PropertyGraph.of(nodes, arcs)


def properties(relations: dict[str, DataFrame]) -> DataFrame:
    """A row for each object with properties, by swhid; of repeated objects the largest row stays."""
    people = persons(relations) if {"revision", "release"} & relations.keys() else None
    parts = []
    if {"content", "skipped_content"} & relations.keys():
        for r, skipped in (("content", False), ("skipped_content", True)):
            if r in relations:
                parts.append(relations[r].where("sha1_git is not null").select(swhid("cnt", F.col("sha1_git")).alias("swhid"), "length", F.lit(skipped).alias("is_skipped")))
    offset = lambda date, c: F.when(F.col(date).isNotNull(), F.col(c)).cast("smallint")
    who = lambda c: person_key(F.col(c)).alias(f"_{c}")
    if "revision" in relations:
        parts.append(relations["revision"].select(
            swhid("rev", F.col("id")).alias("swhid"), seconds(F.col("date")).alias("author_ts"), offset("date", "date_offset").alias("author_ts_offset"),
            seconds(F.col("committer_date")).alias("committer_ts"), offset("committer_date", "committer_offset").alias("committer_ts_offset"), who("author"), who("committer"), "message",
        ))
    if "release" in relations:
        parts.append(relations["release"].select(swhid("rel", F.col("id")).alias("swhid"), seconds(F.col("date")).alias("author_ts"), offset("date", "date_offset").alias("author_ts_offset"), who("author"), "message", F.col("name").alias("tag_name")))
    if "origin" in relations:
        parts.append(origins(relations).select("swhid", "url", F.col("url").cast("binary").alias("message")))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    columns = [c for c in rows.columns if c != "swhid"]
    rows = rows.groupBy("swhid").agg(F.max(F.struct(*columns)).alias("p")).select("swhid", "p.*")
    if people is not None:
        for c in ("author", "committer"):
            if f"_{c}" in rows.columns:
                rows = rows.join(people.select(F.col("pseudonym").alias(f"_{c}"), F.col("person_id").alias(f"{c}_id")), f"_{c}", "left").drop(f"_{c}")
    return rows


def build(relations: dict[str, DataFrame], types: str = "*") -> PropertyGraph:
    """The graph of these relations, restricted to those that the types own."""
    kept = allowed_relations(relations, types)
    nodes = node_rows(kept).join(properties(kept), "swhid", "left")
    if "is_skipped" in nodes.columns:
        nodes = nodes.withColumn("is_skipped", F.coalesce("is_skipped", F.lit(False)))
    return numbered_graph(nodes, arc_rows(kept))


def problems(graph: PropertyGraph, legal: tuple[str, ...]) -> DataFrame:
    """Checks after a build, a row for each that fails: loops, illegal arc types, ends without node, repeated ids."""
    arcs, ids = graph.arcs, graph.nodes.select("node_id")
    kind = F.concat_ws(":", "src_type", "dst_type")
    ends = arcs.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("n"))  # of a node at once: far fewer rows than ends
    ends = ends.unionByName(graph.transpose().arcs.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("n")))
    found = [
        arcs.where("src = dst").agg(F.lit("loops").alias("problem"), F.count("*").alias("n")),
        arcs.where(~kind.isin(*legal)).agg(F.lit("illegal arcs").alias("problem"), F.count("*").alias("n")),
        ids.groupBy("node_id").count().where("count > 1").agg(F.lit("repeated ids").alias("problem"), F.count("*").alias("n")),
        ends.join(unsent(ids), "node_id", "left_anti").agg(F.lit("ends without node").alias("problem"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")),
    ]
    return reduce(DataFrame.unionByName, found).where("n > 0")
