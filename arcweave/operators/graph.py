"""The property graph: its tables, primitives and lazy views."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.functions.identifiers import swhid_bytes, swhid_of_bytes
from arcweave.parse import MissingProperty, NotFound, Swhid, edge_predicate, edges, node_types, reverse_edges
from arcweave.plans.frontier import PART, marked
from arcweave.plans.tables import counted, numbered, setting, unsent
from arcweave.schema import ARC_COLUMNS, LABEL_DDL, NODE_COLUMNS, PROPERTIES


def with_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with exactly these columns; what it lacks is null, so an absent property is a missing value."""
    have = set(df.columns)
    return df.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])


@dataclass(frozen=True)
class PropertyGraph:
    """nodes and arcs as in schema.NODE_COLUMNS and ARC_COLUMNS; everything derived is lazy.

    back: the same arcs with their ends swapped, where they are stored so; groups:
    the groups of properties that are there, all others being null; loose: the arcs
    before nodes were left out, so that some may have ends that are no nodes.
    """

    nodes: DataFrame
    arcs: DataFrame
    transposed: bool = False
    back: DataFrame | None = None
    groups: frozenset[str] = frozenset(PROPERTIES)
    loose: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    # reading and writing

    @classmethod
    def of(cls, nodes: DataFrame, arcs: DataFrame) -> PropertyGraph:
        return cls(unsent(with_columns(nodes, NODE_COLUMNS)), unsent(with_columns(arcs, ARC_COLUMNS)))

    @classmethod
    def load(cls, spark: SparkSession, path: str, properties: bool | Iterable[str] = True, labels: bool = True, optional: Iterable[str] = ()) -> PropertyGraph:
        """Of a folder written by save(); what isn't loaded is null, labels empty.

        properties: all groups that are stored, none, or names of groups, each of
        which must be stored unless it's optional.
        """
        nodes, arcs, back = (unsent(spark.read.parquet(f"{path}/{part}")) for part in ("nodes", "arcs", "arcs_back"))
        stored = frozenset(g for g, columns in PROPERTIES.items() if set(columns) <= set(nodes.columns))
        wanted = stored if properties is True else frozenset(properties or ())
        if unknown := wanted - set(PROPERTIES):
            raise MissingProperty(f"no such group of properties: {', '.join(sorted(unknown))}")
        if missing := wanted - stored - set(optional):
            raise MissingProperty(f"not stored: {', '.join(sorted(missing))}")
        groups = wanted & stored
        nodes = nodes.select("node_id", "node_type", "swhid", *(c for g in PROPERTIES if g in groups for c in PROPERTIES[g]))
        graph = cls(with_columns(nodes, NODE_COLUMNS), with_columns(arcs, ARC_COLUMNS), back=with_columns(back, ARC_COLUMNS), groups=groups)
        return graph if labels else graph.without_labels()

    def save(self, path: str) -> None:
        """Arcs lie in folders by the types of their ends, sorted by source, and once more by destination with their ends swapped; nodes by id.

        Columns of absent groups aren't written.
        """
        absent = [c for g, columns in PROPERTIES.items() if g not in self.groups for c in columns]
        self.nodes.drop(*absent).repartitionByRange("node_id").sortWithinPartitions("node_id").write.parquet(f"{path}/nodes")
        for name, arcs in (("arcs", self.arcs), ("arcs_back", self.transpose().arcs)):
            arcs.repartitionByRange("src_type", "dst_type", "src").sortWithinPartitions("src", "dst").write.partitionBy("src_type", "dst_type").parquet(f"{path}/{name}")

    # primitives

    def num_nodes(self) -> int:
        return self.nodes.count()

    def num_arcs(self) -> int:
        return self.arcs.count()

    def successors(self, node: int) -> DataFrame:
        return self.arcs.where(F.col("src") == node).select(F.col("dst").alias("node_id")).orderBy("node_id")

    def predecessors(self, node: int) -> DataFrame:
        return self.transpose().successors(node)

    def labelled_successors(self, node: int) -> DataFrame:
        return self.arcs.where(F.col("src") == node).select(F.col("dst").alias("node_id"), "labels").orderBy("node_id")

    def labelled_predecessors(self, node: int) -> DataFrame:
        return self.transpose().labelled_successors(node)

    def outdegrees(self) -> DataFrame:
        """Every node with the number of its distinct successors, zeros included."""
        n = self.arcs.groupBy("src").agg(F.count("*").alias("degree"))
        return self.nodes.select("node_id", "node_type").join(n, F.col("node_id") == F.col("src"), "left").select("node_id", "node_type", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))

    def indegrees(self) -> DataFrame:
        return self.transpose().outdegrees()

    def has_arc(self, src: int, dst: int) -> bool:
        return not self.arcs.where((F.col("src") == src) & (F.col("dst") == dst)).isEmpty()

    def has_node(self, node: int) -> bool:
        return not self.nodes.where(F.col("node_id") == node).isEmpty()

    def flat_labels(self) -> DataFrame:
        """A row for each label of each arc; arcs without labels have none."""
        return self.arcs.select("src", "dst", "src_type", "dst_type", F.explode("labels").alias("label")).select("src", "dst", "src_type", "dst_type", "label.*")

    def node_ids(self, swhids: list[str]) -> list[int]:
        """Ids in the order asked for, repeats included; unknown ones are an error."""
        texts = [str(Swhid.parse(s)) for s in swhids]
        found = {r.swhid: r.node_id for r in self.nodes.where(F.col("swhid").isin(*set(texts))).select("swhid", "node_id").collect()} if texts else {}
        if missing := [s for s in texts if s not in found]:
            raise NotFound(f"unknown identifiers: {', '.join(missing[:5])}")
        return [found[s] for s in texts]

    def label_names(self) -> DataFrame:
        """Distinct names of labels, numbered in the order of their bytes."""
        return numbered(self.flat_labels().where("name is not null").select("name").distinct(), ["name"], "label_name_id")

    def label_name_ids(self, names: DataFrame) -> DataFrame:
        """name and label_name_id of the rows (name) of names; null for names of no label."""
        return names.select(F.col("name").cast("binary").alias("name")).join(self.label_names(), "name", "left")

    def names_of_labels(self, ids: DataFrame) -> DataFrame:
        """label_name_id and name of the rows (label_name_id) of ids; null for ids of no label."""
        return ids.select(F.col("label_name_id").cast("bigint").alias("label_name_id")).join(self.label_names(), "label_name_id", "left")

    def property(self, name: str, base64: bool = False) -> DataFrame:
        """node_id and one property, null where a node has none; an error where its group isn't loaded.

        base64: of messages and names, as text.
        """
        group = next((g for g, columns in PROPERTIES.items() if name in columns), None)
        if group is None or group not in self.groups:
            raise MissingProperty(f"{name} isn't loaded" if group else f"no such property: {name}")
        return self.nodes.select("node_id", F.base64(name).alias(f"{name}_base64") if base64 else F.col(name))

    # views

    def subgraph(self, node_filter: Column | Callable[[DataFrame], DataFrame] | None = None, arc_filter: Column | None = None) -> PropertyGraph:
        """Arcs of which both ends and the arc itself pass; the filters are Spark predicates."""
        nodes = self.nodes if node_filter is None else node_filter(self.nodes) if callable(node_filter) else self.nodes.where(node_filter)

        def kept(arcs: DataFrame) -> DataFrame:
            if node_filter is not None:
                for end in ("src", "dst"):
                    arcs = arcs.join(unsent(nodes.select(F.col("node_id").alias(end))), end, "left_semi")
            return arcs.select(*self.arcs.columns)

        arcs = kept(self.arcs if arc_filter is None else self.arcs.where(arc_filter))
        back = None if self.back is None or arc_filter is not None else kept(self.back)
        loose = self.arcs if self.loose is None or callable(node_filter) else self.loose  # a function may bring back nodes that were left out
        return replace(self, nodes=nodes, arcs=arcs, back=back, loose=loose if arc_filter is None else loose.where(arc_filter))

    def with_types(self, types: str) -> PropertyGraph:
        """Only nodes of these types; decided on the arcs' own types, without a join."""
        kept = node_types(types)
        if kept is None:
            return self
        both = F.col("src_type").isin(*kept) & F.col("dst_type").isin(*kept)
        return replace(self, nodes=self.nodes.where(F.col("node_type").isin(*kept)), arcs=self.arcs.where(both), back=None if self.back is None else self.back.where(both), loose=None)

    def with_edges(self, restriction: str) -> PropertyGraph:
        """Only arcs of these types, in the orientation of this view."""
        found = edge_predicate(edges(restriction))
        if found is None:
            return self
        back = None if self.back is None else self.back.where(edge_predicate(edges(reverse_edges(restriction))))
        return replace(self, arcs=self.arcs.where(found), back=back, loose=None)

    def transpose(self) -> PropertyGraph:
        """Arcs the other way: as they are stored, else with their columns swapped."""
        if self.back is not None:
            return replace(self, arcs=self.back, back=self.arcs, transposed=not self.transposed, loose=None)
        a = self.arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("dst_type").alias("src_type"), F.col("src_type").alias("dst_type"), "labels")
        return replace(self, arcs=a, back=self.arcs, transposed=not self.transposed, loose=None)

    def contiguous(self) -> PropertyGraph:
        """Nodes numbered anew from 0 in the order of their ids; arcs of nodes that aren't there go."""
        new = numbered(self.nodes.select("node_id"), ["node_id"], "new_id")
        nodes = self.nodes.join(new, "node_id").withColumn("node_id", F.col("new_id")).drop("new_id")
        arcs = self.arcs
        for end in ("src", "dst"):
            arcs = arcs.join(new.select(F.col("node_id").alias(end), "new_id"), end).withColumn(end, F.col("new_id")).drop("new_id")
        return replace(self, nodes=nodes, arcs=arcs.select(*self.arcs.columns), back=None, loose=None)

    def symmetric(self) -> DataFrame:
        """Distinct (src, dst) of both directions; a loop is an error."""
        a = self.arcs.select("src", F.when(F.col("src") == F.col("dst"), F.raise_error(F.lit("a loop")).cast("bigint")).otherwise(F.col("dst")).alias("dst"))
        return a.union(a.select("dst", "src")).toDF("src", "dst").distinct()

    def without_labels(self) -> PropertyGraph:
        bare = lambda arcs: arcs.withColumn("labels", F.array().cast(f"array<{LABEL_DDL}>"))
        return replace(self, arcs=bare(self.arcs), back=None if self.back is None else bare(self.back), loose=None)

    def masked(self, hidden: DataFrame) -> PropertyGraph:
        """Without the nodes of the swhid column of hidden; unknown ones are passed over."""
        return self.subgraph(lambda nodes: nodes.join(hidden.select("swhid").distinct(), "swhid", "left_anti").select(*nodes.columns))

    def only(self, identifiers: DataFrame) -> PropertyGraph:
        """The nodes of the swhid column of identifiers, and the arcs between them."""
        return self.subgraph(lambda nodes: nodes.join(identifiers.select("swhid").distinct(), "swhid", "left_semi").select(*nodes.columns))

    def unknown(self, identifiers: DataFrame) -> DataFrame:
        """Rows (swhid) of identifiers that are no nodes, each once."""
        return identifiers.select("swhid").distinct().join(self.nodes.select("swhid"), "swhid", "left_anti")

    # comparison

    def difference(self, other: PropertyGraph, labels: bool = True, properties: bool = True) -> DataFrame:
        """Rows (side, kind, key) of what stands in one graph alone; empty for equal ones. Nodes go by swhid.

        Nodes of both are counted together, once. So are arcs, by ids, but where nodes were
        left out of one table of arcs, which needs no comparison with itself. Only arcs that
        may differ get identifiers.
        """
        columns = [c for c in NODE_COLUMNS if c != "node_id" and (properties or c in ("swhid", "node_type"))]
        rest, ident, more = [c for c in columns if c != "swhid"], ["short", "text"], ["labels"] if labels else []
        parts = max(1 + (self.num_nodes() + other.num_nodes()) // PART, int(self.spark.conf.get("spark.sql.shuffle.partitions")))

        def both(mine: DataFrame, theirs: DataFrame) -> DataFrame:
            """Rows of both; l is 1 for one of the left, r for one of the right."""
            return mine.select("*", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(theirs.select("*", F.lit(0).alias("l"), F.lit(1).alias("r")))

        def counts(rows: DataFrame, *by: str) -> DataFrame:
            return rows.groupBy(*by).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))

        def alone(rows: DataFrame, kind: str, *key: str) -> DataFrame:
            """Rows with n, a row for each time: of the left above 0, of the right below."""
            side = F.when(F.col("n") > 0, "left").otherwise("right").alias("side")
            rows = rows.where("n <> 0").select(side, F.lit(kind).alias("kind"), F.to_json(F.struct(*key)).alias("key"), F.abs("n").cast("int").alias("n"))
            return rows.withColumn("n", F.explode(F.array_repeat(F.lit(0), F.col("n")))).drop("n")

        def short(nodes: DataFrame) -> DataFrame:
            """With identifiers as bytes where these give the text again."""
            packed = swhid_bytes(F.col("swhid"))
            nodes = nodes.select("node_id", F.when(swhid_of_bytes(packed) == F.col("swhid"), packed).alias("short"), "swhid", *rest)
            return nodes.withColumn("text", F.when(F.col("short").isNull(), F.col("swhid"))).drop("swhid")

        whole = lambda name="": F.coalesce(f"{name}text", swhid_of_bytes(F.col(f"{name}short")))

        # A row for each id with an identifier: how often it stands, and what of it stands more often on one side.
        rows = counts(both(short(self.nodes), short(other.nodes)).repartition(parts, "node_id"), "node_id", *ident, *rest)
        apart = F.when(F.col("l") != F.col("r"), F.struct(*rest, (F.col("l") - F.col("r")).alias("n")))
        ids = rows.groupBy("node_id", *ident).agg(F.sum("l").alias("l"), F.sum("r").alias("r"), F.collect_list(apart).alias("apart"))
        with setting(self.spark, "spark.sql.execution.useObjectHashAggregateExec", "false"), setting(self.spark, "spark.sql.parquet.compression.codec", "zstd"):
            ids, n_ids = counted(ids, "ids")
        nodes = ids.select(*ident, F.explode("apart").alias("apart")).select(*ident, "apart.*").groupBy(*ident, *rest).agg(F.sum("n").alias("n"))
        nodes = alone(nodes.withColumn("swhid", whole()), "node", *columns)

        odd, n_odd = counted(ids.where("l <> r").select("node_id").distinct(), "odd")
        mine, theirs = (g.arcs if g.loose is None else g.loose for g in (self, other))
        one = mine is theirs
        renamed = not one and 2 * n_odd > n_ids  # most ids stand for other nodes: arcs are counted by identifiers alone
        if one:
            arcs = mine.select("src", "dst", *more, F.lit(1).alias("l"), F.lit(1).alias("r"))
        else:
            arcs = both(*(a.select("src", "dst", *more) for a in (mine, theirs)))
        if not renamed:
            arcs = arcs if one else counts(arcs, "src", "dst", *more)
            # As often left as right, between ends that stand as often left as right (or nowhere): no difference.
            for end in ("src", "dst"):
                arcs = marked(arcs, end, odd, n_odd, f"{end}_odd")
            arcs = arcs.where("l <> r or src_odd or dst_odd").drop("src_odd", "dst_odd")
        for end, name in (("src", "a"), ("dst", "b")):
            found = ids.select(F.col("node_id").alias(end), *(F.col(c).alias(f"{name}_{c}") for c in (*ident, "l", "r")))
            arcs = unsent(arcs.repartition(parts, end)).join(unsent(found.repartition(parts, end)), end)
        arcs = arcs.withColumn("n", F.col("l") * F.col("a_l") * F.col("b_l") - F.col("r") * F.col("a_r") * F.col("b_r")).where("n <> 0")
        if renamed or not ids.groupBy(F.xxhash64(*ident)).count().where("count > 1").isEmpty():  # else each identifier has one id
            arcs = arcs.groupBy(*(f"{name}_{c}" for name in "ab" for c in ident), *more).agg(F.sum("n").alias("n"))
        return nodes.unionByName(alone(arcs.withColumn("a", whole("a_")).withColumn("b", whole("b_")), "arc", "a", "b", *more))
