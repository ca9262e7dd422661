"""The one recursion: layer after layer of a breadth-first walk, as tables.

A layer is a table of its own in the shared folder; a round joins it with the arcs,
drops what earlier rounds found and writes the next layer. Where the arcs' types
can't form a cycle, or the depth is small, unrolled() states all rounds as one lazy
plan instead. Ranks, the order in which a queue would hold the nodes, are made only
where a budget of arcs or nodes needs them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.parse import Arcs
from arcweave.plans.tables import counted, numbered, unsent, written
from arcweave.schema import LEGAL_ARCS, NODE_TYPES

#: Rounds that are stated as one plan at most.
UNROLLED = 3
#: Rows of a layer up to which it is sent to the arcs rather than shuffled with them.
SMALL = 200_000


#: Arcs that a task sorts, where a layer is shuffled with them.
PART = 2_000_000
#: Nodes of a layer up to which they are given to the scan of the arcs, which are sorted by source and skip what they can't be in.
FEW = 500
#: Blocks of 4,096 ids up to which a set of nodes is sent as bits, of half a kilobyte a block.
BLOCKS = 20_000


def small(layer: DataFrame, n: int) -> DataFrame:
    """layer, of n rows, as the side of a join that is sent whole if it is small."""
    return F.broadcast(layer) if n <= SMALL else unsent(layer)


def marked(rows: DataFrame, end: str, ids: DataFrame, n: int, name: str) -> DataFrame:
    """rows with the column name: whether end is among the n distinct ids (node_id)."""
    place = "cast({0} & 63 as int)"
    words = ids.groupBy(F.expr("shiftright(node_id, 6)").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, {place.format('node_id')})")).alias("bits"))
    blocks = words.groupBy(F.expr("shiftright(word, 6)").alias("block")).agg(F.map_from_entries(F.collect_list(F.struct(F.expr(place.format("word")), "bits"))).alias("words"))
    blocks, n_blocks = counted(blocks.select("block", F.expr("transform(sequence(0, 63), i -> coalesce(try_element_at(words, i), 0L))").alias("words")), "blocks")
    if n_blocks > BLOCKS:
        found = small(ids.select(F.col("node_id").alias(end), F.lit(True).alias(name)), n)
        return rows.join(found, end, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    bit = f"shiftright(words[{place.format(f'shiftright({end}, 6)')}], {place.format(end)}) & 1 = 1"
    return rows.join(F.broadcast(blocks), F.expr(f"shiftright({end}, 12) = block"), "left").withColumn(name, F.coalesce(F.expr(bit), F.lit(False))).drop("block", "words")


class Walk:
    """A walk from sources (node; repeats count) over arcs (src, dst).

    The sources aren't marked as seen, so one that is reached again is found again.
    ranked: each layer has rank, and parents are those of the least rank; else they
    are the smallest. most_arcs: arcs beyond this number, in order, don't count.
    """

    def __init__(self, arcs: DataFrame, sources: DataFrame, most_arcs: int | None = None, ranked: bool = False, mark_sources: bool = False):
        self.arcs, self.most, self.ranked = arcs, most_arcs, ranked or most_arcs is not None
        columns = ["node", F.lit(None).cast("bigint").alias("parent"), F.lit(0).alias("depth")]
        if not self.ranked:
            first = sources.select(*columns)
        elif "rank" in sources.columns:
            first = sources.select(*columns, "rank")
        else:
            first = numbered(sources.select(*columns), ["node"], "rank").select("node", "parent", "depth", "rank")
        first, self.nodes = counted(first, "layer")
        self.layers = [first]
        self.arc_rows: list[DataFrame] = []  # of each round, in ranked walks: src, dst, seq
        self.seen = self.layers[0].select("node").distinct() if mark_sources else None
        self.n_seen = self.nodes if mark_sources else 0
        self.parts: int | None = None
        self.used = 0

    @property
    def last(self) -> DataFrame:
        return self.layers[-1]

    def step(self) -> bool:
        """The next layer; False, and no layer, where there is none."""
        layer, depth, arcs = small(self.last, self.nodes), len(self.layers), self.arcs
        if self.nodes <= FEW:
            arcs = arcs.where(F.col("src").isin(*{r.node for r in self.last.select("node").collect()}))
        if self.ranked:
            out = arcs.join(layer.select(F.col("node").alias("src"), "rank"), "src").select("src", "dst", "rank")
            if self.most is not None:  # at most as many rows as are left of the budget
                out = out.orderBy("rank", "dst").limit(max(0, self.most - self.used))
            out = numbered(out, ["rank", "dst"], "seq", self.used + 1)
            out, n = counted(out, "arcs")
            self.used += n
            self.arc_rows.append(out)
            found = out.groupBy(F.col("dst").alias("node")).agg(F.min("seq").alias("order"), F.min_by("src", "seq").alias("parent"))
        else:
            met = arcs if self.nodes <= FEW else self._met(layer.select(F.col("node").alias("src")).distinct())
            found = met.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        if self.seen is not None:  # no anti join: Spark moves that below the meeting and shuffles all arcs by their other end for it
            found = found.join(small(self.seen.select("node", F.lit(True).alias("old")), self.n_seen), "node", "left").where("old is null").drop("old")
        new = found.withColumn("depth", F.lit(depth))
        new = numbered(new, ["order"], "rank").select("node", "parent", "depth", "rank") if self.ranked else new.select("node", "parent", "depth")
        new, self.nodes = counted(new, "layer")
        if not self.nodes:
            return False
        self.layers.append(new)
        nodes = new.select("node")
        self.n_seen += self.nodes
        self.seen = nodes if self.seen is None else self.seen.union(nodes)
        if len(self.layers) % 10 == 0:
            self.seen = written(self.seen, "seen")
        return True

    def _met(self, layer: DataFrame) -> DataFrame:
        """Arcs of a layer; where both are shuffled, so many parts that a task sorts PART arcs or so, if the session has fewer.

        Only arcs from the layer's range of ids are: the scan skips the others.
        """
        if self.nodes > SMALL:
            if self.parts is None:
                self.parts = max(1 + self.arcs.count() // PART, int(self.arcs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
            least, most = self.last.agg(F.min("node"), F.max("node")).first()
            arcs = self.arcs.where(F.col("src").between(least, most))
            return unsent(arcs.repartition(self.parts, "src")).join(layer.repartition(self.parts, "src"), "src")
        return self.arcs.join(F.broadcast(layer), "src")

    def run(self, max_depth: int | None) -> DataFrame:
        """All layers in one table: node, parent, depth (and rank)."""
        while (max_depth is None or len(self.layers) <= max_depth) and self.step():
            pass
        return self.visited()

    def visited(self) -> DataFrame:
        return reduce(DataFrame.union, self.layers)


def acyclic_depth(arcs: Arcs | None, start: frozenset[str] | None, backward: bool) -> int | None:
    """Longest walk over types that these arc types allow; None if it has no end."""
    legal = {tuple(reversed(a.split(":")) if backward else a.split(":")) for a in LEGAL_ARCS}
    found = legal if arcs is None else legal & arcs
    depth, layer = 0, set(start or NODE_TYPES)
    while layer := {b for a, b in found if a in layer}:
        depth += 1
        if depth > len(NODE_TYPES):
            return None
    return depth


def unrolled(arcs: DataFrame, sources: DataFrame, ids: list[int], depth: int) -> DataFrame:
    """node and depth (least number of arcs) of so many rounds, as one lazy plan; sources (ids, as rows) come once for each time they stand.

    Few sources are given to the scan of the arcs, more are sent to it. How large later
    layers are isn't known, so they are shuffled with the arcs.
    """
    parts = []
    for d in range(1, depth + 1):
        if d > 1:
            met = unsent(arcs).join(layer.select(F.col("node").alias("src")), "src")
        elif len(set(ids)) <= FEW:
            met = arcs.where(F.col("src").isin(*set(ids)))
        else:
            met = arcs.join(small(sources.select(F.col("node").alias("src")).distinct(), len(ids)), "src")
        layer = met.select(F.col("dst").alias("node")).distinct()
        parts.append(layer.withColumn("depth", F.lit(d)))
    first = sources.select("node", F.lit(0).alias("depth"))
    return first if not parts else first.union(reduce(DataFrame.union, parts).groupBy("node").agg(F.min("depth").alias("depth")))
