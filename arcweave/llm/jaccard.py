"""Exact Jaccard join of documents' word shingles, to components of linked documents.

Documents of equal sets are one set. A set whose shingles are mostly in no other set
can't be linked: this is first shown for the lowest hashes of each set, of which a
linked pair shares a known number, and then for all shingles of the sets that are
left. What stays is ordered by rarity, the same order for all sets, so that linked
sets share one of their first shingles; lists of sets by such a shingle are an index
in which whole blocks are skipped:

- by set relation: each set is compared once with the set that heads most of its
  lists (heads have the fewest shingles of their own), and hangs on it if they are
  alike. The difference from its root is then known for every set;
- by position and size: two sets in a list, or two blocks of sets of one root, are
  skipped if what stands before and after the shared shingle can't make a link;
- by derived answers: |A ^ B| = |A ^ R| + |B ^ R| - 2 |(A ^ R) & (B ^ R)|. Sets
  near enough to the best set of their root are linked with it and done. For others
  the answers with all sets of the root follow from a join of the differences alone,
  which have to share a known number of shingles. Between roots the distance, a
  metric, decides for whole blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.llm.common import BROADCAST_BYTES, in_small_batches, scratch, written
from arcweave.llm.components import components

#: Texts, or pairs of sets, that a Python worker holds at once.
BATCH = 512

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of width words; of all words if fewer; none without words."""
    words = (text or "").encode().translate(_LOWER).split()  # bytes split at 0x20 and 0x09 to 0x0D alone
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = _mixed(out * _A + h[k : k + n] + _B)
    return np.unique(out)


def needed(n: int, share: Fraction) -> int:
    """Least intersection of a set of n with any set it is linked with."""
    return -(-n * share.numerator // share.denominator)


def prefix(n: int, share: Fraction) -> int:
    """First shingles of a set of n of which any linked set has one."""
    return n - needed(n, share) + 1


def stored(n: int, share: Fraction) -> int:
    """Lowest hashes kept of a set of n: the prefix, and half as many again and four to spare."""
    p = prefix(n, share)
    return min(n, p + p // 2 + 4)


def shared_least(n: int, share: Fraction) -> int:
    """Least number of its stored hashes that a set of n shares with those of any linked set, whose size is needed(n) at least."""
    return min(prefix(needed(n, share), share) // 2 + 5, needed(n, share))


def _sets(docs: DataFrame, width: int, share: Fraction) -> DataFrame:
    """doc_id, n, digest, the lowest hashes, and how many of these a linked set has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, least, digests, firsts = [], [], [], []
            for text in b.column(1):
                s = shingles(text.as_py(), width)
                n.append(len(s)), digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                least.append(shared_least(len(s), share)), firsts.append(s[: stored(len(s), share)].view(np.int64))
            columns = [b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(least, pa.int64()), pa.array(firsts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "digest", "least", "firsts"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, digest binary, least long, firsts array<long>")


def _bounded(df: DataFrame, row: int) -> DataFrame:
    """With a broadcast hint if its rows, of so many bytes, are within the bound."""
    return F.broadcast(df) if df.count() * row <= BROADCAST_BYTES else df


class _Join:
    def __init__(self, docs: DataFrame, width: int, share: Fraction):
        self.docs, self.width, self.share = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width, share
        self.num, self.den = share.numerator, share.denominator
        with in_small_batches(docs.sparkSession, BATCH):
            every = written(_sets(docs, width, share), "sets")
        self.documents = written(every.select("doc_id", "n", "digest"), "documents", lasting=True)
        sets = every.where("n > 0 and doc_id is not null").groupBy("digest", "n").agg(F.min("doc_id").alias("doc_id"), F.first("least").alias("least"), F.first("firsts").alias("firsts"))
        self.sets = written(sets.withColumn("id", F.monotonically_increasing_id()), "distinct-sets")

    def _needed(self) -> Column:
        return F.expr(f"(n * {self.num} + {self.den - 1}) div {self.den}")

    def _sum_limit(self, sizes: Column, apart: Column) -> Column:
        """Whether two sets are linked, by the sum of their sizes and the size of their difference."""
        return (self.num + self.den) * apart <= (self.den - self.num) * sizes

    def hashes(self, ids: DataFrame) -> DataFrame:
        """(id, n, tokens) of the sets with these distinct ids, made anew from their documents' texts."""
        width = self.width
        wanted = written(self.sets.select("id", "doc_id", "digest").join(ids, "id"), "wanted")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = {}
                for text, digest, i in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                    s = shingles(text.as_py(), width)
                    if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == digest:  # else another text of the same doc_id
                        found[i] = s.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(map(len, found.values()), pa.int64()), pa.array(found.values(), pa.list_(pa.int64()))], ["id", "n", "tokens"])

        found = self.docs.join(_bounded(wanted, 60), "doc_id").select("text", "digest", "id").mapInArrow(run, "id long, n long, tokens array<long>")
        twice = self.documents.where("doc_id is not null").groupBy("doc_id", "digest").count().where("count > 1")
        return found if twice.isEmpty() else found.groupBy("id", "n").agg(F.first("tokens").alias("tokens"))

    def candidates(self) -> DataFrame:
        """(id, n, tokens) of the sets that share enough of their stored hashes with others."""
        rows = self.sets.select("id", F.explode("firsts").alias("token"))
        many = rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").select("token")
        shared = rows.join(many, "token").groupBy("id").agg(F.count("*").alias("k"))
        ids = self.sets.select("id", "least").join(shared, "id").where("k >= least").select("id")
        with in_small_batches(ids.sparkSession, BATCH):
            return written(self.hashes(ids), "candidates")

    def _shared(self, rows: DataFrame) -> DataFrame:
        """(id, n, shared) of the sets (id, n, token) of whose shingles enough are in others: these, rarest first."""
        many = rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
        kept = rows.join(many, "token").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
        return kept.where(F.size("shared") >= self._needed())

    def apart(self, pairs: DataFrame, keep: bool = False) -> DataFrame:
        """(a, b, sizes, apart) of distinct pairs: sum of sizes and size of the difference; with keep, the difference too, if it's under a third of the sum.

        The first set of each pair goes to the second, with which a join meets that can be split.
        """
        first = self.whole.join(_bounded(pairs.select(F.col("a").alias("id"), "b"), 40), "id").select(F.col("id").alias("a"), "b", F.col("tokens").alias("x"))
        second = self.whole.select(F.col("id").alias("b"), F.col("tokens").alias("y")).join(_bounded(pairs.select("b").distinct(), 24), "b")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sizes, apart, kept = [], [], []
                for x, y in zip(b.column(2), b.column(3)):
                    d = np.setxor1d(x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False), assume_unique=True)
                    sizes.append(len(x) + len(y)), apart.append(len(d))
                    kept.append(d if keep and 3 * len(d) <= sizes[-1] else None)
                columns = [b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(apart, pa.int64()), pa.array(kept, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", "sizes", "apart", "diff"])

        met = first.join(second, "b").select("a", "b", "x", "y")
        with in_small_batches(met.sparkSession, BATCH):
            return written(met.mapInArrow(run, "a long, b long, sizes long, apart long, diff array<long>"), "apart")

    def _hung(self, rows: DataFrame) -> DataFrame:
        """(id, root, diff) of the sets that hang on a root: the difference from it."""
        votes = rows.where("id <> head").groupBy("id", "head").agg(F.count("*").alias("votes"))
        heads = votes.groupBy("id").agg(F.max_by("head", F.struct("votes", -F.col("head"))).alias("head"))
        near = self.apart(written(heads.select(F.col("id").alias("a"), F.col("head").alias("b")), "heads"), keep=True).where("diff is not null")
        hung = near.select(F.col("a").alias("id"), F.col("b").alias("root"), "diff")
        while True:  # a head precedes all sets that hang on it, so the chains end, and halve each time
            up = hung.select(F.col("id").alias("root"), F.col("root").alias("above"), F.col("diff").alias("more"))
            if hung.join(up, "root", "left_semi").isEmpty():
                return hung
            both = F.array_union(F.array_except("diff", "more"), F.array_except("more", "diff"))
            hung = written(hung.join(up, "root", "left").select("id", F.coalesce("above", "root").alias("root"), F.when(F.col("above").isNull(), F.col("diff")).otherwise(both).alias("diff")), "hung")

    def links(self) -> DataFrame:
        """Links (a, b) between sets, enough for the components to be those of all links."""
        self.whole = self.candidates()
        shared = written(self._shared(self.whole.select("id", "n", F.explode("tokens").alias("token"))), "shared")
        shared = written(self._shared(shared.select("id", "n", F.explode("shared.token").alias("token"))), "shared")
        self.whole = written(self.whole.join(shared.select("id"), "id", "left_semi"), "whole")
        # i: place among the shared shingles, before which the set's own stand; own and i make the place in the order
        own = F.col("n") - F.size("shared")
        first = F.slice("shared", 1, (F.col("n") - self._needed() + 1 - own).cast("int"))
        index = shared.select("id", "n", own.alias("own"), F.posexplode(first).alias("i", "s")).select("id", "n", "own", "i", (F.col("n") - F.col("own") - F.col("i") - 1).alias("rest"), F.col("s.token").alias("token"))
        index = written(index, "index")
        lists = index.groupBy("token").agg(F.count("*").alias("sets"), F.min(F.struct("own", "id")).alias("head")).where("sets > 1")
        rows = written(index.join(lists.select("token", F.col("head.id").alias("head")), "token"), "lists")

        hung = self._hung(rows)
        all_sets = rows.select("id", "n").distinct()
        known = all_sets.join(hung, "id", "left").select("id", "n", F.coalesce("root", "id").alias("root"), F.coalesce("diff", F.array().cast("array<long>")).alias("diff"))
        # over + over of two sets of a root, less 2 (num + den) of each shared shingle of their differences, is 0 or less for linked sets
        known = written(known.withColumn("over", (self.num + self.den) * F.size("diff").cast("long") - (self.den - self.num) * F.col("n")), "known")
        best = known.groupBy("root").agg(F.min(F.struct("over", "id")).alias("best"), F.count("*").alias("sets")).where("sets > 1").select("root", "best")
        met = written(known.join(best, "root").withColumn("open", F.col("over") + F.col("best.over") > 0), "met")
        links = written(met.where("not open and id <> best.id").select(F.col("id").alias("a"), F.col("best.id").alias("b")), "links-of-roots")
        links = links.unionByName(self._within(met))
        return links.unionByName(self._between(rows.select("token", "id", "n", "i", "rest"), known, links))

    def _within(self, met: DataFrame) -> DataFrame:
        """Links of the sets left open with any set of the same root, by the shingles that their differences share."""
        unit = 2 * (self.num + self.den)
        roots = met.groupBy("root").agg(F.min("over").alias("low"), F.min(F.when(F.col("open"), F.col("over"))).alias("low_open")).where("low_open is not null")
        # an open set can be linked with any, another set with open ones: shared shingles needed at least
        low = F.when(F.col("open"), F.col("low")).otherwise(F.col("low_open"))
        rows = met.drop("best", "n").join(_bounded(roots, 40), "root").withColumn("least", F.greatest(F.lit(1), F.ceil((F.col("over") + low) / unit))).where(F.size("diff") >= F.col("least"))
        rows = written(rows.select("root", "id", "over", "open", "least", F.explode("diff").alias("token")), "differences")
        for _ in range(2):
            several = rows.groupBy("root", "token").agg(F.count("*").alias("df"), F.sum(F.col("open").cast("int")).alias("opened")).where("df > 1 and opened > 0")
            kept = rows.join(several, ["root", "token"]).groupBy("root", "id", "over", "open", "least").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
            kept = written(kept.where(F.size("shared") >= F.col("least")), "differences")
            rows = kept.select("root", "id", "over", "open", "least", F.explode("shared.token").alias("token"))
        if kept.isEmpty():
            return kept.select(F.col("id").alias("a"), F.col("id").alias("b"))
        index = kept.select("root", "id", "over", "open", F.size("shared").alias("k"), F.explode(F.slice("shared", 1, (F.size("shared") - F.col("least") + 1).cast("int"))).alias("s")).select("root", "id", "over", "open", "k", F.col("s.token").alias("token"))
        index = written(index, "differences-index")
        diffs = kept.select("id", "over", F.col("shared.token").alias("diff"))

        def linked(pairs: DataFrame) -> DataFrame:
            for end in ("a", "b"):
                pairs = pairs.join(diffs.select(F.col("id").alias(end), F.col("over").alias(f"over_{end}"), F.col("diff").alias(f"diff_{end}")), end)
            return written(pairs.where(unit * F.size(F.array_intersect("diff_a", "diff_b")) >= F.col("over_a") + F.col("over_b")).select("a", "b"), "links-of-differences")

        # open sets are first compared with the open set that heads most of their lists, then only sets of unlike components
        heads = index.where("open").groupBy("root", "token").agg(F.min(F.struct("over", "id")).alias("head"), F.count("*").alias("sets")).where("sets > 1")
        votes = index.where("open").join(heads, ["root", "token"]).where("id <> head.id").groupBy("id", F.col("head.id").alias("head")).agg(F.count("*").alias("votes"))
        links = linked(votes.groupBy("id").agg(F.max_by("head", F.struct("votes", -F.col("head"))).alias("b")).select(F.col("id").alias("a"), "b"))
        part = components(links).withColumnRenamed("node", "id")
        rows = written(index.join(part, "id", "left").select("root", "token", F.struct("id", "over", "open", "k", F.coalesce("component", F.when(F.col("open"), F.col("id")).otherwise(-1)).alias("part")).alias("set")), "differences-parts")
        unlike = rows.groupBy("root", "token").agg(F.min("set.part").alias("p0"), F.max("set.part").alias("p1")).where("p0 <> p1").select("root", "token")
        rows = rows.join(unlike, ["root", "token"])
        x, y = rows.where("set.open").withColumnRenamed("set", "x"), rows.withColumnRenamed("set", "y")
        pairs = x.join(y, ["root", "token"]).where("x.part <> y.part and (not y.open or x.id < y.id)").where(unit * F.least("x.k", "y.k") >= F.col("x.over") + F.col("y.over"))
        return links.unionByName(linked(pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()))

    def _possible(self, a: str, b: str) -> Column:
        """Whether two sets, or blocks of sets, can be linked that share a shingle, by size and place."""
        num, den = self.num, self.den
        sizes = (F.col(f"{a}.high") * den >= F.col(f"{b}.low") * num) & (F.col(f"{b}.high") * den >= F.col(f"{a}.low") * num)
        # what is shared before the shingle, itself, and what is shared after it
        most = F.least(F.col(f"{a}.before"), F.col(f"{b}.before")) + 1 + F.least(F.col(f"{a}.rest"), F.col(f"{b}.rest"))
        return sizes & (most * (num + den) >= (F.col(f"{a}.low") + F.col(f"{b}.low")) * num)

    def _between(self, rows: DataFrame, known: DataFrame, links: DataFrame) -> DataFrame:
        """Links of sets of different roots that share a prefix shingle."""
        part = components(links).withColumnRenamed("node", "id")
        root_n = known.where("id = root").select("root", F.col("n").alias("root_n"))
        far = F.size("diff") * 2 / (F.col("n") + F.col("root_n") + F.size("diff"))
        known = written(known.join(root_n, "root").join(part, "id", "left").select("id", "root", far.alias("d"), F.coalesce("component", "id").alias("part")), "parts")
        rows = rows.join(known, "id")
        blocks = rows.groupBy("token", "root").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("i").alias("before"), F.max("rest").alias("rest"), F.max("d").alias("far"), F.min("part").alias("p0"), F.max("part").alias("p1"))
        blocks = written(blocks, "blocks")
        several = blocks.groupBy("token").agg(F.count("*").alias("blocks")).where("blocks > 1").select("token")
        blocks = blocks.join(several, "token").select("token", F.struct("root", "low", "high", "before", "rest", "far", "p0", "p1").alias("x"))
        met = blocks.join(blocks.withColumnRenamed("x", "y"), "token").where("x.root < y.root and not (x.p0 = x.p1 and y.p0 = y.p1 and x.p0 = y.p0)").where(self._possible("x", "y"))
        roots = written(met.groupBy(F.col("x.root").alias("a"), F.col("y.root").alias("b")).agg(F.max(F.col("x.far") + F.col("y.far")).alias("far")), "roots")
        answers = self.apart(roots)
        found = answers.where(self._sum_limit(F.col("sizes"), F.col("apart"))).select("a", "b")
        # the sets of two roots may be linked only if these are near enough
        limit = float(1 - self.share) + 1e-9
        gap = F.col("apart") * 2 / (F.col("sizes") + F.col("apart"))
        near = written(answers.join(roots, ["a", "b"]).withColumn("gap", gap).where("far > 0").where(F.col("gap") - F.col("far") <= limit).select("a", "b", "gap"), "near-roots")
        if near.isEmpty():
            return found
        member = rows.select("token", "root", F.struct("id", "part", "d", F.col("n").alias("low"), F.col("n").alias("high"), F.col("i").alias("before"), "rest").alias("x"))
        left = near.join(member.withColumnRenamed("root", "a"), "a")
        both = left.join(member.select("token", F.col("root").alias("b"), F.col("x").alias("y")), ["b", "token"]).where("x.part <> y.part").where(F.col("gap") - F.col("x.d") - F.col("y.d") <= limit).where(self._possible("x", "y"))
        pairs = both.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
        answers = self.apart(written(pairs.join(answers, ["a", "b"], "left_anti"), "pairs"))
        return found.unionByName(answers.where(self._sum_limit(F.col("sizes"), F.col("apart"))).select("a", "b"))

    def result(self) -> DataFrame:
        part = components(self.links())
        sets = self.sets.select("id", "digest", "doc_id").join(part.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        lowest = sets.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        of = written(sets.join(lowest, "component").select("digest", "component_id"), "of-sets", lasting=True)
        found = self.documents.join(of, "digest", "left")
        own = F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        return found.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def linked_documents(docs: DataFrame, width: int = 3, share: Fraction = Fraction(9, 10)) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of docs.

    Two documents are linked if the intersection of their sets of word shingles is
    at least share of the union; component_id is the smallest doc_id reachable by
    links. Null and wordless texts have empty sets and are linked with nothing, as
    are rows without doc_id, whose component is null. Repeated rows give repeated
    rows. Columns besides doc_id and text aren't read.

    Documents of equal sets are one from the first step on, so copies are never
    paired. Near copies are compared with one set each; other pairs are made only
    between sets, or blocks of sets, that the bounds leave open. A text is read in
    one task, whatever its length, and stands there as one array of hashes.
    """
    with scratch(docs.sparkSession):
        return _Join(docs, width, share).result()


def keep_one(docs: DataFrame, width: int = 5, share: Fraction = Fraction(4, 5)) -> DataFrame:
    """One row of each component of texts, with all columns of docs: of the smallest doc_id, then text hash.

    Rows without doc_id are linked as others are, and come last. Of rows of equal
    doc_id and text one stays. Rows without words are linked with nothing and stay.
    """
    with scratch(docs.sparkSession):
        key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")  # one for each doc_id and text, never null
        k = next(n for n in map("_key{}".format, count()) if n not in docs.columns)
        keyed = docs.withColumn(k, key)
        found = linked_documents(docs.select(key.alias("doc_id"), "text"), width, share).where("n_shingles > 0").select(F.col("doc_id").alias(k), F.col("component_id").alias("component"))
        found = found.groupBy(k).agg(F.min("component").alias("component"), F.count("*").alias("copies"))
        rows = keyed.select(k, "doc_id", F.xxhash64("text").alias("copy")).distinct()
        members = written(found.join(rows, k), "members", lasting=True)
        best = members.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copy", k)).alias("best"), F.count("*").alias("n")).where("n > 1")
        drop = members.join(best.select("component", F.col(f"best.{k}").alias("kept")), "component").where(F.col(k) != F.col("kept")).select(k)
        kept = keyed.join(written(drop, "dropped", lasting=True), k, "left_anti")
        twice = members.where("copies > 1").select(k)
        if not twice.isEmpty():
            kept = kept.join(twice, k, "left_anti").unionByName(kept.join(twice, k, "left_semi").dropDuplicates([k]))
        return kept.select(*docs.columns)
