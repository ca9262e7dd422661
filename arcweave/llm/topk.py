"""Exact top-k by integer inner product, with MaxScore over blocks of vectors.

A component of the query is a term, and what it adds to a vector's score above
the least it can add in the block is that vector's posting: between 0 and the
term's bound. The posting list of a term holds the vectors with a posting above 0.
Terms in falling order of bound are split where the bounds of the rest can no longer
lift a vector over the k-th best score found: the terms before are essential, and
only vectors in one of their lists are candidates; their postings are added up. The
rest are probed, a few terms at a time, for the candidates that can still compete.
A block whose bounds all together can't compete is skipped. Each block gives its
best k of a query; these are merged at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a block at most, and queries in a block at most.
BLOCK, QUERY_BLOCK = 4096, 1024
#: Terms probed at a time.
PROBE = 8


def quantized(vectors: DataFrame) -> DataFrame:
    """vec_id and v, the components as floor(256 * x); without null ids and unusable vectors.

    Null vectors and those that hold null, NaN or an infinity take no part. What
    doesn't fit 64 bits after the scaling is held at the largest such number.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * 256).cast("long")).alias("v"))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows packed where they are into blocks of at most size vectors each: ids, vectors, width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        vectors: list[list[int]] = []

        def block() -> pa.RecordBatch:
            m = _packed(vectors)
            out = pa.RecordBatch.from_pydict({"ids": [np.array(ids, np.int64).tobytes()], "vectors": [m.tobytes()], "width": pa.array([m.shape[1]], pa.int32())})
            ids.clear(), vectors.clear()
            return out

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i), vectors.append(v)
                if len(ids) == size:
                    yield block()
        if ids:
            yield block()

    return rows.mapInArrow(run, "ids binary, vectors binary, width int")


def _packed(vectors: list[list[int]]) -> np.ndarray:
    m = np.zeros((len(vectors), max(map(len, vectors))), np.int64)  # a shorter vector is 0 in what it lacks
    for i, v in enumerate(vectors):
        m[i, : len(v)] = v
    return m


def _matrix(vectors: bytes, ids: np.ndarray, width: int) -> np.ndarray:
    m = np.frombuffer(vectors, np.int64).reshape(len(ids), -1)
    return np.pad(m, ((0, 0), (0, width - m.shape[1])))


class Block:
    """Vectors of a block with the bounds of their components, and posting lists where these are short."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors, self.low, self.high = ids, vectors, vectors.min(0), vectors.max(0)
        self.lists: dict[tuple[int, bool], np.ndarray | None] = {}

    def postings(self, term: int, positive: bool) -> np.ndarray | None:
        """Places of the vectors that a term of that sign lifts above its least; None where most are."""
        if (term, positive) not in self.lists:
            v = self.vectors[:, term]
            found = np.flatnonzero(v > self.low[term] if positive else v < self.high[term])
            self.lists[term, positive] = found if 4 * len(found) < len(v) else None
        return self.lists[term, positive]


def max_score(query: np.ndarray, own: int, block: Block, k: int, least: int | None) -> tuple[list[tuple[int, int]], int]:
    """The block's best k as (score, id), ties to smaller ids, and how many components of vectors were read.

    least: the k-th best score known so far.
    """
    ids, vectors, low, high = block.ids, block.vectors, block.low, block.high
    bound = np.abs(query) * (high - low)
    order = np.argsort(-bound, kind="stable")
    base = int(np.minimum(query * low, query * high).sum())
    rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0)  # rest[i]: bounds of the terms from the i-th on
    if least is not None and base + int(rest[0]) < least:
        return [], 0
    # the essential terms: while those after them could lift a vector over the threshold alone
    need = (least if least is not None else base) - base
    split = min(int(np.searchsorted(-rest, -need, side="right")) if need > 0 else len(query) // 2, len(query))
    terms = order[:split]
    lists = [block.postings(int(t), bool(query[t] > 0)) for t in terms if query[t] != 0] if need > 0 else [None]
    if all(x is not None for x in lists):
        alive = np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.int64)
        alive = alive[ids[alive] != own]
        scores = vectors[np.ix_(alive, terms)] @ query[terms]
        read = sum(map(len, lists)) + len(alive) * split
    else:
        alive = np.flatnonzero(ids != own)
        scores = (vectors[:, terms] @ query[terms])[alive]
        read = len(ids) * split
    below = int(np.minimum(query[order] * low[order], query[order] * high[order])[split:].sum())
    while True:
        # each vector ends between scores + below and scores + below + rest[split]
        if len(scores) > k:
            sure = int(np.partition(scores, len(scores) - k)[len(scores) - k]) + below
            sure = sure if least is None else max(sure, least)
            able = scores + (below + int(rest[split])) >= sure
            alive, scores = alive[able], scores[able]
        elif least is not None:
            able = scores + (below + int(rest[split])) >= least
            alive, scores = alive[able], scores[able]
        if split == len(query) or not len(alive):
            break
        terms = order[split : split + PROBE]
        scores = scores + vectors[np.ix_(alive, terms)] @ query[terms]
        read += len(alive) * len(terms)
        below -= int(np.minimum(query[terms] * low[terms], query[terms] * high[terms]).sum())
        split += len(terms)
    best = np.lexsort((ids[alive], -scores))[:k]
    return [(int(scores[i]), int(ids[alive[i]])) for i in best], read


def _exact(query: list[int], own: int, ids: list[int], vectors: list[list[int]], k: int) -> list[tuple[int, int]]:
    """For components so large that 64 bits may not hold a score."""
    found = sorted((-sum(a * b for a, b in zip(query, v)), i) for i, v in zip(ids, vectors) if i != own)
    return [(-s, i) for s, i in found[:k]]


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id and score of the k best vectors of each query; ties to the smaller vec_id.

    Queries: rows whose vec_id is divisible by every; candidates: all rows but the
    query's own. With fewer than k candidates there are as many rows; a query
    without any has none. vec_ids are taken as distinct: a repeated row is another
    candidate of the same id, ranked as often as it stands, and the answers to a
    query id with several vectors compete. Scores past 64 bits are held at the
    largest such number.

    The stated queries are dealt into blocks, and each block of vectors goes to
    each of them; a task holds one of either at a time. Where there are few blocks of
    queries each stands several times, so that blocks of vectors are spread over all
    tasks. The k rows of each query and block are cut to k in each task before they
    are merged by query.
    """
    rows = quantized(vectors)
    queries = rows.where(F.col("vec_id") % every == 0).distinct()
    many = max(1, -(-queries.count() // QUERY_BLOCK))
    packed = queries.groupBy(F.pmod(F.xxhash64("vec_id", "v"), F.lit(many)).alias("n")).agg(F.collect_list(F.struct("vec_id", "v")).alias("queries"))
    salts = max(1, -(-2 * vectors.sparkSession.sparkContext.defaultParallelism // many))
    packed = packed.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    met = _blocks(rows, BLOCK).withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)))
    met = met.withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long"))))
    pairs = met.join(packed.hint("shuffle_hash"), ["n", "salt"]).select("n", "ids", "vectors", "width", "queries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, dict[int, list[int]]] = {}  # of the blocks of queries met last: the k best scores of each query
        for r in (r for b in batches for r in b.to_pylist()):
            ids, own = np.frombuffer(r["ids"], np.int64), [q["vec_id"] for q in r["queries"]]
            q = _packed([x["v"] for x in r["queries"]])
            width = max(r["width"], q.shape[1])
            m, q = _matrix(r["vectors"], ids, width), np.pad(q, ((0, 0), (0, width - q.shape[1])))
            size = float(np.abs(m.astype(float)).max(initial=1)) * float(np.abs(q.astype(float)).max(initial=1)) * 2 * max(width, 1)
            if size < 2**52:
                m, q = m.astype(np.float64), q.astype(np.float64)  # exact, and faster
            block = Block(ids, m)
            if r["n"] not in known and len(known) >= 4:
                known.clear()
            tops, out = known.setdefault(r["n"], {}), []
            for j, (i, query) in enumerate(zip(own, q)):
                if size >= 2**62:
                    best = _exact([int(x) for x in query], i, ids.tolist(), m.tolist(), k)
                else:
                    top = tops.setdefault(j, [])
                    best, _ = max_score(query, i, block, k, top[k - 1] if len(top) >= k else None)
                    top[:] = sorted(top + [x for x, _ in best], reverse=True)[:k]
                out += [(i, v, max(-(1 << 63), min(x, (1 << 63) - 1))) for x, v in best]
            columns = list(zip(*out)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
