"""Language-model scores of whole documents: a gated recurrent model beside counts.

The model's vocabulary is the most frequent words, the end of a text, and buckets
of the other words by their last two bytes. A word of a bucket has the bucket's
probability times its own share of the bucket by counts, in which one unseen word
has a share as well; so a text's probability covers any words.

Counts are of all training documents. The recurrent model is trained on all of
them too: a first model on a bounded sample, then from it, one pass over each
task's own documents; the tasks' weights are averaged, by tokens seen.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.llm import gru
from arcweave.llm.common import held_out, written

#: Buckets of the words outside the model's vocabulary.
BUCKETS = 63
#: Words at most whose counts every worker holds; rarer ones are joined.
HELD = 1 << 16
#: Documents of the first model: those whose ids have the smallest hashes.
FIRST = 3000
#: Tokens of these documents at most, but of the first.
FIRST_TOKENS = 8_000_000
#: Rates of the first model, and of the pass over everything.
RATES = (0.01, 0.004)

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Stands for the end of a text among the words, which are never empty.
END = b""
_BLOCK = 1 << 13


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased words, then the end; bytes split at 0x20 and 0x09 to 0x0D alone."""
    return [*(text or "").encode().translate(_LOWER).split(), END]


def bucket(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % BUCKETS


@dataclass
class Vocabulary:
    """held: word -> place; of each place the count and the model's token. end: the end's token."""

    held: dict[bytes, int]
    counts: np.ndarray
    tokens: np.ndarray
    of_bucket: np.ndarray
    seen: np.ndarray
    end: int
    total: int
    kinds: int
    rest: np.ndarray  # of each bucket: its words' counts, one more for each word and one for the unseen

    def read(self, text: str | None) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """The model's tokens, the places of held words, and the other words."""
        w = words(text)
        get = self.held.get
        at = np.fromiter((get(x, -1) for x in w), np.int32, len(w))
        ids = self.tokens[at]
        other = np.flatnonzero(at < 0)
        rare = [w[i] for i in other]
        if rare:
            ids[other] = self.of_bucket[[bucket(x) for x in rare]]
        return ids, at[at >= 0], rare


def count_words(docs: DataFrame) -> DataFrame:
    """(word binary, c) over all rows of docs, summed in each task first, in bounded memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "c"])
            seen.clear()
            return b

        for b in batches:
            for text in b.column(0):
                seen.update(words(text.as_py()))
                if len(seen) > 1 << 19:
                    yield out()
        yield out()

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From all counts; the words held are those of the greatest counts, at most HELD; counts within 3 % stay together."""
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    size = F.floor(F.log(F.col("c").cast("double")) * 32)  # a few thousand different values at most
    least, many = 0, 0
    for r in sorted(counts.groupBy(size.alias("s")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.s):
        if many + r.n > HELD:
            least = r.s + 1
            break
        many += r.n
    top = sorted(((r.c, bytes(r.word)) for r in counts.where(size >= least).collect()), key=lambda x: (-x[0], x[1]))
    own = [w for _, w in top if w != END][: gru.SIZE - BUCKETS - 1] + [END]
    inside = set(own)
    by_last = F.crc32(F.substring(F.col("word"), -2, 2)) % BUCKETS
    rest = np.ones(BUCKETS)
    for r in counts.groupBy(by_last.alias("b")).agg(F.sum(F.col("c") + 1).alias("n")).collect():
        rest[r.b] += r.n
    count = {w: c for c, w in top}
    for w in inside:
        rest[bucket(w)] -= count.get(w, -1) + 1
    units = sorted([(count.get(w, 0), 0, w) for w in own] + [(int(n), 1, b) for b, n in enumerate(rest)], key=lambda u: (-u[0], u[1], str(u[2])))
    place = {(k, x): i for i, (_, k, x) in enumerate(units)}
    of_bucket = np.array([place[1, b] for b in range(BUCKETS)], np.int16)
    held = {w: i for i, (_, w) in enumerate(top)}
    if END not in held:
        held[END] = len(top)
        top.append((0, END))
    tokens = np.array([place.get((0, w), -1) for _, w in top], np.int16)
    outside = tokens < 0
    tokens[outside] = of_bucket[[bucket(w) for (_, w), o in zip(top, outside) if o]] if outside.any() else 0
    seen = np.zeros(gru.SIZE)
    seen[: len(units)] = [u[0] for u in units]
    return Vocabulary(held, np.array([c for c, _ in top], np.int64), tokens, of_bucket, seen, place[0, END], total, kinds, rest)


def read(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """Each row of docs read once: the model's tokens, what counts alone give, and the words that v doesn't hold.

    known, base: of the words held. more: their shares of their buckets, of the words held and of all bucket totals.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = np.log(v.counts + 1.0)
        outside = np.where(np.isin(v.tokens, v.of_bucket), logs, 0.0)
        shares = np.zeros(gru.SIZE)
        shares[v.of_bucket] = np.log(v.rest)
        seen = v.counts > 0
        for b in batches:
            rows, other, times, ends = [], [], [], [0]
            for text in b.column(2):
                ids, at, rare = v.read(text.as_py())
                rows.append((ids.tobytes(), len(ids), int(np.count_nonzero(seen[at])), logs[at].sum(), outside[at].sum() - shares[ids].sum()))
                found = Counter(rare)
                other += found.keys()
                times += found.values()
                ends.append(len(other))
            types = [pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            pairs = pa.StructArray.from_arrays([pa.array(other, pa.binary()), pa.array(times, pa.int64())], ["word", "n"])
            columns = [b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(zip(*rows), types)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "ids", "n_tokens", "known", "base", "more", "rare"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), 7, 2).alias("held_out"), "text")
    read = rows.mapInArrow(run, "doc_id long, held_out boolean, ids binary, n_tokens long, known long, base double, more double, rare array<struct<word:binary,n:long>>")
    return written(read.withColumn("row", F.monotonically_increasing_id()), "lm-tokens")


def _groups(batches: Iterator[pa.RecordBatch], most: int = 4_000_000) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
    """Batches and the tokens in their last column, in groups of about so many tokens at most."""
    held, ids, n = [], [], 0
    for b in batches:
        for a in range(0, b.num_rows, 256):
            held.append(b.slice(a, 256))
            ids += [np.frombuffer(x.as_buffer(), np.int16) for x in held[-1].column(b.num_columns - 1)]
            n += sum(map(len, ids[-held[-1].num_rows :]))
            if n >= most:
                yield held, ids
                held, ids, n = [], [], 0
    if held:
        yield held, ids


def train(known: DataFrame, v: Vocabulary) -> np.ndarray:
    """Weights: a first model on the driver, a pass over all rows of known, and the average of its tasks.

    known: doc_id, n_tokens and ids, as read() gives them.
    """
    flat = gru.initial(v.seen)
    hashed = known.withColumn("h", F.xxhash64("doc_id"))
    chosen, most = [], 0
    for r in hashed.groupBy("h", "doc_id").agg(F.sum("n_tokens").alias("n")).orderBy("h", "doc_id").limit(FIRST).collect():
        if most + r.n <= FIRST_TOKENS or not chosen:
            chosen.append(r.h)
            most += r.n
    found = sorted(bytes(r.ids) for r in hashed.where(F.col("h").isin(chosen)).select("ids").collect())
    if not found:
        return flat
    found = [np.frombuffer(found[i], np.int16) for i in np.random.default_rng(2).permutation(len(found))]
    for rate in RATES:
        gru.train(flat, found, v.end, rate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = flat.copy(), 0
        for _, ids in _groups(batches):
            n += gru.train(own, ids, v.end, RATES[1])
        if n:
            parts = [own[a : a + _BLOCK].astype(np.float64) * n for a in range(0, len(own), _BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([n] * len(parts), pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["block", "n", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            for block, n, part in zip(*(c.to_pylist() for c in b.columns)):
                s = sums.setdefault(block, [0, 0.0])
                s[0], s[1] = s[0] + n, s[1] + np.frombuffer(part, np.float64)
        for block, (n, s) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([n], pa.int64()), pa.array([s.tobytes()], pa.binary())], ["block", "n", "part"])

    schema = "block int, n long, part binary"
    parts = known.select("ids").mapInArrow(run, schema)
    for deal in (["block", F.rand(3)], ["block"]):  # so that no task adds up a block of every task
        parts = parts.repartition(*deal).mapInArrow(add, schema)
    for r in parts.collect():  # the size of one model
        flat[r.block * _BLOCK : (r.block + 1) * _BLOCK] = np.frombuffer(r.part, np.float64) / r.n
    return flat


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs.

    Learns from the documents that aren't held out (crc32 of the id as text, mod 7,
    is not 2). A null text counts as empty: its only token is the end. A null
    doc_id counts as empty text in the hash. Repeated rows are learned from and
    scored as often as they stand. With nothing to learn from, every word is
    unseen. Columns besides doc_id and text aren't read.

    Counts of frequent words are held by every worker, HELD at most; the others of
    each document are joined with all counts, so no worker holds what grows with
    the corpus. Texts are split into words twice, for the counts and then for the
    model's tokens, which are written, trained on and scored. A very long text is
    one lane of its task: its words are scored one after another, in memory of a
    few bytes a word.
    """
    counts = written(count_words(docs.where(~held_out(F.col("doc_id"), 7, 2))), "word-counts")
    v = vocabulary(counts)
    tokens = read(docs, v)
    flat = train(tokens.where(~F.col("held_out")).select("doc_id", "n_tokens", "ids"), v)
    least = math.log(v.total + v.kinds + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, ids in _groups(batches):
            scores, at = gru.score(flat, ids, v.end), 0
            for b in held:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores[at : at + b.num_rows], pa.float64())], ["row", "model"])
                at += b.num_rows

    model = tokens.select("row", "ids").mapInArrow(run, "row long, model double")
    rare = tokens.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n")
    more = rare.join(counts, "word").groupBy("row").agg(F.sum("n").alias("known_rare"), F.sum(F.col("n") * F.log(F.col("c") + 1.0)).alias("logs"))
    ten, logs = F.lit(math.log(10)), F.coalesce("logs", F.lit(0.0))
    return tokens.drop("ids", "rare").join(model, "row").join(more, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("known_rare", F.lit(0))).alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        ((F.col("base") - least * F.col("n_tokens") + logs) / ten).alias("base_score"),
        ((F.col("model") + F.col("more") + logs) / ten).alias("score"),
    )
