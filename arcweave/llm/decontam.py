"""Benchmark decontamination: where windows of benchmark items occur in documents.

A prefix-filtered join of windows with documents, all in DataFrame operations.
A window's shingles are its pairs of neighbouring words. They are ordered by how
often they stand in the documents, and the rarest is the window's prefix: as a
window must occur whole, a text that lacks any one of its shingles lacks the
window. A document's pair of words that is some window's prefix gives the one
place where that window can be; it must fit between the document's ends there,
and its words are then compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.llm.common import BROADCAST_BYTES, scratch, written

#: What separates words: ASCII but letters and digits.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """A-Z lower-cased words; null has none."""
    lowered = F.translate(text, _UPPER, _UPPER.lower())
    return F.coalesce(F.filter(F.split(lowered, NOT_WORD), lambda w: w != ""), F.array().cast("array<string>"))


def _pair(word: Column, after: Column) -> Column:
    """Key of a shingle; after is null for the only word of a window."""
    return F.xxhash64(word, F.coalesce(after, F.lit("")))


def windows(benchmark: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (window, words, size) and the items that have them (window, item_id)."""
    items = benchmark.where(F.col("item_id").isNotNull()).select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    each = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, width))).alias("words"))
    each = written(each.select("item_id", "words", F.sha2(F.concat_ws(" ", "words"), 256).alias("window")).distinct(), "windows", lasting=True)
    return each.groupBy("window").agg(F.first("words").alias("words")).withColumn("size", F.size("words")), each.select("window", "item_id").distinct()


def _places(docs: DataFrame, keys: DataFrame, how: str, single: bool, keep: list[str]) -> DataFrame:
    """Documents' pairs of words against keys, which are broadcast; at is the place, from 0.

    single: compare words alone, for windows of one word.
    """
    each = docs.select(*keep, "w", F.posexplode_outer("w").alias("at", "word"))
    after = F.lit(None).cast("string") if single else F.get("w", F.col("at") + 1)
    complete = F.col("word").isNotNull() if single else after.isNotNull()
    return each.withColumn("key", F.when(complete, _pair(F.col("word"), after))).join(F.broadcast(keys), "key", how)


def prefixes(docs: DataFrame, each: DataFrame) -> DataFrame:
    """Each window with its rarest shingle: window, words, size, key, offset.

    Counts the shingles of windows over all documents. Ties go to the first place.
    """
    single = F.col("size") == 1
    at = F.when(single, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("size") - 2))
    shingles = each.select("window", "words", "size", F.explode(at).alias("offset"))
    shingles = shingles.withColumn("key", _pair(F.get("words", F.col("offset")), F.get("words", F.col("offset") + 1)))
    pairs = written(shingles.where(~single), "shingles")
    keys, counts = written(pairs.select("key").distinct(), "keys"), None
    blocks = max(1, -(-keys.count() * 40 // BROADCAST_BYTES))
    for b in range(blocks):
        block = keys.where(F.pmod("key", F.lit(blocks)) == b)
        part = _places(docs, block, "inner", False, []).groupBy("key").count()
        counts = part if counts is None else counts.unionByName(part)
    rarest = F.min_by(F.struct("words", "size", "key", "offset"), F.struct(F.coalesce("count", F.lit(0)), "offset"))
    several = pairs.join(counts, "key", "left").groupBy("window").agg(rarest.alias("r")).select("window", "r.*")
    return several.unionByName(shingles.where(single).select("window", "words", "size", "key", "offset"))


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256 and contaminated for each document.

    A window is width words of an item, or all of an item with fewer; a word of a
    document inside any occurrence of any window is hit. Null and wordless texts
    have no words and no hits; items without id or words have no windows. Repeated
    rows give repeated rows; rows of one doc_id with different texts are judged each
    for itself, a null doc_id like any other. Columns besides those named aren't
    read. A very long text is held whole in its task, and its words are rows there.

    The keys that are counted, and the windows, are broadcast in blocks of rows within
    BROADCAST_BYTES, each block against all documents: a benchmark of any size is
    joined whole, by as many scans of the texts as it has blocks. Only
    the places where a window really is leave the scan, besides one row for each
    document; they meet by document, whose own words bound them.
    """
    texts = docs.select("doc_id", F.xxhash64("text").alias("copy"), words(F.col("text")).alias("w"))
    with scratch(docs.sparkSession):
        each, owners = windows(benchmark, width)
        found = written(prefixes(texts, each), "prefixes")
        n, longest, singles = found.agg(F.count("*"), F.coalesce(F.max(F.length(F.concat_ws(" ", "words"))), F.lit(0)), F.count(F.when(F.col("size") == 1, 1))).first()
        blocks = max(1, -(-n * (longest + 400) // BROADCAST_BYTES))
        start = F.col("at") - F.col("offset")
        fits = F.col("window").isNotNull() & (start >= 0) & (start + F.col("size") <= F.size("w"))
        there = F.coalesce(fits & (F.slice("w", F.greatest(start + 1, F.lit(1)), F.greatest("size", F.lit(0))) == F.col("words")), F.lit(False))
        hits = None
        for single in [False, True][: 1 + bool(singles)]:
            for b in range(blocks):
                block = found.where((F.col("size") == 1) == single).where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b)
                placed = _places(texts, block, "left", single, ["doc_id", "copy"])
                first = F.coalesce(F.col("at"), F.lit(0)) == 0
                part = placed.where(there | first).select("doc_id", "copy", F.size("w").cast("long").alias("n_words"), F.when(there, F.struct(start.alias("start"), (start + F.col("size")).alias("end"))).alias("span"), F.when(there, F.col("window")).alias("window"))
                hits = part if hits is None else hits.unionByName(part)
        hits = written(hits, "hits", lasting=True)
    by = ["doc_id", "copy"]
    # the union of the spans' lengths: each begins where those before it, in order of their ends, have not yet been
    length = F.aggregate(
        F.array_sort(F.collect_set("span")),
        F.struct(F.lit(0).alias("done"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a.done, s.end).alias("done"), (a.n + F.greatest(s.end - F.greatest(a.done, s.start), F.lit(0))).alias("n")),
        lambda a: a.n,
    )
    spans = hits.groupBy(*by).agg(F.max("n_words").alias("n_words"), length.alias("n_hit"))
    of_items = hits.where("window is not null").select(*by, "window").distinct().join(owners, "window").select(*by, F.col("item_id").cast("string").alias("item_id")).distinct()
    items = of_items.groupBy(*by).agg(F.count("*").alias("n_items"), F.concat_ws(",", F.array_sort(F.collect_list("item_id"))).alias("items"))
    repeated = texts.groupBy(*by).agg(F.count("*").alias("rows")).where("rows > 1").withColumnsRenamed({"doc_id": "_id", "copy": "_copy"})
    same = [spans[c].eqNullSafe(items[c]) for c in by]
    found = spans.join(items, same[0] & same[1], "left").join(repeated, spans["doc_id"].eqNullSafe(F.col("_id")) & (spans["copy"] == F.col("_copy")), "left")
    found = found.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("rows", F.lit(1).cast("long")))))
    return found.select(
        spans["doc_id"], "n_words", "n_hit", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), spans["copy"]
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The rows of docs in which no window of the benchmark occurs, with all their columns.

    Null and wordless texts are clean; repeated rows stay or go together; rows of one
    doc_id, or of none, are judged each by its own text.
    """
    with scratch(docs.sparkSession):
        bad = contaminated(docs, benchmark, width).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy"))
        bad = written(bad.distinct(), "contaminated", lasting=True)
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"]) == bad["_copy"]), "left_anti")
