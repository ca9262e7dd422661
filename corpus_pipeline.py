"""From raw documents to encoded training text, in stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
run() writes what each returns to the shared folder and reads it for the next. Rows
carry whole texts, so each stage has them go to Python a few hundred at a time: it
lowers the session's setting of Arrow batches, as its result is computed later.

In every stage null and empty texts are texts without words: the classifier judges
them, no other stage removes or changes them, and they encode to nothing. Repeated
rows are kept apart by no stage but one_of_copies, which keeps one. Rows without a
doc_id are documents too. Columns that documents doesn't have are passed on, whatever
their names, up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from arcweave.llm import bpe, decontam, jaccard, quality, secrets
from arcweave.llm.common import table, written

#: Texts that go to a Python worker at once.
BATCH = 512


def _few_at_once(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= BATCH:
        spark.conf.set(name, str(BATCH))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects, by their own text alone."""
    _few_at_once(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by runs of five words, at a similarity of 0.8 or more."""
    _few_at_once(spark)
    return jaccard.keep_one(docs)


def no_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents in which a window of a benchmark item occurs."""
    _few_at_once(spark)
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mask; n_chars follows."""
    _few_at_once(spark)
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their digests."""
    _few_at_once(spark)
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [("good_quality", good_quality), ("one_of_copies", one_of_copies), ("no_benchmarks", no_benchmarks), ("secret_scan", secret_scan), ("encode", encode)]

#: The classifier, the formats of secrets and the encoding are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
