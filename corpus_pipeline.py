"""A corpus pipeline: quality rules, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. Quality keeps the documents that its rules and
perplexity bands accept; near-duplicates keeps the smallest doc_id of each group (five-word shingles, similarity 0.8);
personal-data replaces spans by their kind in brackets; mixing repeats or leaves out documents so that sources meet
their target shares; packing cuts them into sequences of 2048 token ids.

In every stage a row is its doc_id with its text, so rows that share an id, or have none, are judged each for itself.
Null and empty texts fail the quality rules; where a stage still meets them they hold no shingles, spans or words and
are packed as an end id. Of repeated rows one stays after near-duplicates; ties go to the smallest doc_id. Columns of
any name pass through unchanged (n_chars follows the redacted text). Empty tables give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracewell.llm.common import documents, materialize, release
from tracewell.llm.jaccard import keep_first
from tracewell.llm.mixing import take_copies
from tracewell.llm.packing import pack_documents
from tracewell.llm.pii import redact
from tracewell.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs, width=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return take_copies(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the executors still hold memory of the stages before
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, memo_bytes=60_000_000, slice_bytes=2_000_000)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("personal data", personal_data),
    ("mixing sources", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        done = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)


#: perplexity, components and packing are beyond SQL; the stages are tested against brute force
ORACLE_SQL = None
