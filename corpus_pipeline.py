"""Corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and all rows that the stage before kept;
what it returns is written as Parquet and read again as the next one's input. The
first three stages return the columns of ``documents``:

1. language ID drops the documents whose language is rejected;
2. SimHash near-duplicates leave one document of each group (five-word shingles,
   an exact Jaccard similarity of 0.8 or more);
3. secret scans replace every span of a secret by a mask, so no document is lost;
4. best-fit packing gives the pieces of the documents and their places.

Defined results: null and empty texts, and those without a letter, have no language and
fall away in the first stage; very long texts go through whole; of repeated rows, as of
any near-duplicates, one stays, that of the smallest doc_id (null after all); rows that
tie in all columns count as one; a null doc_id is packed under null; an empty table
gives no rows; further columns, also of clashing names, come along to the third stage
and are not read. Each stage's rows stay in the shared folder until that is cleared.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from scanloom.llm import langid, neardup, packing, secrets
from scanloom.llm.common import shared_dir, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack_sequences),
]

#: SQL can't train a classifier or fit a packing; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/scanloom/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs
