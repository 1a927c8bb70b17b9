"""The training-data pipeline: stages over `documents`, each by one operator of mailrisk.llm.

Every stage takes (spark, docs, sf_dir) and returns a frame. All but the last return the
columns of `docs`; the last returns pieces of token ids placed in sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from mailrisk.llm import near_copies, packing, secrets, substring, toxicity
from mailrisk.llm.common import bound_batches, table
from mailrisk.session import passing_tables

#: Smaller than for single queries: workers keep what earlier stages left in them.
BATCH_BYTES = 6 << 20
WORDS_KEPT = 100_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar rejects go; the model is fitted on labelled rows of the folder."""
    model = toxicity.fit_tables(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    bound_batches(spark, BATCH_BYTES)
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies stays.

    Pairs come from SimHashes that differ in three bits at most, then from minima; they count at Jaccard 0.8 or more of five-word shingles.
    """
    bound_batches(spark, BATCH_BYTES)
    with passing_tables(spark) as lasting:
        return near_copies.deduplicate(docs, lasting)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document with a smaller id has too are cut out."""
    bound_batches(spark, BATCH_BYTES)
    return substring.deduplicate(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Credentials are replaced by a mask; the learnt formats come from the documents that got here."""
    bound_batches(spark, BATCH_BYTES)
    return secrets.redact(docs, secrets.fit_tables(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, placed in sequences."""
    bound_batches(spark, BATCH_BYTES)
    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), words_kept=WORDS_KEPT))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("substring", cut_repeated_passages),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: The classifier, hash groups and formats are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        if name == STAGES[-1][0]:
            return stage(spark, docs, sf_dir)
        with passing_tables(spark) as lasting:
            docs = lasting(stage(spark, docs, sf_dir))
    return docs
