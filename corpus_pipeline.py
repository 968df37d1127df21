"""The corpus pipeline: toxicity, exact dedup, near-dedup, suffix dedup, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), works on
all rows that the stage before kept and returns a DataFrame. All but the last
return the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from turnloom.llm import exact_dedup, near_dedup, packing, suffix_dedup, toxicity
from turnloom.llm.common import cut, fresh, read_table, small_batches
from turnloom.llm.queries import END_ID, held_out

#: A document with this toxicity or more goes.
TOXIC = 0.5
#: Words of a passage that repeats, and the bytes that so many words have at least: a letter each and what parts them.
PASSAGE_WORDS = 51
PASSAGE_BYTES = 2 * PASSAGE_WORDS - 1


def bounded(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """What the stage writes goes through Python in small batches, whoever calls it: workers keep the memory that they once took."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with small_batches(spark):
            return stage(spark, docs, sf_dir)

    return run_stage


@bounded
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the subsequence-kernel machine doesn't reject; it learns from the training folds of ``labels``."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels").where(~held_out()))
    (score,) = fresh(docs, "toxicity")
    # Written here, as the caller's batches may hold all texts of a task.
    return cut(toxicity.score(docs, model, into=score).where(F.col(score) < TOXIC).drop(score), "not-toxic")


@bounded
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The best row of each group of equal texts."""
    return exact_dedup.keep_best(docs)


@bounded
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8."""
    return near_dedup.keep_first(docs)


@bounded
def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages of over 50 words, or of 400 bytes, that occur more than once."""
    return suffix_dedup.strip(docs, PASSAGE_BYTES, words=PASSAGE_WORDS).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


@bounded
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    out = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", drop_repeats),
    ("packing", pack),
]

#: No SQL states the trained and byte-level stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with small_batches(spark):
            docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
