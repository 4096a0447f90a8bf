"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, BPE.

Every stage works on all that its predecessor kept, whose rows were written as Parquet and read again.

Null and empty texts are no duplicates and hold nothing toxic or of a benchmark, so they stay, and encode to no ids; so do rows without an id. Repeated rows of an id
are judged alike, and one of them stays after near-duplicates. Ties between near-duplicates go to the smallest id. Texts of any length are taken whole. Columns of
documents come out as they came in, whatever their names, of every stage but the last. Empty tables, labels and benchmarks give empty results or drop nothing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huespan.llm import bpe, decontaminate, near_dedup, toxicity
from huespan.llm.common import materialize, table, unused
from huespan.session import ship

#: The last stage has no SQL, and neither have learned lexicons and tilings: tests compare the stages with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score lies below the threshold, by a lexicon learned from labelled rows outside the held-out fold."""
    lexicon = toxicity.learn(docs, table(ship(spark), sf_dir, "labels"))
    score = unused(docs, "toxicity")
    return toxicity.score_toxicity(docs, lexicon, score=score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of every group of near-duplicates."""
    ship(spark)
    return near_dedup.keep_one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, table(ship(spark), sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text decoded from them."""
    ship(spark)
    return bpe.round_trip_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("decontamination", drop_contaminated), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
