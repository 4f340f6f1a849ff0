"""Corpus pipeline: quality, near-duplicates, benchmark leaks, source mix, shards.

Each stage gets what the one before it kept, as a table; all but the last return the columns of ``documents``.  A document
that the mix takes twice is two equal rows from there on.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill.llm import decontam, jaccard, mixing, quality, sharding
from ledgermill.llm.common import id_remainder, stash, table


#: Tasks that an output shard of the mix is cut into: at least so many, and more where one would get more than LANE_BYTES of text.
LANES, LANE_BYTES = 64, 32 << 20


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line chain rejects go; fold 2 of 4 stays unseen in training, as in op8."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), id_remainder("doc_id", 4) != 2)
    return quality.keep_good(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays."""
    return jaccard.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, verbatim or re-parameterised."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source, in whole documents: a document comes as often as it is drawn.

    The table's rows lie by output shard and shuffled inside it; its columns are those of ``documents``.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    lanes = max(LANES, math.ceil(mixing.TOTAL_SHARE * size / mixing.OUT_SHARDS / LANE_BYTES))
    return mixing.in_order(mixing.mix(docs), lanes).select(*docs.columns)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard, of 8 near equal in bytes."""
    return sharding.place(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("sharding", sharding_stage),
]

#: Hashed features, MinHash and the splitting tree can't be written in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
