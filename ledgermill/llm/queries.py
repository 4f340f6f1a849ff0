"""The queries of the subpackage, each over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgermill.llm import decontam, fingerprints, html_extract, jaccard, langid, mixing, pii, quality, sharding, topk, trie, warc, whitening
from ledgermill.llm.common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.held_out_run(table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_next(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.held_out_run(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents")).drop("mix_orders")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.build(table(spark, sf_dir, "conversations")).drop("preorder", "subtree_end")


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.every_fiftieth(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_langid, op3_fingerprints, op4_pii, op5_warc, op6_html_text, op7_jaccard_join, op8_quality, op9_decontamination, op10_mixing, op11_whitening, op12_prefix_trie, op13_topk)}
ORACLES: dict[str, str] = {"op1_sharding": sharding.ORACLE, "op4_pii": pii.ORACLE, "op5_warc": warc.ORACLE, "op6_html_text": html_extract.ORACLE, "op7_jaccard_join": jaccard.ORACLE, "op9_decontamination": decontam.ORACLE, "op10_mixing": mixing.ORACLE, "op12_prefix_trie": trie.ORACLE, "op13_topk": topk.ORACLE}
