"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies; the operators take the place as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    return scan(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is a fixed one here; whoever publishes the texts keeps a secret one."""
    from .pii import replace

    return replace(table(spark, sf_dir, "documents"), key=b"codelattice")


def op4_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wavelet import read_documents, wavelet_shards

    return read_documents(wavelet_shards(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op5_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .covertree import near_pairs

    return near_pairs(table(spark, sf_dir, "embeddings"))


def op6_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import near_copies

    return near_copies(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op8_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collision import search

    return search(table(spark, sf_dir, "embeddings"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, judge

    docs = table(spark, sf_dir, "documents")
    judged = judge(docs, fit(docs, table(spark, sf_dir, "labels")), columns=("doc_id", "source", "lang"))
    return judged.select("doc_id", "source", "lang", F.col("q_evidence").alias("evidence"), F.col("q_host_quality").alias("host_quality"), F.col("q_path_quality").alias("path_quality"), F.col("q_posterior").alias("posterior"), (F.col("q_posterior") >= 0.5).alias("kept"))


def op10_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_secret_scan, op2_packing, op3_pii_surrogates, op4_wavelet, op5_cover_tree, op6_shingle_join, op7_toxicity, op8_collision_search, op9_quality, op10_poisson_mix)}


def oracle_sql() -> dict[str, str]:
    from . import covertree, jaccard, mixing

    return {"op5_cover_tree": covertree.ORACLE, "op6_shingle_join": jaccard.ORACLE, "op10_poisson_mix": mixing.ORACLE}
