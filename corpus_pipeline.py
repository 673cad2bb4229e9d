"""From raw documents to packed training sequences: STAGES in order, each on what the one before it kept.

Each stage takes (spark, docs, sf_dir), with docs reread from the Parquet that the stage before wrote,
and all but the last return the columns of documents. SQL can't express the fitted models or the
packing, so ORACLE_SQL is None and the tests hold each stage against a plain version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from codelattice.llm import jaccard, mixing, packing, quality, secrets
from codelattice.llm.common import arrow_rows, checkpoint_dir, cut, drop_folder, table
from codelattice.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None
#: Rows that the last stage sends to Python at once: texts are long, a batch is held several times over, and executors may be small.
ARROW_ROWS = 500


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    A null or empty text has the evidence of an empty one; null sources and langs are sites of their own; rows that repeat a
    doc_id are judged each; texts of any length are read whole; an empty table stays empty; columns other than COLUMNS go.
    """
    return quality.keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays.

    Null, empty and blank texts and rows with a null doc_id stay; rows that repeat the smallest doc_id stay all, as nothing tells them apart; texts
    of any length are compared whole; an empty table stays empty; columns other than COLUMNS go.
    """
    return jaccard.keep_one(docs.select(*COLUMNS))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows.

    All rows stay, repeated ones and those with nulls too; a null text stays null, an empty one empty, a long one is scanned
    whole; an empty table stays empty; columns other than COLUMNS go.
    """
    return secrets.redact(docs.select(*COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source is replicated or thinned to its weight, and all are shuffled.

    A null source is one of its own; rows that repeat a doc_id get the same number of copies each, a null doc_id that of an empty
    one; texts, null, empty or long, play no part; an empty table stays empty; columns other than COLUMNS go.
    """
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens, in the order of the mix.

    A null or empty text is its end id alone; copies and rows with a null doc_id are packed each; a long text takes as many
    sequences as it needs; an empty table gives no piece; other columns go.
    """
    with arrow_rows(spark, ARROW_ROWS):
        return cut(packing.pack(docs, vocabulary("byte_bpe_50k.json")))


STAGES = [("quality classifier", good_documents), ("n-gram Jaccard join", one_of_each), ("secret scans", without_secrets), ("mixing sources", mixed), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what each keeps is written to the shared checkpoint folder and read again, and deleted when the next one is written."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{k}")
            docs = spark.read.parquet(f"{base}/{k}")
            if k:
                drop_folder(spark, f"{base}/{k - 1}")
    drop_folder(spark, base)  # the last stage has written its own rows
    return docs
