"""The corpus pipeline: quality rules, toxicity, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns of documents. A stage
works on all that its predecessor kept. Rows of an empty or null text fail the quality rules.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelane.llm import packing, quality, secrets, simhash, toxicity
from quirelane.llm.queries import WORD_VOCABULARY
from quirelane.session import shared_folder, ship, table


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the log-likelihood ratio.

    Null and empty texts fail; repeated rows are judged alike, each by its own text; very long texts count whole; no rows
    give no rows, and columns whose names clash with the operator's stay as they are.
    """
    ship(spark)
    model = quality.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return quality.judge(docs, model, keep=docs.columns, prefix="__").where("__kept").select(*_columns(docs))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold.

    Null and empty texts have a score like any other; rows that share an id teach once, and are scored each by its own
    text; without labels every score is 0, and all stay. No rows give no rows; all columns stay.
    """
    ship(spark)
    model = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=docs.columns, name="__score").where(F.col("__score") < toxicity.THRESHOLD).select(*_columns(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest doc_id.

    Texts without words, null ones too, are one group; rows without a doc_id stay; of repeated rows one stays. Very long
    texts are compared whole; no rows give no rows; all columns stay.
    """
    ship(spark)
    return simhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark; null and empty texts hold none, and repeated rows are treated alike.

    The session setting ``spark.quirelane.secrets.ledger`` may name the place of a ledger of earlier runs: texts that it
    knows aren't scanned again, and those that are new are added to it.
    """
    return secrets.redact(docs, length="n_chars", ledger=spark.conf.get("spark.quirelane.secrets.ledger", None))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences.

    A null or empty text is a piece of its end mark alone; repeated rows are packed one by one; very long texts are cut
    into whole sequences; no rows give no pieces.
    """
    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path(WORD_VOCABULARY))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("near dedup", near_dedup),
    ("secret scan", secret_scan),
    ("packing", best_fit_packing),
]
#: Trained models, tokens and fingerprints are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, place: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        place = f"{folder}/{i}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
        if i:
            _remove(spark, last)  # the next stage has all that it kept
        last = place
    return docs
