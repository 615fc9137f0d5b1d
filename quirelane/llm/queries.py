"""Registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelane.llm import bpe, divergence, filter_audit, knn, langid, licenses, packing, quality, secrets, simhash, toxicity, urlfilter, warc
from quirelane.llm import sql
from quirelane.llm.common import remove
from quirelane.session import cut, shared_folder, ship, spread, table

WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    folder = shared_folder(spark, "warc")
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), folder, min_bytes=0)
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).cast("long")
    records = cut(warc.read_archives(manifest, payloads=False).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to_id").alias("refers_to"), "verified"
    ))
    remove(spark, folder)  # all has been read back
    return records


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    found = simhash.near_duplicates(_documents(spark, sf_dir), width=4, r=4)
    return found.select("doc_id", simhash.hex_of("fp").alias("fingerprint"), F.col("component").alias("component_id"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack_documents(_documents(spark, sf_dir), public_tokenizers.path(WORD_VOCABULARY), size=2048, end=0)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = _documents(spark, sf_dir)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe.encode_documents(_documents(spark, sf_dir), public_tokenizers.path(BYTE_VOCABULARY))


def op6_secrets(spark: SparkSession, sf_dir: str, ledger: str | None = None) -> DataFrame:
    """``ledger``: the place of a ledger that earlier runs have written, which is read and appended to; else one for this run alone."""
    place = ledger or shared_folder(spark, "ledger")
    found = secrets.digest(secrets.find_stored(_documents(spark, sf_dir), place))
    if ledger is None:
        found = cut(found)
        remove(spark, place)
    return found


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return knn.top_k(table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = _documents(spark, sf_dir)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, model, keep=["doc_id"])


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return licenses.scan_documents(_documents(spark, sf_dir))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return divergence.audit(spread(table(spark, sf_dir, "documents").select("lang", "source", "text")))


def op12_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    found = langid.identify(docs, langid.train(docs), keep=["doc_id"])
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op13_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return filter_audit.audit(docs, table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_warc, op2_simhash, op3_packing, op4_toxicity, op5_bpe, op6_secrets, op7_topk, op8_quality, op9_urls, op10_licenses, op11_divergence, op12_langid, op13_filters, pipeline)
}
ORACLE_SQL: dict[str, str] = dict(sql.ORACLE_SQL)
