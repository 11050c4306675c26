"""Stages that turn documents into training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvec.llm import exact_dedup, near_dedup, packing, quality_mil, secret_scan
from sparkvec.llm.common import shared_folder, table, unused


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose quality score is at least quality_mil.THRESHOLD, with all their columns, whatever their names.

    The model is learned anew from the labels of documents that are in docs. Null and empty texts are scored as one empty
    passage and mostly go; equal texts have equal scores, so repeated rows stay or go together; a score on the threshold
    stays; without labels of both kinds all documents have the score of the one there is (1 without any). No rows give none.
    """
    (score,) = unused(docs.columns, "_score")
    model = quality_mil.train(docs, table(spark, sf_dir, "labels"))
    scored = quality_mil.score_quality(docs, model, score)
    return scored.where(F.col(score) >= quality_mil.THRESHOLD).select(*(F.col(f"`{c}`") for c in docs.columns))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each text, that with the least id. Null texts count as empty; of rows that also share the id
    one stays; a null id is larger than any other; long texts are compared by the digest of the whole; all columns are
    kept, whatever their names; no rows give none."""
    return exact_dedup.deduplicate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that with the least id. Null and empty texts all stay; so do rows
    without an id; rows that share an id stay together if one of them does; long texts are compared by all their shingles;
    all columns are kept, whatever their names; no rows give none."""
    return near_dedup.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents, with secrets replaced in their texts and n_chars to match. Null and empty texts stay as they are;
    rows are independent, so ties and repeated rows need no rule; texts of any length are read whole; all columns are kept,
    whatever their names; no rows give none."""
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences. Null texts count as empty and give one piece of one id; rows that share an
    id are packed each for itself; a long text is cut into full sequences; equal lengths go by id; columns other than
    doc_id and text are ignored; no rows give no pieces."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0).drop("uid")


STAGES = [("quality_classifier", quality_classifier), ("exact_dedup", exact_duplicates), ("minhash_near_dedup", near_duplicates), ("secret_scan", secrets), ("packing", packed)]

#: A classifier, near-duplicate search and a tokenizer aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
