"""From raw documents to token ids: quality, near duplicates, benchmark passages, secrets, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows of its predecessor and returns the columns of documents; the
last one returns the encoded documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.decontaminate import contaminations
from plumbline.llm.dropping import one_of_each, without
from plumbline.llm.jaccard_join import jaccard_components
from plumbline.llm.neighbour_quality import score_quality
from plumbline.llm.queries import PIECE_BPE, QUALITY_CUT, held_out, piece_digests
from plumbline.llm.secret_scan import find_secrets, mask
from plumbline.llm.sentencepieces import encode_pieces
from plumbline.llm.shared import documents, saved, shared_folder, small_batches

#: Near duplicates share four fifths of their five-word shingles.
SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out("doc_id"))
    others = tuple(c for c in docs.columns if c != "doc_id")
    scored = score_quality(docs, labels, keep=others, score="classifier_score")
    return scored.where(F.col("classifier_score") >= QUALITY_CUT).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id; documents without an id all stay."""
    small_batches(spark)
    folder = shared_folder(spark)
    found = jaccard_components(docs, folder, size=SHINGLE_WORDS, percent=SIMILARITY_PERCENT)
    found = saved(found, folder, "found")
    firsts = without(docs, found.where("component_id <> doc_id").select("doc_id"))
    repeated = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    return (firsts if repeated.isEmpty() else one_of_each(firsts, repeated)).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    small_batches(spark)
    found = contaminations(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, saved(found.select("doc_id").distinct(), shared_folder(spark), "contaminated")).select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by [SECRET] and n_chars counted again."""
    others = tuple(c for c in docs.columns if c != "doc_id")
    found = find_secrets(docs, keep=others, spans="secret_spans")
    masked = found.withColumn("text", mask(F.col("text"), F.col("secret_spans")))
    changed = F.when(F.size("secret_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", changed).select(docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of ids, decoded text and piece spans."""
    small_batches(spark)
    out = encode_pieces(docs, public_tokenizers.path(PIECE_BPE), keep=("lang", "source"))
    return out.select("doc_id", "lang", "source", *piece_digests(), "ids")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("SentencePiece encoding and decoding", encoding),
]

#: No stage but the secret masks can be said in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again before the next."""
    folder = shared_folder(spark)
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = saved(stage(spark, docs, sf_dir), folder, f"stage-{k}")
    return docs
