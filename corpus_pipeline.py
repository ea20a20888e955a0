"""A corpus pipeline of the operators in reefline.llm.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, all but
the last one with the columns of ``documents``. Rows that repeat an id, or have none, are told apart by their
texts; other columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reefline.llm import exact_dedup, jaccard_join, language_id, mixing, packing
from reefline.llm.common import ascii_lower, table, without, written


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: no letters, or no language that holds half of them. A null
    lang gets the predicted one; labels that are there stay.

    Python gets ids and texts in small batches and gives back the verdicts alone, which are written; rows are told
    apart by them as in the next stages. Only rows without a label are joined with theirs."""
    model = language_id.train(docs)
    keys = docs.select(F.struct("doc_id", F.xxhash64("text").alias("text_hash"), F.col("lang").isNull().alias("unlabelled")).alias("_key"), "text")
    found = language_id.identify(keys, model, "_key", with_spans=False).withColumn("_fits", F.expr("lang_pred <> 'und' and score >= 0.5"))
    rejected = written(found.where("not _fits").select("_key.doc_id", "_key.text_hash"), "no-language")
    predicted = written(found.where("_fits and _key.unlabelled").select("_key.doc_id", "_key.text_hash", "lang_pred").distinct(), "languages")
    labelled = without(docs.where("lang is not null"), rejected, doc_id=F.col("doc_id"), text_hash=F.xxhash64("text"))
    if predicted.isEmpty():
        return labelled
    rest = docs.where("lang is null").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"))
    rest = rest.join(predicted, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("text_hash")))
    return labelled.union(rest.select(*[F.col("lang_pred").alias(c) if c == "lang" else F.col(f"_doc.`{c}`") for c in docs.columns]))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays; of rows that repeat an id and a text, one."""
    digest = exact_dedup.sha256(ascii_lower(F.coalesce("text", F.lit(""))))
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "doc_id", digest.alias("_digest"))
        docs = written(rows.dropDuplicates(["doc_id", "_digest"]).select("_doc.*"), "distinct-rows")
    found = exact_dedup.exact_dedup(docs)
    return without(docs, written(found.where("not kept").select("doc_id", "digest"), "copies"), doc_id=F.col("doc_id"), digest=digest)


def near_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five words, Jaccard 0.8) the document with the smallest id stays."""
    found = jaccard_join.jaccard_join(docs, width=5, threshold="0.8", with_text_hash=True)
    near = written(found.where("component_id <> doc_id").select("doc_id", "text_hash"), "near-copies")
    return without(docs, near, doc_id=F.col("doc_id"), text_hash=F.xxhash64("text"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that tokens approach the target weights of sources, languages and topics."""
    return mixing.sample(docs, tokens=mixing.vocabulary_tokens())


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, capacity=2048)


STAGES = [
    ("language_id", identified),
    ("exact_dedup", deduplicated),
    ("jaccard_join", near_deduplicated),
    ("mixing", mixed),
    ("packing", packed),
]

#: Tokenization, language models and raking have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
