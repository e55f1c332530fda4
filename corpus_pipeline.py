"""The corpus pipeline: from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's rows and reads them again as the next one's docs.
All but the last return the columns of documents. A document is a pair of doc_id and text: rows of one doc_id, or of none, with different
texts are different documents, and repeated rows are one from the near-duplicate stage on.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from roadweave.llm.common import stored, table
from roadweave.llm.decontamination import overlaps
from roadweave.llm.language_id import UND, predict, train
from roadweave.llm.packing import pack_documents
from roadweave.llm.simhash import similar_documents
from roadweave.llm.suffix_dedup import remove_repeats

REPEAT_BYTES = 200
END_ID = 0


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key that is never null, one for each different pair of doc_id and text, in order of doc_id (null last)."""
    first = F.coalesce(F.lpad(F.col("doc_id").cast("string"), 20, "0"), F.lit("~"))
    return docs.withColumn("_key", F.concat(first, F.md5(F.concat(F.lit("."), F.coalesce("text", F.lit(""))))))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a word in some language; a missing lang is filled in."""
    named = docs.select("doc_id", "text", "lang", "source", "n_chars")
    found = predict(named, train(named)).where(F.col("lang_pred") != UND)
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*named.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts alike in 0.8 or more of their five-word shingles: the one of the least key."""
    keyed = _keyed(docs)
    kept = similar_documents(keyed, "_key").where("_key = component_id").select("_key").distinct()
    return keyed.join(kept, "_key", "left_semi").dropDuplicates(["_key"]).drop("_key")


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur elsewhere too; those with nothing else go."""
    out = remove_repeats(docs, "doc_id", "text", REPEAT_BYTES, ("lang", "source", "n_chars"), as_text=True)
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("kept").cast("long")).otherwise(F.col("carried.n_chars"))
    out = out.select("doc_id", F.col("kept").alias("text"), "carried.lang", "carried.source", n_chars.alias("n_chars"))
    return out.where(F.regexp_like("text", F.lit(r"\S")))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    keyed = _keyed(docs)
    bad = overlaps(keyed, table(spark, sf_dir, "benchmark"), "_key").select("_key").distinct()
    return keyed.join(bad, "_key", "left_anti").drop("_key")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID)


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", repeat_dedup),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
