"""The query of each training-data operator over its whole table; SQL where it can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import collocations, warc
from .common import scratch, table


def _crc32(ids: str):
    return F.crc32(F.col(ids)).alias("ids_crc32")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_tokens, write_tokens

    index = write_tokens(table(spark, sf_dir, "documents"), scratch(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"), 2)
    return read_tokens(index).select("doc_id", "start", "n_tokens", _crc32("ids"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens, vocabulary

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary(public_tokenizers.path("piece_bpe_32k.model")))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"), "doc_id", "text", 200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "spans")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import overlaps

    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .progressive_jpeg import digests

    return digests(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import capture_log, header_text, resolve_revisits

    return resolve_revisits(capture_log(table(spark, sf_dir, "pages"))).withColumn("headers", header_text(F.col("headers")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    out = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", _crc32("ids"), "doc_tokens", "sequence_id", "offset")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import held_out, predict, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out("doc_id").alias("held_out"))
    model = train(docs.where(~F.col("held_out")))
    return predict(docs.select("doc_id", "text", "held_out"), model).drop("text")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic_runs import longest, planted, runs, runs_text

    out = runs(planted(table(spark, sf_dir, "documents")), min_length=6, min_exponent=4).withColumn("best", longest("runs"))
    exponent = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    digests = F.sha2(runs_text("runs").cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", exponent, *digests)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .byte_bpe import decode_documents, encode_documents

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = decode_documents(encode_documents(table(spark, sf_dir, "documents"), ranks, pattern), ranks, pattern)
    n = F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens")
    return out.select("doc_id", n, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_files, op2_token_counts, op3_suffix_dedup, op4_decontamination, op5_progressive_jpeg, op6_html_text, op7_simhash, op8_warc_revisits, op9_packing, op10_language_id,
        op11_collocations, op12_periodic_runs, op13_byte_bpe,
    )
}

ORACLES: dict[str, str] = {"op8_warc_revisits": warc.ORACLE, "op11_collocations": collocations.ORACLE}
