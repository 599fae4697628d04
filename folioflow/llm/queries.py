"""One query per operator over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.session import scratch_path

from .audit import document_labels, failure_bits, interaction_audit
from .chat import conversation_digests, format_conversations, stored_segments, text_part
from .common import bucket_of, written
from .discriminant import document_statistics, fit, score
from .language import detect_language, learn_dictionaries
from .licences import scan_licences
from .packing import pack, token_pieces
from .piece_codec import encode_texts
from .rules import pulled_ratios, quality_rules, trusted_documents
from .simhash import fingerprint_text, near_duplicates
from .token_counts import count_tokens
from .variants import spelling_variants, vocabulary
from .vectors import near_vectors
from .warc import read_archives, revisit_roles, write_archives

PIECES = "piece_bpe_32k.model"
WORDS = "word_bpe_49k.json"
RECORD_PREFIX = "urn:page:"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_licences(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_licences(table(spark, folder, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        "digest",
        "license_id",
        F.array_join("notices", ",").alias("notices"),
        "n_notices",
    )


def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select(
        "page_id",
        "url",
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
    )
    records = revisit_roles(pages, "page_id")
    named = records.select(
        F.concat(F.lit(RECORD_PREFIX), F.coalesce(F.col("page_id").cast("string"), F.lit(""))).alias(
            "record_id"
        ),
        F.col("url").alias("target_uri"),
        "payload",
        F.concat(F.lit(RECORD_PREFIX), F.col("refers_to").cast("string")).alias("refers_to"),
    )
    path = scratch_path(spark, "warc")
    write_archives(named, path)

    def page(column: str):
        return F.expr(f"try_cast(substring({column}, {len(RECORD_PREFIX) + 1}) AS BIGINT)")

    return read_archives(spark, path).select(
        page("record_id").alias("page_id"),
        "payload_bytes",
        F.when(F.col("record_type") == "revisit", F.col("declared_digest"))
        .otherwise(F.sha1("payload"))
        .alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    rows = written(document_statistics(docs), "quality-statistics").withColumn(
        "held_out", F.coalesce(bucket_of(F.col("id"), 3) == 1, F.lit(False))
    )
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("id"), "quality")
    model = fit(rows.filter("NOT held_out").join(labels, "id"))
    return score(rows, model).select(
        F.col("id").alias("doc_id"),
        "held_out",
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op4_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings")).withColumnRenamed("id", "vec_id")


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents")).select(
        F.col("id").alias("doc_id"), fingerprint_text().alias("fingerprint"), "component_id"
    )


def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(bucket_of(F.col("doc_id"), 5) == 0, F.lit(False))
    dictionaries = learn_dictionaries(docs.filter(~held_out))
    return detect_language(docs.select("doc_id", "text"), dictionaries).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin", "rejected"
    )


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed_documents(table(spark, folder, "documents"))


def packed_documents(docs: DataFrame) -> DataFrame:
    pieces = token_pieces(docs, public_tokenizers.path(WORDS)).select(
        F.col("id").alias("doc_id"),
        "piece",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
    )
    return pack(written(pieces, "packing-pieces"))


def op8_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    trusted = trusted_documents(table(spark, folder, "labels"))
    return quality_rules(docs, pulled_ratios(docs, trusted)).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def op9_tokens(spark: SparkSession, folder: str) -> DataFrame:
    counted = count_tokens(table(spark, folder, "documents"), public_tokenizers.path(PIECES))
    return counted.withColumnRenamed("id", "doc_id")


def op10_pieces(spark: SparkSession, folder: str) -> DataFrame:
    model = public_tokenizers.path(PIECES)
    return encode_texts(table(spark, folder, "documents"), model, decoded=True).select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op11_chat(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    # A conversation that says what a template may say.
    said = spark.range(1).select(F.explode(F.array(F.lit("user"), F.lit("assistant"))).alias("role"))
    own = said.select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.when(F.col("role") == "user", 0).otherwise(1).cast("bigint").alias("turn"),
        "role",
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    turns = rows.unionByName(own).withColumn("parts", text_part(F.col("text")))
    digests = conversation_digests(stored_segments(format_conversations(turns)))
    return digests.select(
        F.col("id").alias("conv_id"),
        "n_turns",
        "turns_sha256",
        "loss_chars",
        "loss_sha256",
        "formatted_chars",
    )


def op12_audit(spark: SparkSession, folder: str) -> DataFrame:
    failures = failure_bits(table(spark, folder, "documents"))
    return interaction_audit(failures, document_labels(table(spark, folder, "labels")))


def op13_variants(spark: SparkSession, folder: str) -> DataFrame:
    words = written(vocabulary(table(spark, folder, "documents")), "variants-words")
    return spelling_variants(words)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_licences,
        op2_warc,
        op3_quality,
        op4_vectors,
        op5_simhash,
        op6_language,
        op7_packing,
        op8_rules,
        op9_tokens,
        op10_pieces,
        op11_chat,
        op12_audit,
        op13_variants,
    )
}
