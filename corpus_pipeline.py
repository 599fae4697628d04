"""From raw documents to packed training sequences, one operator per stage."""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import folioflow  # noqa: E402
from folioflow.llm.common import quoted, written  # noqa: E402
from folioflow.llm.language import detect_language, learn_dictionaries  # noqa: E402
from folioflow.llm.queries import packed_documents  # noqa: E402
from folioflow.llm.rules import pulled_ratios, quality_rules, trusted_documents  # noqa: E402
from folioflow.llm.simhash import near_duplicates  # noqa: E402

# Send the package's functions with the tasks, so that workers need no copy of this folder.
cloudpickle.register_pickle_by_value(folioflow)

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def set_apart(docs: DataFrame) -> DataFrame:
    """Each row as one value ``doc``, so that no added column can clash."""
    return docs.select(F.struct(*map(quoted, docs.columns)).alias("doc"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; an empty table stays empty."""
    trusted = trusted_documents(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = quality_rules(set_apart(docs), pulled_ratios(docs, trusted), text_column="doc.text")
    return judged.filter("kept").select("doc.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear, whatever their ``lang`` says.

    Rows without an id teach nothing but are judged; repeated rows are judged alike. Nothing
    is clear where nothing was learned. An empty table stays empty.
    """
    dictionaries = learn_dictionaries(docs)
    judged = detect_language(set_apart(docs), dictionaries, text_column="doc.text")
    return judged.filter("NOT rejected").select("doc.*")


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest id.

    Texts are near duplicates where the fingerprints of their three-word shingles differ in
    three bits at most, or others link them that way. Rows are told apart by their id and a
    hash of all their columns, so that of rows with one id in a group, and of exact repeats,
    one stays. A row without an id stays only where no row of its group has one. Only these
    keys and the texts reach the comparison. An empty table stays empty.
    """
    number, other = F.col("doc.doc_id"), F.col("_kept._number")
    rows = set_apart(docs).withColumn("_hash", F.xxhash64("doc"))
    key = F.struct(number.isNull().alias("_nameless"), number.alias("_number"), "_hash")
    first = (
        near_duplicates(rows.select(key.alias("_key"), "doc.text"), id_column="_key")
        .filter("id = component_id")
        .select(F.col("id").alias("_kept"))
    )
    # Equality with nulls in a form that adds no join key, so that the rows are shuffled once.
    same = F.coalesce(number == other, number.isNull() & other.isNull())
    kept = rows.join(first, (F.col("_hash") == F.col("_kept._hash")) & same, "left_semi")
    return kept.select("_hash", "doc").distinct().select("doc.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece.

    A null text is an empty one; repeated rows and null ids have pieces of their own. An empty
    table gives no rows.
    """
    return packed_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("language_id", language),
    ("near_duplicates", near_duplicate),
    ("packing", packing),
]

# Tokenizers, zstandard and XXH64 have no SQL form; tests hold the run against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result stored before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
