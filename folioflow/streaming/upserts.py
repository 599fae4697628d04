"""A table kept by a stream in which the rows of a key are replaced as a whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 16
_PLACE = [T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())]


def read_or_none(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """The Parquet files under a path, or None where there is no such path yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _versions(spark: SparkSession, root: str, schema: T.StructType, before: int | None):
    stored = T.StructType([f for f in schema.fields if f.name not in ("batch", "bucket")] + _PLACE)
    rows = read_or_none(spark, f"{root}/versions", stored)
    if rows is None or before is None:
        return rows
    return rows.filter(F.col("batch") < before)


def current_rows(
    spark: SparkSession, root: str, schema: T.StructType, before: int | None = None
) -> DataFrame:
    """The rows of the latest version of every bucket, with the columns of ``schema``.

    ``before`` gives the table as it was before a batch. No batch yet gives no rows. The
    latest versions are a row per bucket and found from the folders' names alone.
    """
    names = [f.name for f in schema.fields]
    rows = _versions(spark, root, schema, before)
    if rows is None:
        return spark.createDataFrame([], schema)
    latest = rows.groupBy("bucket").agg(F.max("batch").alias("batch"))
    return rows.join(F.broadcast(latest), ["bucket", "batch"], "left_semi").select(*names)


def superseded(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """``batch, bucket`` of versions that are not the latest and may be removed."""
    rows = _versions(spark, root, schema, None)
    if rows is None:
        return spark.createDataFrame([], T.StructType(_PLACE))
    latest = rows.groupBy("bucket").agg(F.max("batch").alias("_latest"))
    found = rows.select("batch", "bucket").distinct().join(F.broadcast(latest), "bucket")
    return found.filter(F.col("batch") < F.col("_latest")).select("batch", "bucket")


def upsert(
    batch: DataFrame,
    batch_id: int,
    root: str,
    key: Sequence[str],
    buckets: int = BUCKETS,
) -> None:
    """Replace all rows of the keys in ``batch``; the other rows stay.

    Rows lie in folders by batch and by a hash of the key. A batch writes a new version of
    the buckets it touches, made of their version before it and its own rows, so running it
    again after a failure gives the same table, and readers of earlier versions are not
    disturbed. ``batch`` is stored first and evaluated once. Versions add up until those of
    ``superseded`` are removed. ``batch`` must not have columns ``batch`` and ``bucket``.
    """
    if not {"batch", "bucket"}.isdisjoint(batch.columns):
        raise ValueError("columns batch and bucket are taken")
    spark = batch.sparkSession
    arrived_at = f"{root}/arrived/batch_id={batch_id}"
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    batch.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(
        arrived_at
    )
    with_bucket = T.StructType([*batch.schema.fields, _PLACE[1]])
    arrived = spark.read.schema(with_bucket).parquet(arrived_at)
    # At most a row per bucket.
    touched = F.broadcast(arrived.select("bucket").distinct())
    keys = arrived.select(*[F.col(k).alias(f"_{k}") for k in key]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    earlier = current_rows(spark, root, with_bucket, before=batch_id)
    kept = earlier.join(touched, "bucket", "left_semi").join(keys, same, "left_anti")
    merged = kept.unionByName(arrived).withColumn("batch", F.lit(batch_id).cast("bigint"))
    (
        merged.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch", "bucket")
        .parquet(f"{root}/versions")
    )
