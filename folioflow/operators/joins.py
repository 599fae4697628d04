"""Join helpers for data of unknown size and skew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SMALL_SIDE_ROWS = 100_000
SMALL_SIDE_BYTES = 64 * 1024 * 1024
# A table of bits for keys: blocks of 64 numbers of 64 bits, 16 MB in all for any number of keys.
BIT_BLOCKS = 1 << 15
BLOCK_NUMBERS = 64


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: texts and what is nested by their length, others 16."""
    total = F.lit(16)
    for field in df.schema.fields:
        column = F.col("`" + field.name.replace("`", "``") + "`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            size = F.octet_length(column)
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = 4 * F.octet_length(column.cast("string"))
        else:
            size = F.lit(0)
        total = total + F.lit(16) + F.coalesce(size, F.lit(0))
    return total


def small_side(
    df: DataFrame, max_rows: int = SMALL_SIDE_ROWS, max_bytes: int = SMALL_SIDE_BYTES
) -> DataFrame:
    """``df`` marked for broadcast if it has few enough rows and bytes, else unchanged.

    The check reads at most ``max_rows + 1`` rows and runs a job.
    """
    some = df.limit(max_rows + 1).agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("bytes")
    )
    rows, size = some.first()
    return F.broadcast(df) if rows <= max_rows and size <= max_bytes else df


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the smallest by ``order``; combined map-side before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    )
    return picked.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    hashed: bool = False,
) -> DataFrame:
    """Join where ``right`` holds one row per key and a left key may hold most rows.

    The extra key is a function of the others, so the result is that of a plain join. It
    keeps the planner from reusing the partitioning of a grouped ``right``: both inputs then
    come straight from their own shuffle, which is what lets adaptive execution split a
    skewed left partition over many tasks.

    ``hashed`` is for a ``right`` with far fewer rows than ``left``: a task holds its rows of
    ``right`` in memory and lets those of ``left`` pass, instead of sorting both. Narrow rows
    of few keys compress so well that a task may get a hundred millions of them to sort.
    """
    spread = F.xxhash64(*keys)
    found = right.withColumn("_spread", spread)
    joined = left.withColumn("_spread", spread).join(
        found.hint("shuffle_hash") if hashed else found, [*keys, "_spread"], how
    )
    return joined.drop("_spread")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def _bit_place(keys: Sequence[Column | str]) -> tuple[Column, Column, Column]:
    """Block, number in the block and bit of the number for a key."""
    code = F.xxhash64(*keys)
    block = F.pmod(F.shiftright(code, 12), F.lit(BIT_BLOCKS)).cast("int")
    number = F.pmod(code, F.lit(BLOCK_NUMBERS)).cast("int")
    return block, number, F.pmod(F.shiftright(code, 6), F.lit(64)).cast("int")


def key_bits(df: DataFrame, *keys: str) -> DataFrame:
    """``_block, _bits``: a bit set for each key of ``df``, for ``possible_keys``."""
    block, number, bit = _bit_place(keys)
    one = F.lit(1).cast("bigint")
    numbers = (
        df.select(block.alias("_block"), number.alias("_number"), bit.alias("_bit"))
        .groupBy("_block", "_number")
        .agg(F.bit_or(F.call_function("shiftleft", one, F.col("_bit"))).alias("_set"))
    )
    placed = F.map_from_entries(F.collect_list(F.struct("_number", "_set")))
    return numbers.groupBy("_block").agg(placed.alias("_placed")).select(
        "_block",
        F.transform(
            F.sequence(F.lit(0), F.lit(BLOCK_NUMBERS - 1)),
            lambda n: F.coalesce(F.try_element_at("_placed", n), F.lit(0).cast("bigint")),
        ).alias("_bits"),
    )


def possible_keys(df: DataFrame, bits: DataFrame, *keys: str) -> DataFrame:
    """The rows of ``df`` whose key may be among those of ``bits``, without a shuffle of ``df``.

    All that are among them stay, and few others: one in 25 with five million keys. What needs
    the keys exactly joins the rows that are left, which are far fewer where most keys are others.
    """
    block, number, bit = _bit_place(keys)
    # Nothing but the rows of df goes on, the bits stay in the join.
    is_set = F.getbit(F.get("_bits", number), bit) == 1
    return df.join(F.broadcast(bits), (F.col("_block") == block) & is_set, "left_semi")
