"""Vendor lookup against a table of organisation names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.strings import as_column
from folioflow.functions.vendor import HEAD_CHARS, name_words, normalised_name, text_head
from folioflow.session import scratch_path

from .columns import settle
from .joins import key_bits, possible_keys, small_side

# Candidates of one run that a task joins, where the names are too many to broadcast.
HOT_ROWS = 100_000


@dataclass(frozen=True)
class NameIndex:
    """Names by their words, made once and used by any number of batches and streams.

    ``runs`` has a row per distinct run of words: ``_run, vendor``. ``firsts`` has a row per
    word that opens a name: ``_first`` and the ``_lengths`` of the names it opens. Both are
    stored, and marked for broadcast if that is small; ``spread`` says that runs are not. Then
    ``lengths`` has those of all names, and ``first_bits`` and ``run_bits`` leave out most words
    and runs that are no name's before anything is shuffled.
    """

    runs: DataFrame
    firsts: DataFrame
    spread: bool
    head_chars: int
    lengths: tuple[int, ...] = ()
    first_bits: DataFrame | None = None
    run_bits: DataFrame | None = None


def name_index(names: DataFrame, name: str = "name", head_chars: int = HEAD_CHARS) -> NameIndex:
    """Index a table of names. Of names with equal words the first counts; this runs jobs."""
    spark = names.sparkSession
    found = (
        names.select(as_column(name).alias("vendor"), normalised_name(name).alias("_run"))
        .filter((F.col("_run") != "") & (F.char_length("_run") <= head_chars))
        .groupBy("_run")
        .agg(F.min("vendor").alias("vendor"))
    )
    words = F.split("_run", " ")
    # A head holds at most head_chars / 2 words, so the lengths of a word's names are few.
    opening = found.groupBy(F.get(words, F.lit(0)).alias("_first")).agg(
        F.sort_array(F.collect_set(F.size(words))).alias("_lengths")
    )
    path = scratch_path(spark, "names")
    found.write.parquet(f"{path}/runs")
    runs = spark.read.schema(found.schema).parquet(f"{path}/runs")
    opening.write.parquet(f"{path}/firsts")
    firsts = spark.read.schema(opening.schema).parquet(f"{path}/firsts")
    small = small_side(runs)
    if small is not runs:
        return NameIndex(small, small_side(firsts), False, head_chars)
    lengths = firsts.select(F.explode("_lengths").alias("n")).distinct().collect()
    bits = {}
    for part, table, key in (("first_bits", firsts, "_first"), ("run_bits", runs, "_run")):
        marked = key_bits(table, key)
        marked.write.parquet(f"{path}/{part}")
        bits[part] = spark.read.schema(marked.schema).parquet(f"{path}/{part}")
    return NameIndex(runs, firsts, True, head_chars, tuple(sorted(r.n for r in lengths)), **bits)


def vendor_mentions(
    documents: DataFrame,
    names: DataFrame | NameIndex,
    doc_id: str = "doc_id",
    text: str = "text",
    name: str = "name",
    head_chars: int = HEAD_CHARS,
) -> DataFrame:
    """``doc_id, vendor`` of the earliest name in each text's head, longest at equal position.

    A word of the head that opens no name goes no further. For the others, runs of the lengths
    of the names they open are matched to the names by equality, so the work grows with the
    texts and not with texts times names. With a ``NameIndex`` no job runs until the result is
    asked for; a table is indexed first. Where the names are too many to broadcast, bits tell
    words and runs that are no name's, and runs that may be one are shuffled, those met most often
    alone in parts; words and texts stay in place. Documents without a mention have no row; a null
    text has none, and rows of one id are one document.
    """
    index = names if isinstance(names, NameIndex) else name_index(names, name, head_chars)
    heads = documents.select(doc_id, text_head(text, index.head_chars).alias("_head"))
    worded = settle(heads, _words=name_words("_head"))
    words = worded.select(doc_id, "_words", F.posexplode("_words").alias("_at", "_word"))
    if index.spread:
        lengths = F.array(*map(F.lit, index.lengths)).cast("array<int>")
        opening = possible_keys(words, index.first_bits, "_word").withColumn("_lengths", lengths)
    else:
        opening = words.join(index.firsts, F.col("_word") == F.col("_first"))
    fitting = F.filter("_lengths", lambda n: F.col("_at") + n <= F.size("_words"))
    candidates = settle(
        opening.select(doc_id, "_words", "_at", F.explode(fitting).alias("_n")),
        _met=F.array_join(F.slice("_words", F.col("_at") + 1, F.col("_n")), " "),
    ).drop("_words")
    if index.spread:
        found = _spread_runs(
            possible_keys(candidates, index.run_bits, "_met"), index.runs, doc_id
        )
    else:
        found = candidates.join(index.runs, F.col("_met") == F.col("_run"))
    return found.groupBy(doc_id).agg(
        F.min_by("vendor", F.struct("_at", (-F.col("_n")).alias("_longest"))).alias("vendor")
    )


def _spread_runs(candidates: DataFrame, runs: DataFrame, doc_id: str) -> DataFrame:
    """Join where a run may be met by most documents: such runs are counted and salted alone."""
    # Both uses read one shuffle: settled, neither asks it for fewer columns than the other.
    dealt = candidates.repartition(doc_id, "_at")
    candidates = dealt.select(F.inline(F.array(F.struct(*dealt.columns))))
    # One run for each HOT_ROWS candidates at most.
    hot = F.broadcast(
        candidates.groupBy(F.col("_met").alias("_hot"))
        .agg(F.ceil(F.count(F.lit(1)) / F.lit(HOT_ROWS)).cast("int").alias("_salts"))
        .filter("_salts > 1")
    )
    salts = F.coalesce("_salts", F.lit(1))
    salted = candidates.join(hot, F.col("_met") == F.col("_hot"), "left").withColumn(
        "_salt", F.pmod(F.xxhash64(doc_id, "_at"), salts).cast("int")
    )
    parts = runs.join(hot, F.col("_run") == F.col("_hot"), "left").select(
        "_run", "vendor", F.explode(F.sequence(F.lit(0), salts - 1)).alias("_part")
    )
    same = (F.col("_met") == F.col("_run")) & (F.col("_salt") == F.col("_part"))
    return salted.drop("_hot", "_salts").join(parts, same)
