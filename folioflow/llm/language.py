"""Language of a text as the dictionary that compresses it best."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import extended, per_batch, quoted, worker_cache

UNDETERMINED = "und"
# Per language: texts looked at, characters taken of each, and bytes of dictionary.
SAMPLE_TEXTS = 64
SAMPLE_CHARS = 1 << 12
DICTIONARY_BYTES = 1 << 15
# Languages that a text is compared with at most; more labels than that are an error.
MOST_LANGUAGES = 256
# Parts that a language's hashes are ranked in before the language is.
PARTS = 64
# Bytes compressed at a time, so that a long text does not become its own dictionary.
BLOCK = 2000
LEVEL = 12
# Gain of the best language over the next, as a share of the next, that counts as clear.
MIN_MARGIN = 0.01

_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """The words of a text in lower case, whatever lies between them as one space."""
    return _OTHER.sub(" ", text.lower()).encode(errors="replace")


def learn_dictionaries(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    language_column: str = "lang",
    sample_texts: int = SAMPLE_TEXTS,
    sample_chars: int = SAMPLE_CHARS,
    dictionary_bytes: int = DICTIONARY_BYTES,
    most_languages: int = MOST_LANGUAGES,
) -> dict[str, bytes]:
    """A raw-content dictionary per language, from a bounded sample of labelled rows.

    Of the distinct texts of each language, ``sample_texts`` with the smallest hashes are taken,
    until ``dictionary_bytes`` are full: whole, or ``sample_chars`` characters from a place
    that the hash names where a text is longer. Texts of any length thus teach a language, and
    every labelled one has a dictionary if a sampled text has a letter. Copies of a text count
    once. Only ids and hashes are ranked; the sample, that many rows per language, is broadcast
    to the texts, which are not shuffled. Rows without a language, a text or an id teach
    nothing, and an empty table gives no dictionary. More than ``most_languages`` labels are a
    ValueError, since every text is compressed once for each.
    """
    rows = docs.select(
        F.col(id_column).alias("id"),
        F.col(text_column).alias("text"),
        F.col(language_column).cast("string").alias("lang"),
    ).filter("id IS NOT NULL AND lang IS NOT NULL AND text <> ''")
    if rows.select("lang").distinct().limit(most_languages + 1).count() > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    distinct = (
        rows.groupBy("lang", F.xxhash64("text").alias("hash")).agg(F.min("id").alias("first"))
    )
    # First within each part of the hashes, then among those, so that no task ranks all of a
    # language.
    chosen = distinct.withColumn("_part", F.pmod("hash", F.lit(PARTS)))
    for by in (("lang", "_part"), ("lang",)):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("hash", "first"))
        chosen = chosen.withColumn("_rank", rank).filter(F.col("_rank") <= sample_texts)
    chosen = chosen.select(F.col("lang").alias("_lang"), "hash", "first")
    spare = F.greatest(F.length("text") - F.lit(sample_chars), F.lit(0))
    begun = F.pmod(F.col("hash"), (spare + 1).cast("bigint")).cast("int") + 1
    part = F.substr("text", begun, F.lit(sample_chars))
    found = (
        rows.join(
            F.broadcast(chosen),
            (F.col("id") == F.col("first"))
            & (F.xxhash64("text") == F.col("hash"))
            & (F.col("lang") == F.col("_lang")),
        )
        .select("lang", "hash", part.alias("text"))
        .distinct()
        .orderBy("lang", "hash", "text")
        .collect()
    )
    result: dict[str, bytes] = {}
    for lang, _, text in found:
        whole = result.get(lang, b"") + letters(text) + b" "
        if len(whole) <= dictionary_bytes:
            result[lang] = whole
    return {k: v for k, v in sorted(result.items()) if v.strip()}


def compressors(dictionaries: dict[str, bytes]) -> dict[str, Callable[[bytes], bytes]]:
    made = {}
    for lang, content in dictionaries.items():
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=LEVEL)
        made[lang] = zstandard.ZstdCompressor(
            level=LEVEL,
            dict_data=data,
            write_content_size=False,
            write_checksum=False,
            write_dict_id=False,
        ).compress
    return made


def detect_language(
    docs: DataFrame,
    dictionaries: dict[str, bytes],
    text_column: str = "text",
    min_margin: float = MIN_MARGIN,
) -> DataFrame:
    """``docs`` with ``lang_pred, score, margin, rejected``.

    Every whole text is compressed, block by block, with the dictionary of each language; the
    smallest total wins, the first name of equals. ``score`` is the winner's share of two to
    the power of minus the sizes in bytes; ``margin`` is the gain over the next language as a
    share of its size (1 when only one is known). Texts that are null or hold no letter are
    ``und`` with score 0 and margin 0, and so is all when nothing was learned. ``rejected``
    marks these and margins under ``min_margin``. Columns of ``docs`` with the added names are
    replaced. Map-only; one row per row.
    """
    names = ["lang_pred", "score", "margin", "rejected"]
    carried = [c for c in docs.columns if c not in names]
    key = zlib.crc32(repr(sorted(dictionaries.items())).encode())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tools = worker_cache(f"languages_{key}", lambda: compressors(dictionaries))
        found: list[tuple] = []
        for text in batch.column(1).to_pylist():
            if not tools or not text or not any(map(str.isalpha, text)):
                found.append((UNDETERMINED, 0.0, 0.0, True))
                continue
            plain = letters(text)
            blocks = [plain[i : i + BLOCK] for i in range(0, len(plain), BLOCK)]
            sizes = sorted(
                (sum(map(len, map(tool, blocks))), lang) for lang, tool in tools.items()
            )
            best, lang = sizes[0]
            score = 1 / sum(2.0 ** max(best - size, -1000) for size, _ in sizes)
            margin = (sizes[1][0] - best) / sizes[1][0] if len(sizes) > 1 else 1.0
            found.append((lang, score, margin, margin < min_margin))
        kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array([f[i] for f in found], k) for i, k in enumerate(kinds))],
            names=["_row", *names],
        )

    rows = docs.select(
        F.struct(*map(quoted, carried)).alias("_row"), F.col(text_column).alias("_text")
    )
    added = "lang_pred STRING, score DOUBLE, margin DOUBLE, rejected BOOLEAN"
    schema = extended(rows.select("_row").schema, added)
    return rows.mapInArrow(per_batch(run), schema).select("_row.*", *names)
