"""Small pieces that several operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.llm.text import WORD
from labelscope.sources import materialize, read_table

#: The letters that are folded, and no others.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


#: Bits of a filter: of one row, and of all.
BITMAP = 32_768
FILTER_BITS = 1 << 27

#: Rows of texts that go to a Python worker at a time while a table is stored.
BATCH_ROWS = 500
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of a Parquet file that are read at a time.
_READ = "spark.sql.parquet.columnarReaderBatchSize"


def stored(df: DataFrame, name: str, rows: int = BATCH_ROWS) -> DataFrame:
    """:func:`materialize`, with few rows at a time sent to Python functions.

    Rows with texts are large, and a batch is held by the executor and by the
    worker. With fewer than ``BATCH_ROWS`` rows no more are read from Parquet at
    once either. The session's settings are put back when the table is written;
    smaller ones are left as they are.
    """
    conf = df.sparkSession.conf
    limited = [_BATCH] if rows >= BATCH_ROWS else [_BATCH, _READ]
    before = {s: conf.get(s) for s in limited}
    before = {s: was for s, was in before.items() if not 0 < int(was) <= rows}
    for setting in before:
        conf.set(setting, rows)
    try:
        return materialize(df, name)
    finally:
        for setting, was in before.items():
            conf.set(setting, was)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, f"{folder}/documents.parquet")


def folded(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else changed; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def unused(taken: Sequence[str], name: str) -> str:
    """A column name that none of the taken ones equals, in any case."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def maybe_among(rows: DataFrame, key: str, keys: DataFrame, name: str) -> DataFrame:
    """``rows`` with a boolean ``name``: false where ``key`` is surely not in ``keys``.

    ``key`` and the one column of ``keys`` are 64-bit hashes. A bit for each
    hash of the keys, modulo a power of two, is kept in rows of 4 KB and looked
    up by a broadcast. There are 16 bits a key, up to ``FILTER_BITS``, so the
    filter has a bounded size; with more keys it lets more rows through.
    """
    n = keys.count()
    bits = BITMAP
    while bits < FILTER_BITS and bits < 16 * n:
        bits *= 2
    taken = [*rows.columns, name]
    at, word = unused(taken, "filter_at"), unused(taken, "filter_bits")
    place = F.pmod(F.col(keys.columns[0]), F.lit(bits))
    bitmaps = keys.groupBy(F.floor(place / BITMAP).alias(at)).agg(
        F.bitmap_construct_agg(place % BITMAP).alias(word)
    )
    own = F.pmod(F.col(key), F.lit(bits))
    found = rows.withColumn(at, F.floor(own / BITMAP)).join(F.broadcast(bitmaps), at, "left")
    byte = F.substring(F.col(word), F.floor(own % BITMAP / 8).cast("int") + 1, F.lit(1))
    value = F.conv(F.hex(byte), 16, 10).cast("int")
    is_set = F.floor(value / F.pow(F.lit(2), own % 8)) % 2 == 1
    columns = [F.col(f"`{c}`") for c in rows.columns]
    return found.select(*columns, F.coalesce(is_set, F.lit(False)).alias(name))


def one_row_each(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """One whole row for each value of ``key``, whichever; nulls are equal.

    Each task leaves one row per value before anything is shuffled.
    """
    # a column of that name must not stand in for the struct
    whole = unused(rows.columns, "whole")
    kept = F.first(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias(whole)
    keys = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(key)]
    found = rows.groupBy(*keys).agg(kept)
    return found.select(*[F.col(f"`{whole}`.`{c}`").alias(c) for c in rows.columns])
