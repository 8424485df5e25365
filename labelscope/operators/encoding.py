"""Ordinal codes: fitted on one table, stored by version, applied to any table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelscope.functions.columns import quoted, text_sql
from labelscope.operators.information import MISSING
from labelscope.operators.longform import text_long
from labelscope.sources.scratch import exists, materialize

# Fixed value: the code of a value that was not there when codes were fitted.
UNSEEN = -1.0
# Codes of a feature up to this many rows and bytes are broadcast, while all
# broadcast ones together stay below a multiple of the bytes.
BROADCAST_CODES = 200_000
BROADCAST_BYTES = 16_000_000
BROADCAST_FEATURES = 8
# Values on at least this share of the rows are looked up without a shuffle.
FREQUENT = 1e-3


@dataclass(frozen=True)
class CodeTable:
    """Codes of some features: ``codes`` has ``fid, value, code, count``.

    ``sizes`` tells the number of values of each feature and their bytes.
    """

    features: tuple[str, ...]
    codes: DataFrame
    sizes: tuple[tuple[int, int], ...]
    version: int | None = None


def category_codes(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``(fid, value, code, count)``: codes in lexicographic order, from 0.

    Null counts as the value ``Missing``. The distinct values are laid out in
    ranges and written once; each range is numbered on its own and shifted by
    the sizes of the ranges before it, so no task sees a whole feature.
    """
    value = F.coalesce("value", F.lit(MISSING)).alias("value")
    distinct = text_long(df, features).groupBy("fid", value).agg(F.count("*").alias("count"))
    laid_out = materialize(
        distinct.repartitionByRange("fid", "value").withColumn("part", F.spark_partition_id()),
        "categories",
    )
    sizes = laid_out.groupBy("fid", "part").agg(F.count("*").alias("size"))
    before = Window.partitionBy("fid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range and feature
    shifts = F.broadcast(
        sizes.select("fid", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("shift"))
    )
    inside = Window.partitionBy("fid", "part").orderBy("value")
    return (
        laid_out.withColumn("at", F.row_number().over(inside) - 1)
        .join(shifts, ["fid", "part"])
        .select("fid", "value", (F.col("shift") + F.col("at")).alias("code"), "count")
    )


def fit_codes(df: DataFrame, features: Sequence[str]) -> CodeTable:
    """The codes of the features' values in ``df``, kept in the shared folder."""
    return _sized(tuple(features), materialize(category_codes(df, features), "codes"))


def _sized(features: tuple[str, ...], codes: DataFrame, version: int | None = None) -> CodeTable:
    # one row per feature
    found = codes.groupBy("fid").agg(
        F.count("*").alias("n"), F.sum(F.octet_length("value")).alias("n_bytes")
    )
    sizes = {r.fid: (r.n, r.n_bytes) for r in found.collect()}
    return CodeTable(features, codes, tuple(sizes.get(i, (0, 0)) for i in range(len(features))), version)


def save_codes(table: CodeTable, path: str) -> int:
    """Store the codes below ``path`` as its next version, and return that.

    The note that names the features and the folder of the codes is written
    last, so a version is there as a whole or not at all. Older ones stay.
    """
    spark = table.codes.sparkSession
    version = max(code_versions(spark, path), default=0) + 1
    folder = f"codes/{uuid4().hex}"
    table.codes.write.parquet(f"{path}/{folder}")
    note = [(version, folder, list(table.features))]
    rows = spark.createDataFrame(note, "version int, folder string, features array<string>")
    rows.coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return version


def _notes(spark: SparkSession, path: str) -> list:
    reader = spark.read.schema("version int, folder string, features array<string>")
    return reader.parquet(f"{path}/versions").collect() if exists(spark, f"{path}/versions") else []


def code_versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions below ``path``, ascending."""
    return sorted(r.version for r in _notes(spark, path))


def load_codes(spark: SparkSession, path: str, version: int | None = None) -> CodeTable:
    """A stored version of the codes, the last one by default."""
    notes = {r.version: r for r in _notes(spark, path)}
    if not notes or (version is not None and version not in notes):
        raise ValueError(f"no codes of version {version or 'any'} in {path}")
    note = notes[max(notes) if version is None else version]
    codes = spark.read.schema("fid int, value string, code bigint, count bigint")
    return _sized(tuple(note.features), codes.parquet(f"{path}/{note.folder}"), note.version)


def encode(
    df: DataFrame,
    table: CodeTable,
    broadcast_codes: int = BROADCAST_CODES,
    broadcast_bytes: int = BROADCAST_BYTES,
    frequent: float = FREQUENT,
) -> DataFrame:
    """``df`` with the fitted features replaced by their codes, as double.

    A value without a code becomes -1; null is the value ``Missing``. Columns
    keep their order, and columns that were not fitted stay as they are. An
    empty table stays empty.

    Features with few and short values, which was counted, are looked up by
    broadcasts in the scan. All the others share one join: a frequent-items
    sketch names values that many rows of *this* table have, seen in the fit or
    not, and those are looked up without a shuffle; only the remaining cells
    become rows ``(row, fid, value)``, which one shuffle join meets with the
    codes, and go back to their row. Rows without such a cell take no part in
    any shuffle.
    """
    small, large, total = [], [], 0
    for fid in sorted(range(len(table.features)), key=lambda i: table.sizes[i][1]):
        n, n_bytes = table.sizes[fid]
        fits = n <= broadcast_codes and n_bytes <= broadcast_bytes
        if fits and total + n_bytes <= BROADCAST_FEATURES * broadcast_bytes:
            small.append(fid)
            total += n_bytes
        else:
            large.append(fid)
    columns = [F.col(quoted(c)) for c in df.columns]
    encoded = df
    for fid in sorted(small):
        name = table.features[fid]
        own = table.codes.where(F.col("fid") == fid).select(
            F.col("value").alias("_value"), F.col("code").cast("double").alias("_code")
        )
        keyed = encoded.withColumn("_key", _key(name))
        matched = keyed.join(F.broadcast(own), F.col("_key") == F.col("_value"), "left")
        code = F.coalesce("_code", F.lit(UNSEEN))
        encoded = matched.withColumn(name, code).select(*columns)
    return _looked_up(encoded, table, sorted(large), broadcast_bytes, frequent) if large else encoded


def _key(name: str) -> Column:
    return F.coalesce(F.expr(text_sql(name)), F.lit(MISSING))


def _looked_up(
    df: DataFrame, table: CodeTable, large: Sequence[int], broadcast_bytes: int, frequent: float
) -> DataFrame:
    """Codes of the large features, through one join of single cells."""
    names = [table.features[fid] for fid in large]
    rows = materialize(
        df.select(
            F.monotonically_increasing_id().alias("row"),
            F.struct(*[F.col(quoted(c)) for c in df.columns if c not in names]).alias("rest")
            if set(df.columns) - set(names)
            else F.lit(0).alias("rest"),
            F.array(*[_key(c) for c in names]).alias("keys"),
        ),
        "rows-to-encode",
    )
    place = F.element_at(F.create_map(*[F.lit(x) for p in enumerate(large) for x in p[::-1]]), F.col("fid"))
    codes = table.codes.where(F.col("fid").isin(*large)).select(
        place.alias("place"), "value", F.col("code").cast("double").alias("code")
    )
    often = F.broadcast(_frequent_codes(rows, codes, len(large), broadcast_bytes, frequent))

    wide = rows
    for i in range(len(large)):
        own = often.where(F.col("place") == i).select(
            F.col("value").alias("_value"), F.col("code").alias(f"_code{i}")
        )
        wide = wide.join(F.broadcast(own), F.col("keys")[i] == F.col("_value"), "left").drop("_value")
    known = F.array(*[F.col(f"_code{i}") for i in range(len(large))])
    wide = wide.select("row", "rest", "keys", known.alias("known"))
    is_open = F.exists("known", lambda c: c.isNull())

    cells = wide.where(is_open).select("row", F.posexplode(F.arrays_zip("keys", "known")))
    cells = cells.where("col.known is null").select("row", "pos", F.col("col.keys").alias("key"))
    met = cells.join(codes, (F.col("pos") == F.col("place")) & (F.col("key") == F.col("value")), "left")
    met = met.select("row", F.struct("pos", F.coalesce("code", F.lit(UNSEEN)).alias("code")).alias("cell"))
    carried = wide.where(is_open).select("row", F.struct("rest", "known").alias("own"))
    none = carried.withColumn("cell", F.lit(None).cast(met.schema["cell"].dataType))
    parts = none.unionByName(met, allowMissingColumns=True)
    back = parts.groupBy("row").agg(
        F.first("own", ignorenulls=True).alias("own"),
        # at most one per large feature
        F.map_from_entries(F.collect_list("cell")).alias("cells"),
    )
    found = F.transform("own.known", lambda c, i: F.coalesce(c, F.try_element_at("cells", i)))
    whole = wide.where(~is_open).select("rest", "known")
    every = whole.unionAll(back.select("own.rest", found.alias("known")))
    at = {c: i for i, c in enumerate(names)}
    return every.select(
        *[
            (F.col("known")[at[c]] if c in at else F.col(f"rest.{quoted(c)}")).alias(c)
            for c in df.columns
        ]
    )


def _frequent_codes(
    rows: DataFrame, codes: DataFrame, n: int, broadcast_bytes: int, frequent: float
) -> DataFrame:
    """``place, value, code`` of values that many of these rows have, -1 without a code, stored.

    The sketch is bounded in size and may leave a value out or add one, which
    only moves the value to the other way of being looked up.
    """
    most = max(1, int(1 / frequent))
    sketch = F.expr(f"approx_top_k(key, {most}, {max(1024, 8 * most)})").alias("top")
    least = frequent * max(1, rows.count())
    top = (
        rows.select(F.posexplode("keys").alias("place", "key"))
        .groupBy("place")
        .agg(sketch)
        .select("place", F.inline("top"))
        .toDF("place", "value", "times")
        .where((F.col("times") >= least) & (F.octet_length("value") <= broadcast_bytes * frequent))
        .select("place", "value")
    )
    top = materialize(top, "frequent-values")
    seen = codes.join(F.broadcast(top), ["place", "value"]).select("place", "value", "code")
    every = seen.unionAll(top.select("place", "value", F.lit(UNSEEN)))
    return materialize(every.groupBy("place", "value").agg(F.max("code").alias("code")), "frequent-codes")


def ordinal_encode(
    df: DataFrame,
    features: Sequence[str],
    broadcast_codes: int = BROADCAST_CODES,
    broadcast_bytes: int = BROADCAST_BYTES,
    frequent: float = FREQUENT,
) -> DataFrame:
    """The table with the listed features replaced by codes fitted on itself."""
    if not features:
        return df
    return encode(df, fit_codes(df, features), broadcast_codes, broadcast_bytes, frequent)
