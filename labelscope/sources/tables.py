"""Scans of catalog tables, files and stored samples."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelscope.functions.columns import quoted
from labelscope.operators.sampling import hash_sample
from labelscope.sources.scratch import exists, remove, touch


def read_table(spark: SparkSession, name_or_path: str) -> DataFrame:
    """A catalog table, or a Parquet path if the argument looks like one."""
    is_path = "/" in name_or_path or name_or_path.endswith(".parquet")
    return spark.read.parquet(name_or_path) if is_path else spark.table(name_or_path)


#: What stands for null in the files of :func:`write_csv`, so that "" stays "".
NULL_MARK = "\u0001"

_FORMAT = {
    "header": True,
    # quotes inside quotes are doubled (RFC 4180), and quoted line breaks stay
    "quote": '"',
    "escape": '"',
    "lineSep": "\n",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
}


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """CSV files that :func:`read_csv` gives back row by row and bit by bit.

    A null is a mark, ``\\u0001``, that text can't be mistaken for unless it is
    that one character; text of any kind, line breaks and quotes included,
    stays as it is, and timestamps keep their microseconds. A note beside the
    files, written last, tells whether any text has a line break, which is
    counted while the rows are written; without one files are read in splits.
    """
    texts = [f.name for f in df.schema.fields if _may_break(f.dataType)]
    broken = [F.col(quoted(c)).cast("string").rlike("[\\r\\n]") for c in texts]
    seen = Observation()
    any_broken = F.coalesce(F.bool_or(reduce(Column.__or__, map(_known, broken), F.lit(False))), F.lit(False))
    watched = df.observe(seen, any_broken.alias("breaks"))
    watched.write.mode(mode).options(**_FORMAT, nullValue=NULL_MARK).csv(path)
    note = f"{path}/{_NO_BREAKS}"
    if seen.get["breaks"]:
        remove(df.sparkSession, [note])
    elif mode != "append":
        touch(df.sparkSession, note)
    return path


#: The note of a folder of CSV files in which every row is one line. Spark doesn't
#: read files whose names begin like this.
_NO_BREAKS = "_one_line_a_row"


def _known(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _may_break(kind: T.DataType) -> bool:
    return not isinstance(
        kind, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    )


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    null_mark: str = "",
    line_breaks: bool | None = None,
) -> DataFrame:
    """CSV with a header; pass a schema to spare the inference pass.

    Fields may hold quoted line breaks, and then one file is read by one task.
    Files are split among tasks if ``line_breaks`` is false, or if it isn't given
    and the note of :func:`write_csv` says that there are none. An empty field is null, unless ``null_mark`` says what else is, as for files
    of :func:`write_csv`.
    """
    if line_breaks is None:
        line_breaks = not exists(spark, f"{path}/{_NO_BREAKS}")
    options = {**_FORMAT, "multiLine": line_breaks, "nullValue": null_mark}
    if schema is None:
        # other files have timestamps of other forms
        del options["timestampFormat"]
    reader = spark.read.options(**options)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def ensure_sample(
    df: DataFrame,
    path: str,
    keys: Sequence[str],
    fraction: float = 0.01,
    seed: int = 42,
    portable: bool = False,
) -> DataFrame:
    """The sample stored at ``path``, drawn and written first if absent.

    Samples are Parquet files in a folder that names the fraction, the seed and
    the keys, so another request is not answered with an older sample. A note
    beside them, written last, says that they are complete; without it, what a
    failed write left behind is replaced.
    """
    spark = df.sparkSession
    request = f"{','.join(keys)}|{portable}"
    name = hashlib.sha256(request.encode()).hexdigest()[:12]
    own = f"{path.rstrip('/')}/fraction={fraction!r}-seed={seed}-keys={name}"
    if not _finished(spark, f"{own}/done"):
        sample = hash_sample(df, keys, fraction, seed, portable)
        sample.write.mode("overwrite").parquet(f"{own}/rows")
        spark.range(1).write.mode("overwrite").parquet(f"{own}/done")
    return spark.read.parquet(f"{own}/rows")


def _finished(spark: SparkSession, note: str) -> bool:
    return exists(spark, note) and not spark.read.schema("id bigint").parquet(note).isEmpty()
