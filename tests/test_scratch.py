"""Stored tables that are removed, and those that stay."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from labelscope.sources import materialize, temporary_tables


def _folder(df):
    return Path(df.inputFiles()[0].removeprefix("file://")).parent


def test_only_temporary_tables_are_removed(spark):
    with temporary_tables(spark):
        step = materialize(spark.range(10), "step")
        result = materialize(step.select((F.col("id") * 2).alias("x")), "result", temporary=False)
        folders = _folder(step), _folder(result)
        assert all(f.exists() for f in folders)
    assert not folders[0].exists() and folders[1].exists()
    assert result.agg(F.sum("x")).first()[0] == 90


def test_a_failure_removes_them_too(spark):
    with pytest.raises(RuntimeError), temporary_tables(spark):
        folder = _folder(materialize(spark.range(10), "step"))
        raise RuntimeError("lost")
    assert not folder.exists()
