"""Readers, writers and the shared folder for intermediate tables."""

from labelscope.sources.reports import (
    publish,
    published_report,
    published_runs,
    read_report,
    write_report,
)
from labelscope.sources.scratch import materialize, shared_folder, temporary_tables
from labelscope.sources.tables import NULL_MARK, ensure_sample, read_csv, read_table, write_csv

__all__ = [
    "NULL_MARK",
    "ensure_sample",
    "materialize",
    "publish",
    "published_report",
    "published_runs",
    "read_csv",
    "read_report",
    "read_table",
    "shared_folder",
    "temporary_tables",
    "write_csv",
    "write_report",
]
