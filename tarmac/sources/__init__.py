"""Readers and writers."""

from tarmac.sources.flights import Loaded, declare_flights, read_csv, read_parquet, split_flags
from tarmac.sources.reports import (
    read_ordered,
    read_report,
    reconcile_files,
    snapshot,
    write_report,
    write_scales,
)
from tarmac.sources.runs import append_run, compact_runs, read_runs, timed, write_runs

__all__ = [
    "Loaded",
    "append_run",
    "compact_runs",
    "declare_flights",
    "read_csv",
    "read_ordered",
    "read_parquet",
    "read_report",
    "read_runs",
    "reconcile_files",
    "snapshot",
    "split_flags",
    "timed",
    "write_report",
    "write_runs",
    "write_scales",
]
