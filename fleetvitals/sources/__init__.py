"""Readers, snapshot schemas and the text sink."""

from .files import (
    block_records,
    latest_rollover_rows,
    log_files,
    newest_file,
    numbered_log_lines,
    rollover_rows,
    rollover_set,
    write_logs,
    write_rollover,
)
from .tables import Tables, read_table
from .telemetry import SNAPSHOT_KEY, SNAPSHOTS, align, read_snapshots, write_snapshots
from .textsink import banner, render_text, write_sections

__all__ = [
    "SNAPSHOTS",
    "SNAPSHOT_KEY",
    "Tables",
    "align",
    "banner",
    "block_records",
    "latest_rollover_rows",
    "log_files",
    "newest_file",
    "numbered_log_lines",
    "read_snapshots",
    "read_table",
    "render_text",
    "rollover_rows",
    "rollover_set",
    "write_logs",
    "write_rollover",
    "write_sections",
    "write_snapshots",
]
