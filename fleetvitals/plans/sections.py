"""Which reports run: switches to DataFrames, nothing built for a section that is off."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import DataFrame

from ..sources.textsink import run_header, write_sections
from . import reports as r
from .reports import Report, ReportOptions, Tables


@dataclass(frozen=True)
class Switches:
    """All off by default.

    ``inventory`` turns on the general, fragmentation and statistics sections and, where the
    database name contains ``product_mark``, the product versions. ``wait_interval`` and
    ``buffer_objects`` only count inside their sections.
    """

    inventory: bool = False
    general: bool = False
    waits: bool = False
    wait_interval: bool = False
    backups: bool = False
    io: bool = False
    cpu: bool = False
    memory: bool = False
    buffer_objects: bool = False
    jobs: bool = False
    security: bool = False
    fragmentation: bool = False
    statistics: bool = False
    product_mark: str | None = None


# Text widths that differ from the usual 30; None shows a column whole.
TEXT_WIDTHS: dict[str, dict[str, int | None]] = {
    "product_versions": {"product_version": None},
    "server_properties": {"server_name": 50},
    "connections": {"login_name": 50, "program_name": 50},
    "services": {
        "servicename": 50,
        "last_startup_time": 50,
        "service_account": 50,
        "filename": 172,
    },
    "manufacturer": {"line": None},
    "file_paths": {"physical_name": 172},
    "wait_statistics": {"wait_type": None},
    "waits_between_snapshots": {"wait_type": None},
    "backup_throughput": {"server_name": 50},
    "file_growth": {"logical_name": 50, "physical_name": 50},
    "file_stalls": {"physical_name": 172},
    "missing_indexes": {
        "statement": None,
        "equality_columns": None,
        "inequality_columns": None,
        "included_columns": None,
    },
    "autogrowth_events": {"event_name": None},
    "page_life_expectancy": {"server_name": 50, "object_name": 50},
    "memory_grants_pending": {"server_name": 50, "object_name": 72, "memory_grants_pending": 10},
    "buffer_by_object": {"index_name": 50},
    "os_memory": {"system_memory_state": None},
    "agent_jobs": {"job_name": 50, "job_description": 87},
    "sysadmins": {"details": 59},
    "security_admins": {"login": 50},
    "volatile_statistics": {"object_name": 50, "statistics_name": 50},
}


def chosen_reports(on: Switches, options: ReportOptions) -> list[Report]:
    general = on.general or on.inventory
    product = (
        on.inventory
        and on.product_mark is not None
        and on.product_mark in (options.database or "")
    )
    sections: list[tuple[bool, list[Report]]] = [
        (product, [r.product_versions]),
        (
            general,
            [
                r.server_properties,
                r.database_settings,
                r.connections,
                r.trace_flags,
                r.windows_information,
                r.services,
                r.numa_nodes,
                r.hardware,
                r.manufacturer,
                r.file_paths,
                r.integrity_checks,
            ],
        ),
        (on.waits and on.wait_interval, [r.waits_between_snapshots]),
        (on.waits, [r.wait_statistics]),
        (
            on.backups,
            [
                r.last_full_backup,
                r.last_log_backups,
                r.backup_throughput,
                r.file_growth,
                r.backup_sizes,
                r.log_segments,
            ],
        ),
        (
            on.io,
            [r.volumes, r.io_by_database, r.file_stalls, r.missing_indexes, r.autogrowth_events],
        ),
        (on.cpu, [r.cpu_history, r.signal_waits, r.cpu_by_database]),
        (on.memory, [r.page_life_expectancy, r.memory_grants_pending, r.buffer_by_database]),
        (on.memory and on.buffer_objects, [r.buffer_by_object]),
        (on.memory, [r.os_memory, r.process_memory, r.memory_over_physical]),
        (on.jobs, [r.agent_jobs]),
        (on.security, [r.sysadmins, r.security_admins]),
        (on.fragmentation or on.inventory, [r.index_fragmentation]),
        (on.statistics or on.inventory, [r.statistics_dates, r.volatile_statistics]),
    ]
    return [report for wanted, group in sections if wanted for report in group]


# Fixed value: what the text report calls itself.
REPORT_TITLE = "Database Performance Data"


def run_sections(
    tables: Tables,
    on: Switches,
    options: ReportOptions | None = None,
    for_text: bool = False,
) -> dict[str, DataFrame]:
    """The reports of the switched-on sections in report order, as lazy DataFrames by name.

    A table is opened only when a chosen report reads it. ``for_text`` sorts them for display.
    """
    options = options or ReportOptions()
    if for_text:
        options = replace(options, sorted=True)
    return {report.__name__: report(tables, options) for report in chosen_reports(on, options)}


def write_text(
    found: dict[str, DataFrame], path: str, title: str = REPORT_TITLE, ran_at: datetime | None = None
) -> None:
    """Write reports as text, a folder each, with the usual widths, and a header with the date."""
    header = run_header(title, ran_at or datetime.now())
    write_sections(found, path, TEXT_WIDTHS, header=header)
