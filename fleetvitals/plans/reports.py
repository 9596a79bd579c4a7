"""The health reports, each for every server and snapshot at once.

A report takes the snapshot tables and the options and returns a DataFrame that starts with
``server_name, snapshot_ts``; what is a total, a rank or a "top n" on one server is one per server
and snapshot here. With ``ReportOptions.database`` the reports about one database are limited to
it; without, they cover every database. ``ReportOptions.sorted`` sorts them for display, by server
and snapshot first; that costs a range sort of each report, so only text output asks for it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import operators as ops
from ..functions import early_percent, round_ratio, style_100, whole_div
from ..sources.telemetry import DATABASE_KEY, SNAPSHOT_KEY
from . import constants as k

Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class ReportOptions:
    """What the reports can be told; the defaults are the usual ones."""

    database: str | None = None
    coverage_pct: int = 99
    idle_waits: tuple[str, ...] = k.IDLE_WAITS
    log_backups: int = 5
    min_backup_bytes: int = 5368709120
    min_backup_secs: int = 1
    cpu_minutes: int = 256
    grant_samples: int = 16
    fragmented_pages: int = 5000
    strict_index_names: bool = True
    volatile_statistics: int = 50
    job_text: int = 87
    builtin_admin: str = "sa"
    log_term: str = k.MANUFACTURER_TERM
    sorted: bool = False


Report = Callable[[Tables, ReportOptions], DataFrame]


def _sorted(o: ReportOptions, df: DataFrame, *order: str | Column) -> DataFrame:
    """Sort for display, if asked to. Costly conversions come after it: a sort looks at its input
    twice."""
    return df.orderBy(*SNAPSHOT_KEY, *order) if o.sorted else df


def _one_database(options: ReportOptions, column: str = "database_name") -> Column | None:
    return None if options.database is None else F.col(column) == options.database


def _limited(df: DataFrame, options: ReportOptions, column: str = "database_name") -> DataFrame:
    chosen = _one_database(options, column)
    return df if chosen is None else df.where(chosen)


def _database_names(t: Tables) -> DataFrame:
    return t["databases"].select(
        *SNAPSHOT_KEY, "database_id", F.col("name").alias("database_name")
    )


def _with_database(df: DataFrame, t: Tables, how: str = "left") -> DataFrame:
    """Add the database's name; an id without a name keeps NULL."""
    return df.join(_database_names(t), [*SNAPSHOT_KEY, "database_id"], how)


def _columns(table: DataFrame) -> dict[str, str]:
    return {c: c for c in table.columns if c not in SNAPSHOT_KEY}


def _order(o: ReportOptions, *order: str | Column) -> list[str | Column] | None:
    return list(order) if o.sorted and order else None


def _listing(o: ReportOptions, table: DataFrame, *order: str) -> DataFrame:
    return ops.unit_projection(
        table, _columns(table), order=_order(o, *order), scope=SNAPSHOT_KEY
    )


# General


def product_versions(t: Tables, o: ReportOptions) -> DataFrame:
    return _listing(o, t["product_history"], "mod_time")


def server_properties(t: Tables, o: ReportOptions) -> DataFrame:
    return _listing(o, t["server_properties"])


def database_settings(t: Tables, o: ReportOptions) -> DataFrame:
    """Settings next to the size and use of the log; a database lacking either counter is left out."""
    paired = ops.counter_pair_ratio(
        t["databases"],
        t["performance_counters"],
        ("name", "instance_name"),
        k.LOG_USED_COUNTER,
        k.LOG_SIZE_COUNTER,
        scope=SNAPSHOT_KEY,
    )
    settings = [c for c in t["databases"].columns if c not in SNAPSHOT_KEY]
    return _sorted(o, paired, "name").select(
        *SNAPSHOT_KEY,
        *settings,
        round_ratio("denominator", 1024, 2).alias("log_size_mb"),
        round_ratio("numerator", 1024, 2).alias("log_used_mb"),
        F.col("percent").alias("log_used_percent"),
    )


def connections(t: Tables, o: ReportOptions) -> DataFrame:
    counted = ops.count_by(
        t["sessions"],
        ["login_name", "program_name"],
        "session_id",
        alias="session_count",
        scope=SNAPSHOT_KEY,
    )
    return _sorted(o, counted, F.desc("session_count"), "login_name", "program_name")


def trace_flags(t: Tables, o: ReportOptions) -> DataFrame:
    return _listing(o, t["trace_flags"], "flag")


def windows_information(t: Tables, o: ReportOptions) -> DataFrame:
    return _listing(o, t["windows_info"])


def services(t: Tables, o: ReportOptions) -> DataFrame:
    return _listing(o, t["services"], "servicename")


def numa_nodes(t: Tables, o: ReportOptions) -> DataFrame:
    return ops.unit_projection(
        t["nodes"],
        _columns(t["nodes"]),
        where=F.col("node_state_desc") != k.ADMIN_CONNECTION_NODE,
        order=_order(o, "node_id"),
        scope=SNAPSHOT_KEY,
    )


def hardware(t: Tables, o: ReportOptions) -> DataFrame:
    """Processors and memory; physical processors by whole-number division."""
    return ops.unit_projection(
        t["sys_info"],
        {
            "logical_cpu_count": "cpu_count",
            "scheduler_count": "scheduler_count",
            "hyperthread_ratio": "hyperthread_ratio",
            "physical_cpu_count": whole_div("cpu_count", "hyperthread_ratio"),
            "physical_memory_mb": whole_div("physical_memory_kb", 1024),
            "max_workers_count": "max_workers_count",
            "affinity_type": "affinity_type_desc",
            "server_start_time": "sqlserver_start_time",
            "virtual_machine_type": "virtual_machine_type_desc",
        },
        scope=SNAPSHOT_KEY,
    )


def manufacturer(t: Tables, o: ReportOptions) -> DataFrame:
    lines = ops.log_lines(t["error_log"], "text", o.log_term, keep=SNAPSHOT_KEY, ignore_case=True)
    return lines.drop("line_no")


def file_paths(t: Tables, o: ReportOptions) -> DataFrame:
    """Files of user databases and of the temporary database.

    ``growth_mb`` is only meaningful where ``is_percent_growth`` is 0.
    """
    return ops.scoped_listing(
        _with_database(t["master_files"], t),
        "database_id",
        {
            "database_name": "database_name",
            "file_id": "file_id",
            "name": "name",
            "physical_name": "physical_name",
            "type_desc": "type_desc",
            "state_desc": "state_desc",
            "is_percent_growth": "is_percent_growth",
            "growth": "growth",
            "growth_mb": whole_div("growth", 128),
            "size_mb": whole_div("size", 128),
        },
        min_id=k.LAST_SYSTEM_DATABASE,
        excluded_id=k.RESOURCE_DATABASE,
        always_id=k.TEMP_DATABASE,
        order=_order(o, "database_name", "file_id"),
        scope=SNAPSHOT_KEY,
    )


def integrity_checks(t: Tables, o: ReportOptions) -> DataFrame:
    """When each database last passed its check, by date and not by the date's text.

    A value that is no date keeps its row, without a date.
    """
    picked = _limited(t["dbinfo"], o)
    found = ops.drop_exact_duplicates(
        picked.select(
            *DATABASE_KEY, "Field", F.col("Value").try_cast("timestamp_ntz").alias("checked_at")
        )
    )
    labelled = ops.key_value_pick(
        found,
        k.CHECK_FIELD,
        "checked_at",
        F.lit(k.NEVER).cast("timestamp_ntz"),
        k.NEVER_LABEL,
        keep=[*DATABASE_KEY, "checked_at"],
        shown=style_100("checked_at"),
        alias="last_clean_check",
    )
    return _sorted(o, labelled, "checked_at", "database_name").drop("checked_at")


# Waits


def waits_between_snapshots(t: Tables, o: ReportOptions) -> DataFrame:
    """Waits of the time between two snapshots, in place of clearing the counters and waiting."""
    return ops.counter_delta(
        t["wait_stats"],
        ["server_name", "wait_type"],
        ["snapshot_ts"],
        ["waiting_tasks_count", "wait_time_ms", "signal_wait_time_ms"],
    )


def wait_statistics(t: Tables, o: ReportOptions) -> DataFrame:
    """The waits that make up the coverage percentage, with averages per wait.

    A server knows about a thousand wait types, so each server's ranking is small by nature.
    A snapshot whose waits are all zero has no shares and shows no rows.
    """
    waits = t["wait_stats"].where(F.col("waiting_tasks_count") > 0)
    top = ops.coverage_topk(
        waits,
        "wait_type",
        "wait_time_ms",
        pct=o.coverage_pct,
        exclude=o.idle_waits,
        measures={
            "signal_ms": F.col("signal_wait_time_ms"),
            "wait_count": F.col("waiting_tasks_count"),
        },
        scope=SNAPSHOT_KEY,
        few_groups=True,
        one_row_per_key=True,
    )
    resource = F.col("value") - F.col("signal_ms")
    per_wait = F.col("wait_count") * F.lit(1000)
    return _sorted(o, top, "row_rank").select(
        *SNAPSHOT_KEY,
        "wait_type",
        round_ratio("value", 1000, 2, 16).alias("wait_sec"),
        round_ratio(resource, 1000, 2, 16).alias("resource_sec"),
        round_ratio("signal_ms", 1000, 2, 16).alias("signal_sec"),
        "wait_count",
        round_ratio("value", "total", 2, 5, times=100).alias("wait_percentage"),
        round_ratio("value", per_wait, 4, 16).alias("avg_wait_sec"),
        round_ratio(resource, per_wait, 4, 16).alias("avg_resource_sec"),
        round_ratio("signal_ms", per_wait, 4, 16).alias("avg_signal_sec"),
    )


# Backups


def _newest_full_backup(t: Tables, o: ReportOptions) -> DataFrame:
    chosen = F.col("type") == k.FULL_BACKUP
    database = _one_database(o)
    return ops.latest_per_group(
        t["backupset"],
        "database_name",
        [F.desc("backup_finish_date"), F.desc("backup_set_id")],
        where=chosen if database is None else chosen & database,
        facts=[(t["backupmediafamily"], ["media_set_id"])],
        scope=SNAPSHOT_KEY,
    )


def last_full_backup(t: Tables, o: ReportOptions) -> DataFrame:
    """The newest full backup of each database, one row per medium it was written to."""
    return _sorted(
        o,
        _newest_full_backup(t, o).select(
            *DATABASE_KEY,
            F.col("backup_finish_date").alias("backup_date"),
            "physical_device_name",
            "logical_device_name",
        ),
        "database_name",
        "physical_device_name",
    )


def last_log_backups(t: Tables, o: ReportOptions) -> DataFrame:
    """The newest rows of log backup and medium; a backup on two media takes two places."""
    chosen = F.col("type") == k.LOG_BACKUP
    database = _one_database(o)
    newest = ops.recent_n(
        t["backupset"],
        [
            F.desc("backup_finish_date"),
            F.desc("backup_set_id"),
            "physical_device_name",
            "logical_device_name",
        ],
        o.log_backups,
        where=chosen if database is None else chosen & database,
        facts=[(t["backupmediafamily"], ["media_set_id"])],
        scope=DATABASE_KEY,
    )
    return _sorted(
        o,
        newest.select(
            *DATABASE_KEY,
            F.col("backup_finish_date").alias("backup_date"),
            "physical_device_name",
            "logical_device_name",
        ),
        "database_name",
        F.desc("backup_date"),
        "physical_device_name",
    )


def backup_throughput(t: Tables, o: ReportOptions) -> DataFrame:
    """MB per second of full backups, per month; the mean of the backups' rates."""
    monthly = ops.throughput_by_month(
        t["backupset"].where(F.col("type") == k.FULL_BACKUP),
        "backup_size",
        "backup_start_date",
        "backup_finish_date",
        min_size=o.min_backup_bytes,
        min_secs=o.min_backup_secs,
        scope=SNAPSHOT_KEY,
    )
    return _sorted(o, monthly, F.desc("year"), F.desc("month"))


def file_growth(t: Tables, o: ReportOptions) -> DataFrame:
    """File sizes at every full backup, in MB."""
    chosen = F.col("type") == k.FULL_BACKUP
    database = _one_database(o)
    return ops.size_history(
        t["backupset"].drop("backup_size"),
        t["backupfile"],
        "backup_set_id",
        {
            "file_size_mb": ("file_size", 1048576),
            "consumed_size_mb": ("backup_size", 1048576),
        },
        ["database_name", "logical_name", "physical_name", "backup_finish_date"],
        where=chosen if database is None else chosen & database,
        order=_order(o, "database_name", F.desc("backup_finish_date"), "logical_name"),
        scope=SNAPSHOT_KEY,
    )


def backup_sizes(t: Tables, o: ReportOptions) -> DataFrame:
    """The uncompressed size of each database's newest full backup, one row per medium."""
    return _sorted(
        o,
        _newest_full_backup(t, o).select(
            *DATABASE_KEY,
            "backup_finish_date",
            F.col("backup_size").alias("uncompressed_size"),
        ),
        "database_name",
    )


def log_segments(t: Tables, o: ReportOptions) -> DataFrame:
    """Log segments per database; 0 for a database without any."""
    counted = ops.count_per_member(
        t["databases"].select(*SNAPSHOT_KEY, F.col("name").alias("database_name")),
        t["vlf_info"],
        ("database_name", "database_name"),
        alias="segment_count",
        scope=SNAPSHOT_KEY,
    )
    return _sorted(o, counted, F.desc("segment_count"), "database_name")


# I/O


def volumes(t: Tables, o: ReportOptions) -> DataFrame:
    """Volumes under the database files, each once; free space in whole percents."""
    found = ops.distinct_lateral(
        t["master_files"],
        t["volume_stats"],
        ["database_id", "file_id"],
        [
            "volume_mount_point",
            "file_system_type",
            "logical_volume_name",
            round_ratio("total_bytes", 1073741824, 2).alias("total_gb"),
            round_ratio("available_bytes", 1073741824, 2).alias("available_gb"),
            early_percent("available_bytes", "total_bytes").alias("free_percent"),
        ],
        scope=SNAPSHOT_KEY,
    )
    return _sorted(o, found, "volume_mount_point")


def io_by_database(t: Tables, o: ReportOptions) -> DataFrame:
    """Databases by bytes moved, in whole MB, and their share. The rank is a number."""
    per_database = (
        t["file_stats"]
        .groupBy(*SNAPSHOT_KEY, "database_id")
        .agg(F.sum(F.col("num_of_bytes_read") + F.col("num_of_bytes_written")).alias("_bytes"))
        .select(*SNAPSHOT_KEY, "database_id", whole_div("_bytes", 1048576).alias("_mb"))
    )
    ranked = ops.share_rank(
        per_database,
        "database_id",
        "_mb",
        scope=SNAPSHOT_KEY,
        few_groups=True,
        one_row_per_key=True,
    )
    return _sorted(o, _with_database(ranked, t), "row_rank").select(
        *SNAPSHOT_KEY,
        F.col("row_rank").alias("io_rank"),
        "database_name",
        F.col("value").cast("decimal(12,2)").alias("total_io_mb"),
        round_ratio("value", "total", 2, 5, times=100).alias("io_percent"),
    )


def file_stalls(t: Tables, o: ReportOptions) -> DataFrame:
    """Average stall per read, write and operation of every file, most stalled first."""
    stall = F.col("io_stall_read_ms") + F.col("io_stall_write_ms")
    operations = F.col("num_of_reads") + F.col("num_of_writes")
    files = t["master_files"].select(*SNAPSHOT_KEY, "database_id", "file_id", "physical_name")
    averaged = ops.smoothed_average(
        t["file_stats"],
        _with_database(files, t),
        ["database_id", "file_id"],
        {
            "avg_read_stall_ms": ("io_stall_read_ms", "num_of_reads"),
            "avg_write_stall_ms": ("io_stall_write_ms", "num_of_writes"),
            "avg_io_stall_ms": (stall, operations),
        },
        order=_order(o, stall.desc(), "physical_name"),
        scope=SNAPSHOT_KEY,
    )
    return averaged.select(
        *SNAPSHOT_KEY,
        "database_name",
        "physical_name",
        "io_stall_read_ms",
        "num_of_reads",
        "avg_read_stall_ms",
        "io_stall_write_ms",
        "num_of_writes",
        "avg_write_stall_ms",
        stall.alias("io_stalls"),
        operations.alias("total_io"),
        "avg_io_stall_ms",
    )


def missing_indexes(t: Tables, o: ReportOptions) -> DataFrame:
    """Missing indexes by estimated advantage: seeks x cost x impact."""
    details = _limited(_with_database(t["missing_index_details"], t), o)
    scored = ops.advantage_score(
        t["missing_index_group_stats"],
        t["missing_index_groups"].withColumnRenamed("index_group_handle", "group_handle"),
        details,
        "group_handle",
        "index_handle",
        ["user_seeks", "avg_total_user_cost", "avg_user_impact"],
        alias="index_advantage",
        scope=SNAPSHOT_KEY,
    )
    return _sorted(
        o,
        scored.select(
            *SNAPSHOT_KEY,
            "index_advantage",
            "last_user_seek",
            "database_name",
            "statement",
            "equality_columns",
            "inequality_columns",
            "included_columns",
            "unique_compiles",
            "user_seeks",
            "avg_total_user_cost",
            "avg_user_impact",
        ),
        F.desc("index_advantage"),
        "statement",
    )


def autogrowth_events(t: Tables, o: ReportOptions) -> DataFrame:
    """Files that grew by themselves, from all rolled-over trace files."""
    rows = _with_database(t["trace_rows"].withColumnRenamed("databaseid", "database_id"), t)
    grown = ops.rollover_events(
        rows,
        k.AUTOGROW_CLASSES,
        t["trace_events"],
        where=_one_database(o),
        scope=SNAPSHOT_KEY,
    )
    return _sorted(
        o,
        grown.select(
            *SNAPSHOT_KEY,
            "StartTime",
            F.col("name").alias("event_name"),
            "database_name",
            "Filename",
            "growth_mb",
            "dur_ms",
        ),
        "StartTime",
        "Filename",
    )


# CPU

CPU_RECORD = """_id int, SchedulerMonitorEvent struct<
    SystemHealth: struct<SystemIdle: int, ProcessUtilization: int>>"""


def cpu_history(t: Tables, o: ReportOptions) -> DataFrame:
    """Processor use of the last minutes, newest first, with times from the snapshot's clock."""
    clock = t["sys_info"].select(
        *SNAPSHOT_KEY,
        whole_div("cpu_ticks", whole_div("cpu_ticks", "ms_ticks")).alias("now_ticks"),
    )
    records = (
        t["ring_buffers"].where(F.col("ring_buffer_type") == k.CPU_RING).join(clock, SNAPSHOT_KEY)
    )
    health = F.col("parsed.SchedulerMonitorEvent.SystemHealth")
    newest = ops.payload_history(
        records,
        "record",
        F.from_xml("record", CPU_RECORD),
        {
            "record_id": F.col("parsed._id"),
            "sql_cpu": health["ProcessUtilization"],
            "idle": health["SystemIdle"],
            "other_cpu": F.lit(100) - health["SystemIdle"] - health["ProcessUtilization"],
        },
        [F.desc("record_id"), F.desc("event_time")],
        must_contain=k.CPU_RECORD_MARK,
        n=o.cpu_minutes,
        event_time=ops.event_time_from_ticks("snapshot_ts", "now_ticks", "timestamp"),
        scope=SNAPSHOT_KEY,
    )
    return _sorted(o, newest, F.desc("record_id")).drop("record_id")


def signal_waits(t: Tables, o: ReportOptions) -> DataFrame:
    """Share of waiting for a processor; above 10 to 15 % hints at too little processor."""
    shares = ops.global_ratio(
        t["wait_stats"],
        "signal_wait_time_ms",
        "wait_time_ms",
        exclude=o.idle_waits,
        exclude_on="wait_type",
        scope=SNAPSHOT_KEY,
    )
    return _sorted(
        o,
        shares.select(
            *SNAPSHOT_KEY,
            F.col("part_percent").alias("signal_percent"),
            F.col("rest_percent").alias("resource_percent"),
        )
    )


def cpu_by_database(t: Tables, o: ReportOptions) -> DataFrame:
    """Databases by processor time of their cached plans.

    The reserved database and plans without a database leave before rank and share.
    """
    per_database = ops.lateral_attribute_rollup(
        t["query_stats"],
        t["plan_attributes"],
        "plan_handle",
        "dbid",
        "total_worker_time",
        alias="database_id",
        scope=SNAPSHOT_KEY,
    )
    ranked = ops.share_rank(
        per_database,
        "database_id",
        "value",
        exclude=[k.RESOURCE_DATABASE],
        scope=SNAPSHOT_KEY,
        few_groups=True,
        one_row_per_key=True,
    )
    return _sorted(o, _with_database(ranked, t), "row_rank").select(
        *SNAPSHOT_KEY,
        F.col("row_rank").alias("cpu_rank"),
        "database_name",
        F.col("value").alias("cpu_time"),
        round_ratio("value", "total", 2, 5, times=100).alias("cpu_percent"),
    )


# Memory


def _gauge(t: Tables, object_like: str, counter: str, alias: str) -> DataFrame:
    return ops.gauge(t["performance_counters"], object_like, counter).select(
        *SNAPSHOT_KEY, "object_name", F.col("cntr_value").alias(alias)
    )


def page_life_expectancy(t: Tables, o: ReportOptions) -> DataFrame:
    return _sorted(
        o,
        _gauge(t, k.PAGE_LIFE_OBJECT, k.PAGE_LIFE_COUNTER, "page_life_expectancy"),
        "object_name",
    )


def memory_grants_pending(t: Tables, o: ReportOptions) -> DataFrame:
    """The first readings of each server in the order they were taken, each once."""
    readings = _gauge(t, k.GRANTS_OBJECT, k.GRANTS_COUNTER, "memory_grants_pending")
    polled = ops.first_n_samples(
        readings,
        "server_name",
        ["snapshot_ts", "object_name", "memory_grants_pending"],
        o.grant_samples,
    )
    return polled.orderBy("server_name", "sample") if o.sorted else polled


def buffer_by_database(t: Tables, o: ReportOptions) -> DataFrame:
    cached = ops.pages_to_mb(
        t["buffer_descriptors"],
        "database_id",
        id_column="database_id",
        min_id=k.LAST_SYSTEM_DATABASE,
        excluded_id=k.RESOURCE_DATABASE,
        scope=SNAPSHOT_KEY,
    )
    return _sorted(
        o,
        _with_database(cached, t).select(
            *SNAPSHOT_KEY, "database_name", F.col("mb").alias("cached_size_mb")
        ),
        F.desc("cached_size_mb"),
        "database_name",
    )


# What a unit of each type belongs to.
OWNERS = ((1, "hobt_id"), (3, "hobt_id"), (2, "partition_id"))


def buffer_by_object(t: Tables, o: ReportOptions) -> DataFrame:
    """Cached pages per object and index.

    Units of type 1 and 3 belong to a partition's row store, units of type 2 to the partition.
    Pages, by far the most rows, carry the database's id; the units get it too, so pages are
    counted before anything is joined to them. Pages of databases without a name are one row with
    nothing but their number, unless one database is asked for.
    """
    names = _database_names(t)
    units = _limited(t["allocation_units"], o).join(names, DATABASE_KEY)
    partition = t["partitions"].select(*DATABASE_KEY, "hobt_id", "partition_id", "object_id", "index_id")
    # One row per way to own a unit, so units meet their owners in one join.
    owner = F.explode(
        F.array(
            *[F.struct(F.lit(kind).alias("type"), F.col(c).alias("container_id")) for kind, c in OWNERS]
        )
    )
    owners = partition.select(*DATABASE_KEY, "object_id", "index_id", owner.alias("owner")).select(
        *DATABASE_KEY, "object_id", "index_id", "owner.*"
    )
    owned = units.join(owners, [*DATABASE_KEY, "type", "container_id"]).select(
        *DATABASE_KEY, "database_id", "allocation_unit_id", "object_id", "index_id"
    )

    objects = t["objects"].select(*DATABASE_KEY, "object_id", F.col("name").alias("table_name"))
    indexes = t["indexes"].select(
        *DATABASE_KEY,
        "object_id",
        "index_id",
        F.col("name").alias("index_name"),
        F.col("type_desc").alias("index_type"),
    )
    counted = ops.union_hierarchy_count(
        [owned.join(objects, [*DATABASE_KEY, "object_id"], "left")],
        indexes,
        t["buffer_descriptors"],
        ["database_name", "object_id", "index_id"],
        ["database_id", "allocation_unit_id"],
        ["database_name", "table_name", "index_id", "index_name", "index_type"],
        alias="cached_pages",
        scope=SNAPSHOT_KEY,
    )
    shown = counted.drop("index_id")
    if o.database is None:
        pages = t["buffer_descriptors"].groupBy(*SNAPSHOT_KEY, "database_id").agg(
            F.count("*").alias("cached_pages")
        )
        unnamed = pages.join(names, [*SNAPSHOT_KEY, "database_id"], "left_anti")
        unnamed = unnamed.groupBy(*SNAPSHOT_KEY).agg(F.sum("cached_pages").alias("cached_pages"))
        shown = shown.unionByName(unnamed, allowMissingColumns=True)
    return _sorted(o, shown, "database_name", F.desc("cached_pages"), "table_name", "index_name")


def os_memory(t: Tables, o: ReportOptions) -> DataFrame:
    in_mb = (
        "total_physical_memory",
        "available_physical_memory",
        "total_page_file",
        "available_page_file",
        "system_cache",
    )
    return ops.unit_projection(
        t["sys_memory"],
        {
            **{f"{c}_mb": whole_div(f"{c}_kb", 1024) for c in in_mb},
            "system_memory_state": "system_memory_state_desc",
        },
        scope=SNAPSHOT_KEY,
    )


def process_memory(t: Tables, o: ReportOptions) -> DataFrame:
    return _listing(o, t["process_memory"])


def memory_over_physical(t: Tables, o: ReportOptions) -> DataFrame:
    """Servers allowed to use more memory than they have.

    ``min_memory_mb`` is the smallest value the setting may take, not a configured minimum.
    """
    breached = ops.setting_breach(
        t["sys_memory"],
        t["configurations"],
        k.MEMORY_SETTING,
        F.col("total_physical_memory_kb") < F.col("value_in_use") * F.lit(1024),
        keep=["minimum", "value_in_use"],
        scope=SNAPSHOT_KEY,
    )
    return _sorted(
        o,
        breached.select(
            *SNAPSHOT_KEY,
            F.col("minimum").alias("min_memory_mb"),
            F.col("value_in_use").alias("max_memory_mb"),
            whole_div("total_physical_memory_kb", 1024).alias("server_memory_mb"),
        )
    )


# Jobs and security


def agent_jobs(t: Tables, o: ReportOptions) -> DataFrame:
    """Jobs with their category; an owner no longer known shows NULL."""
    owners = t["logins"].select(
        *SNAPSHOT_KEY, F.col("sid").alias("owner_sid"), F.col("name").alias("job_owner")
    )
    listed = ops.dimension_listing(
        t["jobs"],
        t["job_categories"].select(
            *SNAPSHOT_KEY, "category_id", F.col("name").alias("category_name")
        ),
        "category_id",
        "description",
        o.job_text,
        scope=SNAPSHOT_KEY,
    ).join(owners, [*SNAPSHOT_KEY, "owner_sid"], "left")
    return _sorted(
        o,
        listed.select(
            *SNAPSHOT_KEY,
            F.col("name").alias("job_name"),
            F.col("description").alias("job_description"),
            "job_owner",
            "date_created",
            "enabled",
            "notify_email_operator_id",
            "category_name",
        ),
        "job_name",
    )


def _may_log_in(flag: str) -> Column:
    return (F.col(flag) == 1) & (F.col("denylogin") == 0)


def sysadmins(t: Tables, o: ReportOptions) -> DataFrame:
    found = ops.flagged_members(
        t["logins"],
        _may_log_in("sysadmin"),
        "name",
        "Sysadmins",
        exclude=o.builtin_admin,
        scope=SNAPSHOT_KEY,
    )
    return _sorted(o, found, "details")


def security_admins(t: Tables, o: ReportOptions) -> DataFrame:
    """Who can give rights to others, themselves included."""
    found = ops.flagged_members(
        t["logins"],
        _may_log_in("securityadmin"),
        "name",
        "Security Admin",
        exclude=o.builtin_admin,
        pattern=("", ""),
        scope=SNAPSHOT_KEY,
    )
    return _sorted(o, found.withColumnRenamed("details", "login"), "login")


# Indexes and statistics


def index_fragmentation(t: Tables, o: ReportOptions) -> DataFrame:
    """Fragmentation of large indexes; row counts by key unless ``strict_index_names`` is off."""
    joined = ops.detail_over_threshold(
        _limited(t["index_physical_stats"], o),
        t["indexes"].select(*DATABASE_KEY, "object_id", "index_id", F.col("name").alias("index_name")),
        t["tables"].select(*DATABASE_KEY, "object_id", F.col("name").alias("table_name")),
        t["sysindexes"],
        names_on=["object_id", "index_id"],
        parents_on=["object_id"],
        name="index_name",
        counts_name="name",
        counts_on=["object_id", "index_id"],
        where=F.col("page_count") > o.fragmented_pages,
        strict_keys=o.strict_index_names,
        scope=DATABASE_KEY,
    )
    return _sorted(
        o,
        joined.select(
            *DATABASE_KEY, "table_name", "index_name", "rowcnt", "avg_fragmentation_in_percent"
        ),
        "database_name",
        "table_name",
        "index_name",
    )


def statistics_dates(t: Tables, o: ReportOptions) -> DataFrame:
    """When each index's statistics were last gathered; a heap shows no name."""
    members = _limited(t["indexes"], o).select(
        *DATABASE_KEY, "object_id", "index_id", F.col("name").alias("index_name")
    )
    tables = t["tables"].select(*DATABASE_KEY, "object_id", F.col("name").alias("table_name"))
    dated = ops.last_update(
        members.join(tables, [*DATABASE_KEY, "object_id"]),
        t["stats_properties"],
        [("object_id", "object_id"), ("index_id", "stats_id")],
        "last_updated",
        alias="stats_updated",
        scope=DATABASE_KEY,
    )
    return _sorted(
        o,
        dated.select(*DATABASE_KEY, "table_name", "index_name", "stats_updated"),
        "database_name",
        "table_name",
        "index_name",
    )


def volatile_statistics(t: Tables, o: ReportOptions) -> DataFrame:
    """The statistics with the most modifications since they were gathered."""
    objects = t["objects"].select(
        *DATABASE_KEY, "object_id", F.col("name").alias("object_name"), "type_desc"
    )
    stats = t["stats"].withColumnRenamed("name", "statistics_name")
    top = ops.top_volatile(
        _limited(t["stats_properties"], o),
        "modification_counter",
        ["object_name", "object_id", "stats_id"],
        o.volatile_statistics,
        facts=[(stats, ["object_id", "stats_id"]), (objects, ["object_id"])],
        scope=DATABASE_KEY,
    )
    return _sorted(
        o,
        top.select(
            *DATABASE_KEY,
            "object_name",
            "object_id",
            "type_desc",
            "statistics_name",
            "stats_id",
            "no_recompute",
            "auto_created",
            "modification_counter",
            "rows",
            "rows_sampled",
            "last_updated",
        ),
        "database_name",
        F.desc("modification_counter"),
        "object_name",
    )
