"""Snapshot tables of the fleet: schemas, reading and alignment of older collectors.

Every table starts with the server it came from and the time it was collected. Tables about the
inside of a database also carry ``database_name``, so all databases of all servers are one table
and no loop over databases is needed. ``write_snapshots`` stores them in folders by
``snapshot_date``, backups also by their type, and ``read_snapshots`` opens the folders asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..functions.numeric import whole_div

SNAPSHOT_KEY = ["server_name", "snapshot_ts"]
DATABASE_KEY = [*SNAPSHOT_KEY, "database_name"]

_KEY = "server_name string, snapshot_ts timestamp_ntz"
_DATABASE = f"{_KEY}, database_name string"

SNAPSHOTS: dict[str, str] = {
    "product_history": f"{_KEY}, product_version string, mod_time timestamp_ntz",
    "server_properties": f"""{_KEY}, machine_name string, instance_name string,
        is_clustered string, physical_netbios_name string, edition string, product_level string,
        product_version string, process_id string, is_hadr_enabled string,
        hadr_manager_status string""",
    "databases": f"""{_KEY}, database_id int, name string, recovery_model_desc string,
        state_desc string, log_reuse_wait_desc string, compatibility_level int,
        page_verify_option_desc string, is_auto_create_stats_on int, is_auto_update_stats_on int,
        is_auto_update_stats_async_on int, is_parameterization_forced int,
        snapshot_isolation_state_desc string, is_read_committed_snapshot_on int,
        is_auto_close_on int, is_auto_shrink_on int, target_recovery_time_in_seconds int,
        is_cdc_enabled int""",
    "performance_counters": f"""{_KEY}, object_name string, counter_name string,
        instance_name string, cntr_value bigint""",
    "sessions": f"{_KEY}, session_id int, login_name string, program_name string",
    "trace_flags": f"{_KEY}, flag int, global int",
    "windows_info": f"""{_KEY}, windows_release string, windows_service_pack_level string,
        windows_sku int, os_language_version int""",
    "services": f"""{_KEY}, servicename string, process_id int, startup_type_desc string,
        status_desc string, last_startup_time timestamp_ntz, service_account string,
        is_clustered string, cluster_nodename string, filename string""",
    "nodes": f"""{_KEY}, node_id int, node_state_desc string, memory_node_id int,
        processor_group int, online_scheduler_count int, active_worker_count int,
        avg_load_balance int, resource_monitor_state int""",
    "sys_info": f"""{_KEY}, cpu_count int, scheduler_count int, hyperthread_ratio int,
        physical_memory_kb bigint, max_workers_count int, affinity_type_desc string,
        sqlserver_start_time timestamp_ntz, virtual_machine_type_desc string, cpu_ticks bigint,
        ms_ticks bigint""",
    "error_log": f"{_KEY}, text string",
    "master_files": f"""{_KEY}, database_id int, file_id int, name string, physical_name string,
        type_desc string, state_desc string, is_percent_growth int, growth bigint, size bigint""",
    "dbinfo": f"{_DATABASE}, ParentObject string, Object string, Field string, Value string",
    "wait_stats": f"""{_KEY}, wait_type string, waiting_tasks_count bigint, wait_time_ms bigint,
        signal_wait_time_ms bigint""",
    "backupset": f"""{_DATABASE}, backup_set_id bigint, media_set_id bigint, type string,
        backup_start_date timestamp_ntz, backup_finish_date timestamp_ntz,
        backup_size decimal(20,0)""",
    "backupmediafamily": f"""{_KEY}, media_set_id bigint, physical_device_name string,
        logical_device_name string""",
    "backupfile": f"""{_KEY}, backup_set_id bigint, file_size decimal(20,0),
        backup_size decimal(20,0), logical_name string, physical_name string""",
    "vlf_info": f"""{_DATABASE}, RecoveryUnitID int, FileID int, FileSize bigint,
        StartOffset bigint, FSeqNo bigint, Status bigint, Parity bigint,
        CreateLSN decimal(38,0)""",
    "volume_stats": f"""{_KEY}, database_id int, file_id int, volume_mount_point string,
        file_system_type string, logical_volume_name string, total_bytes bigint,
        available_bytes bigint""",
    "file_stats": f"""{_KEY}, database_id int, file_id int, num_of_bytes_read bigint,
        num_of_bytes_written bigint, io_stall_read_ms bigint, num_of_reads bigint,
        io_stall_write_ms bigint, num_of_writes bigint""",
    "missing_index_group_stats": f"""{_KEY}, group_handle int, user_seeks bigint,
        avg_total_user_cost double, avg_user_impact double, last_user_seek timestamp_ntz,
        unique_compiles bigint""",
    "missing_index_groups": f"{_KEY}, index_group_handle int, index_handle int",
    "missing_index_details": f"""{_KEY}, index_handle int, database_id int, statement string,
        equality_columns string, inequality_columns string, included_columns string""",
    "trace_rows": f"""{_KEY}, StartTime timestamp_ntz, EventClass int, databaseid int,
        Filename string, IntegerData bigint, duration bigint""",
    "trace_events": f"{_KEY}, trace_event_id int, name string",
    "ring_buffers": f"{_KEY}, ring_buffer_type string, timestamp bigint, record string",
    "query_stats": f"{_KEY}, plan_handle string, total_worker_time bigint",
    "plan_attributes": f"{_KEY}, plan_handle string, attribute string, value string",
    "buffer_descriptors": f"{_KEY}, database_id int, allocation_unit_id bigint",
    "allocation_units": f"{_DATABASE}, allocation_unit_id bigint, container_id bigint, type int",
    "partitions": f"""{_DATABASE}, hobt_id bigint, partition_id bigint, object_id int,
        index_id int""",
    "objects": f"{_DATABASE}, object_id int, name string, type_desc string",
    "indexes": f"{_DATABASE}, object_id int, index_id int, name string, type_desc string",
    "sys_memory": f"""{_KEY}, total_physical_memory_kb bigint,
        available_physical_memory_kb bigint, total_page_file_kb bigint,
        available_page_file_kb bigint, system_cache_kb bigint, system_memory_state_desc string""",
    "process_memory": f"""{_KEY}, physical_memory_in_use_kb bigint,
        locked_page_allocations_kb bigint, page_fault_count bigint,
        memory_utilization_percentage int, available_commit_limit_kb bigint,
        process_physical_memory_low int, process_virtual_memory_low int""",
    "configurations": f"{_KEY}, name string, minimum bigint, value_in_use bigint",
    "jobs": f"""{_KEY}, name string, description string, owner_sid string,
        date_created timestamp_ntz, enabled int, notify_email_operator_id int, category_id int""",
    "job_categories": f"{_KEY}, category_id int, name string",
    "logins": f"{_KEY}, sid string, name string, sysadmin int, securityadmin int, denylogin int",
    "index_physical_stats": f"""{_DATABASE}, object_id int, index_id int,
        avg_fragmentation_in_percent double, page_count bigint""",
    "tables": f"{_DATABASE}, object_id int, name string",
    "sysindexes": f"{_DATABASE}, name string, rowcnt bigint, object_id int, index_id int",
    "stats": f"""{_DATABASE}, object_id int, stats_id int, name string, no_recompute int,
        auto_created int""",
    "stats_properties": f"""{_DATABASE}, object_id int, stats_id int,
        modification_counter bigint, rows bigint, rows_sampled bigint,
        last_updated timestamp_ntz""",
}

# Columns besides the day that name folders of the store, for tables mostly asked for by them.
STORED_BY = {"backupset": ["type"]}

# Older servers give some figures in another unit and name: (old column, its size in the new unit).
_OLD_UNITS = {"sys_info": {"physical_memory_kb": ("physical_memory_in_bytes", 1024)}}


def align(df: DataFrame, table: str) -> DataFrame:
    """Bring a collector's rows to the schema of ``table``.

    Columns an older server lacks become NULL, figures in an older unit are converted, every
    column gets its type, and names lose the blanks at their end: servers pad them, and names that
    differ only by that are the same name there.
    """
    old_units = _OLD_UNITS.get(table, {})
    aligned: list[Column] = []
    for field in StructType.fromDDL(SNAPSHOTS[table]).fields:
        if field.name in df.columns:
            value = F.col(field.name)
        elif field.name in old_units and old_units[field.name][0] in df.columns:
            old, size = old_units[field.name]
            value = whole_div(F.col(old).cast("bigint"), size)
        else:
            value = F.lit(None)
        value = value.cast(field.dataType)
        if isinstance(field.dataType, StringType):
            value = F.rtrim(value)
        aligned.append(value.alias(field.name))
    return df.select(*aligned)


def write_snapshots(df: DataFrame, root: str, table: str, mode: str = "append") -> None:
    """Add a collector's rows to the store, aligned, in folders by day (and ``STORED_BY``).

    Rows are dealt by folder first, so a folder gets few files; Spark cuts a folder with very many
    rows into several of even size. A folder cannot be named by an empty text: it is read as NULL.
    """
    day = F.to_date("snapshot_ts").alias("snapshot_date")
    folders = ["snapshot_date", *STORED_BY.get(table, [])]
    dealt = align(df, table).select("*", day).hint("rebalance", *map(F.col, folders))
    dealt.write.mode(mode).partitionBy(*folders).parquet(f"{root}/{table}")


def read_snapshots(
    spark: SparkSession,
    root: str,
    table: str,
    *,
    days: tuple[str, str] | None = None,
    days_of: DataFrame | None = None,
    servers: Sequence[str] = (),
    where: Column | None = None,
) -> DataFrame:
    """One snapshot table from parquet, aligned; ``days`` (first, last) prunes folders by
    ``snapshot_date``.

    ``days_of`` is a table with a column ``snapshot_date``: only its days are read, and where it is
    filtered, Spark finds the folders when the query runs. ``where`` is a filter on stored columns;
    one on a folder's column prunes too.
    """
    df = spark.read.option("mergeSchema", "true").parquet(f"{root}/{table}")
    if days is not None:
        first, last = days
        df = df.where(F.col("snapshot_date").between(F.to_date(F.lit(first)), F.to_date(F.lit(last))))
    if days_of is not None:
        df = df.join(days_of.select("snapshot_date").distinct(), "snapshot_date", "left_semi")
    if where is not None:
        df = df.where(where)
    if servers:
        df = df.where(F.col("server_name").isin(*servers))
    return align(df, table)
