"""Every report on tables derived from the driver's, with the same question as DuckDB SQL.

The SQL says each report the plain way (self-joins, correlated subqueries, window functions) over
the same derived tables; it shares no code with the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import reports as r
from .constants import IDLE_WAITS
from .derived import derived_tables, with_clause
from .reports import Report, ReportOptions

KEY = "server_name, snapshot_ts"
ON_KEY = "{0}.server_name = {1}.server_name and {0}.snapshot_ts = {1}.snapshot_ts"
IDLE = ", ".join(f"'{wait}'" for wait in IDLE_WAITS)


def rounded(a: str, b: str, places: int, precision: int = 18) -> str:
    """``a / b`` rounded half up, in whole numbers; NULL unless ``b`` is positive."""
    b = f"cast({b} as hugeint)"
    return (
        f"case when ({b}) > 0 then cast(cast((2 * cast({a} as hugeint) * {10**places} + ({b})) "
        f"// (2 * ({b})) as decimal(20,0)) * {1 / 10**places:.{places}f} "
        f"as decimal({precision},{places})) end"
    )


def early(a: str, b: str) -> str:
    b = f"cast({b} as hugeint)"
    return (
        f"case when ({b}) > 0 then cast((2 * cast({a} as hugeint) * 100 + ({b})) "
        f"// (2 * ({b})) as decimal(18,2)) end"
    )


def on(left: str, right: str, *more: str) -> str:
    return " and ".join([ON_KEY.format(left, right), *[f"{left}.{c} = {right}.{c}" for c in more]])


STYLE_100 = """strftime(checked, '%b ') || lpad(cast(day(checked) as varchar), 2, ' ')
    || strftime(checked, ' %Y ') || lpad(ltrim(strftime(checked, '%I'), '0'), 2, ' ')
    || strftime(checked, ':%M%p')"""

DATABASE = f"{KEY}, database_name"

REPORTS: dict[str, tuple[Report, ReportOptions, str]] = {}


def add(report: Report, sql: str, **options: object) -> None:
    REPORTS[f"report_{report.__name__}"] = (report, ReportOptions(**options), sql)


add(r.product_versions, "select * from product_history")
add(r.server_properties, "select * from server_properties")
add(
    r.database_settings,
    f"""select d.*, {rounded('ls.cntr_value', '1024', 2)} as log_size_mb,
        {rounded('lu.cntr_value', '1024', 2)} as log_used_mb,
        {early('lu.cntr_value', 'ls.cntr_value')} as log_used_percent
    from databases d
    join performance_counters lu on {on('d', 'lu')} and d.name = lu.instance_name
    join performance_counters ls on {on('d', 'ls')} and d.name = ls.instance_name
    where lu.counter_name like 'Log File(s) Used Size (KB)%'
      and ls.counter_name like 'Log File(s) Size (KB)%' and ls.cntr_value > 0""",
)
add(
    r.connections,
    f"""select {KEY}, login_name, program_name, count(session_id) as session_count
    from sessions group by all""",
)
add(r.trace_flags, "select * from trace_flags")
add(r.windows_information, "select * from windows_info")
add(r.services, "select * from services")
add(r.numa_nodes, "select * from nodes where node_state_desc <> 'ONLINE DAC'")
add(
    r.hardware,
    f"""select {KEY}, cpu_count as logical_cpu_count, scheduler_count, hyperthread_ratio,
        cast(cpu_count // nullif(hyperthread_ratio, 0) as bigint) as physical_cpu_count,
        physical_memory_kb // 1024 as physical_memory_mb, max_workers_count,
        affinity_type_desc as affinity_type, sqlserver_start_time as server_start_time,
        virtual_machine_type_desc as virtual_machine_type
    from sys_info""",
)
add(
    r.manufacturer,
    f"""select * from (
        select {KEY}, unnest(string_split(text, chr(10))) as line from error_log)
    where lower(line) like '%the of%'""",
    log_term="The Of",
)
add(
    r.file_paths,
    f"""select m.server_name, m.snapshot_ts, d.name as database_name, file_id, m.name,
        physical_name, type_desc, m.state_desc, is_percent_growth, growth,
        growth // 128 as growth_mb, size // 128 as size_mb
    from master_files m left join databases d on {on('m', 'd', 'database_id')}
    where m.database_id > 4 and m.database_id <> 32767 or m.database_id = 2""",
)
add(
    r.integrity_checks,
    f"""select {DATABASE}, case when checked = timestamp '1900-01-01 00:00:00'
            then 'Never ran DBCC CHECKDB' else {STYLE_100} end as last_clean_check
    from (select distinct {DATABASE}, cast(Value as timestamp) as checked
          from dbinfo where Field = 'dbi_dbccLastKnownGood')""",
)
add(
    r.waits_between_snapshots,
    "select *, "
    + ", ".join(
        f"""case when {c} < lag({c}) over w then {c} else {c} - lag({c}) over w end as {c}_delta"""
        for c in ("waiting_tasks_count", "wait_time_ms", "signal_wait_time_ms")
    )
    + " from wait_stats window w as (partition by server_name, wait_type order by snapshot_ts)",
)
add(
    r.wait_statistics,
    f"""select {KEY}, wait_type, {rounded('w', '1000', 2, 16)} as wait_sec,
        {rounded('w - s', '1000', 2, 16)} as resource_sec,
        {rounded('s', '1000', 2, 16)} as signal_sec, n as wait_count,
        {rounded('w * 100', 'total', 2, 5)} as wait_percentage,
        {rounded('w', 'n * 1000', 4, 16)} as avg_wait_sec,
        {rounded('w - s', 'n * 1000', 4, 16)} as avg_resource_sec,
        {rounded('s', 'n * 1000', 4, 16)} as avg_signal_sec
    from (
        select {KEY}, wait_type, cast(wait_time_ms as hugeint) as w,
               cast(signal_wait_time_ms as hugeint) as s, waiting_tasks_count as n,
               sum(wait_time_ms) over (partition by {KEY}) as total,
               coalesce(sum(wait_time_ms) over (
                   partition by {KEY} order by wait_time_ms desc, wait_type
                   rows between unbounded preceding and 1 preceding), 0) as earlier
        from wait_stats
        where wait_type not in ({IDLE}) and waiting_tasks_count > 0)
    where earlier * 100 < total * 99""",
)
NEWEST_FULL = f"""(
    select * from backupset where type = 'D'
    qualify row_number() over (partition by {DATABASE}
                               order by backup_finish_date desc, backup_set_id desc) = 1)"""
add(
    r.last_full_backup,
    f"""select b.server_name, b.snapshot_ts, database_name, backup_finish_date as backup_date,
        physical_device_name, logical_device_name
    from {NEWEST_FULL} b join backupmediafamily m on {on('b', 'm', 'media_set_id')}""",
)
add(
    r.last_log_backups,
    f"""select b.server_name, b.snapshot_ts, database_name, backup_finish_date as backup_date,
        physical_device_name, logical_device_name
    from backupset b join backupmediafamily m on {on('b', 'm', 'media_set_id')}
    where type = 'L'
    qualify row_number() over (
        partition by b.server_name, b.snapshot_ts, database_name
        order by backup_finish_date desc, backup_set_id desc, physical_device_name,
                 logical_device_name) <= 5""",
)
add(
    r.backup_throughput,
    f"""select {KEY}, cast(year(backup_finish_date) as integer) as year,
        cast(month(backup_finish_date) as integer) as month,
        cast((sum(rate) // count(rate)) // 1000000000 as bigint) as rate_avg,
        cast(min(rate) // 1000000000 as bigint) as rate_min,
        cast(max(rate) // 1000000000 as bigint) as rate_max
    from (
        select *, cast(backup_size as hugeint) * 1000000000
               // (date_diff('second', backup_start_date, backup_finish_date) * 1048576) as rate
        from backupset
        where type = 'D' and backup_size > 5368709120
          and date_diff('second', backup_start_date, backup_finish_date) > 1)
    group by all""",
)
add(
    r.file_growth,
    f"""select b.server_name, b.snapshot_ts, database_name, logical_name, physical_name,
        backup_finish_date, cast(f.file_size as bigint) // 1048576 as file_size_mb,
        cast(f.backup_size as bigint) // 1048576 as consumed_size_mb
    from backupset b join backupfile f on {on('b', 'f', 'backup_set_id')} where type = 'D'""",
)
add(
    r.backup_sizes,
    f"""select b.server_name, b.snapshot_ts, database_name, backup_finish_date,
        backup_size as uncompressed_size
    from {NEWEST_FULL} b join backupmediafamily m on {on('b', 'm', 'media_set_id')}""",
)
add(
    r.log_segments,
    f"""select d.server_name, d.snapshot_ts, d.name as database_name,
        count(v.database_name) as segment_count
    from databases d left join vlf_info v on {on('d', 'v')} and d.name = v.database_name
    group by all""",
)
add(
    r.volumes,
    f"""select distinct v.server_name, v.snapshot_ts, volume_mount_point, file_system_type,
        logical_volume_name, {rounded('total_bytes', '1073741824', 2)} as total_gb,
        {rounded('available_bytes', '1073741824', 2)} as available_gb,
        {early('available_bytes', 'total_bytes')} as free_percent
    from master_files f join volume_stats v on {on('f', 'v', 'database_id', 'file_id')}""",
)
add(
    r.io_by_database,
    f"""select i.server_name, i.snapshot_ts,
        row_number() over (partition by i.server_name, i.snapshot_ts
                           order by mb desc, i.database_id) as io_rank,
        d.name as database_name, cast(mb as decimal(12,2)) as total_io_mb,
        {rounded('mb * 100', 'sum(mb) over (partition by i.server_name, i.snapshot_ts)', 2, 5)}
            as io_percent
    from (
        select {KEY}, database_id,
               sum(num_of_bytes_read + num_of_bytes_written) // 1048576 as mb
        from file_stats group by all) i
    left join databases d on {on('i', 'd', 'database_id')}""",
)
add(
    r.file_stalls,
    f"""select s.server_name, s.snapshot_ts, d.name as database_name, physical_name,
        io_stall_read_ms, num_of_reads,
        {rounded('io_stall_read_ms', '1 + num_of_reads', 1)} as avg_read_stall_ms,
        io_stall_write_ms, num_of_writes,
        {rounded('io_stall_write_ms', '1 + num_of_writes', 1)} as avg_write_stall_ms,
        io_stall_read_ms + io_stall_write_ms as io_stalls,
        num_of_reads + num_of_writes as total_io,
        {rounded('io_stall_read_ms + io_stall_write_ms', '1 + num_of_reads + num_of_writes', 1)}
            as avg_io_stall_ms
    from file_stats s
    join master_files f on {on('s', 'f', 'database_id', 'file_id')}
    left join databases d on {on('s', 'd', 'database_id')}""",
)
add(
    r.missing_indexes,
    f"""select s.server_name, s.snapshot_ts,
        user_seeks * avg_total_user_cost * (avg_user_impact * 0.01::double) as index_advantage,
        last_user_seek, d.name as database_name, statement, equality_columns,
        inequality_columns, included_columns, unique_compiles, user_seeks, avg_total_user_cost,
        avg_user_impact
    from missing_index_group_stats s
    join missing_index_groups g on {on('s', 'g')} and s.group_handle = g.index_group_handle
    join missing_index_details i on {on('g', 'i', 'index_handle')}
    left join databases d on {on('i', 'd', 'database_id')}""",
)
add(
    r.autogrowth_events,
    f"""select t.server_name, t.snapshot_ts, StartTime, e.name as event_name,
        d.name as database_name, Filename, IntegerData * 8 / 1024.0::double as growth_mb,
        duration // 1000 as dur_ms
    from trace_rows t
    join trace_events e on {on('t', 'e')} and t.EventClass = e.trace_event_id
    left join databases d on {on('t', 'd')} and t.databaseid = d.database_id
    where EventClass = 92 or EventClass = 93""",
)
add(
    r.cpu_history,
    f"""select r.server_name, r.snapshot_ts,
        cast(nullif(regexp_extract(record, '<ProcessUtilization>(\\d+)<', 1), '') as integer) as sql_cpu,
        cast(nullif(regexp_extract(record, '<SystemIdle>(\\d+)<', 1), '') as integer) as idle,
        100 - idle - sql_cpu as other_cpu,
        r.snapshot_ts - to_milliseconds(cpu_ticks // (cpu_ticks // ms_ticks) - r.timestamp)
            as event_time
    from ring_buffers r join sys_info i on {on('r', 'i')}
    where ring_buffer_type = 'RING_BUFFER_SCHEDULER_MONITOR' and record like '%<SystemHealth>%'
    qualify row_number() over (
        partition by r.server_name, r.snapshot_ts
        order by cast(regexp_extract(record, 'id="(\\d+)"', 1) as integer) desc) <= 256""",
)
add(
    r.signal_waits,
    f"""select {KEY},
        {rounded('sum(signal_wait_time_ms) * 100', 'sum(wait_time_ms)', 2, 20)} as signal_percent,
        {rounded('sum(wait_time_ms - signal_wait_time_ms) * 100', 'sum(wait_time_ms)', 2, 20)}
            as resource_percent
    from wait_stats where wait_type not in ({IDLE}) group by {KEY}""",
)
add(
    r.cpu_by_database,
    f"""select c.server_name, c.snapshot_ts,
        row_number() over (partition by c.server_name, c.snapshot_ts
                           order by t desc, c.database_id) as cpu_rank,
        d.name as database_name, cast(t as bigint) as cpu_time,
        {rounded('t * 100', 'sum(t) over (partition by c.server_name, c.snapshot_ts)', 2, 5)}
            as cpu_percent
    from (
        select q.server_name, q.snapshot_ts, cast(a.value as integer) as database_id,
               sum(total_worker_time) as t
        from query_stats q
        join plan_attributes a on {on('q', 'a', 'plan_handle')} and a.attribute = 'dbid'
        group by all) c
    left join databases d on {on('c', 'd', 'database_id')}
    where c.database_id <> 32767""",
)
add(
    r.page_life_expectancy,
    f"""select {KEY}, object_name, cntr_value as page_life_expectancy from performance_counters
    where object_name like '%Buffer Manager%' and counter_name = 'Page life expectancy'""",
)
add(
    r.memory_grants_pending,
    f"""select {KEY}, object_name, cntr_value as memory_grants_pending,
        cast(row_number() over (partition by server_name
            order by snapshot_ts, object_name, cntr_value) as integer) as sample
    from performance_counters
    where object_name like '%Memory Manager%' and counter_name = 'Memory Grants Pending'
    qualify sample <= 16""",
)
add(
    r.buffer_by_database,
    f"""select b.server_name, b.snapshot_ts, d.name as database_name,
        count(*) * 8 / 1024.0::double as cached_size_mb
    from buffer_descriptors b left join databases d on {on('b', 'd', 'database_id')}
    where b.database_id > 4 and b.database_id <> 32767
    group by b.server_name, b.snapshot_ts, b.database_id, d.name""",
)
add(
    r.buffer_by_object,
    f"""select server_name, snapshot_ts, database_name, table_name, index_name, index_type,
        count(*) as cached_pages
    from (
        select b.server_name, b.snapshot_ts, u.database_name, o.name as table_name, u.index_id,
               i.name as index_name, i.type_desc as index_type
        from buffer_descriptors b
        join databases d on {on('b', 'd', 'database_id')}
        join (
            select a.*, object_id, index_id from allocation_units a join partitions p
            on {on('a', 'p', 'database_name')} and a.container_id = p.hobt_id
               and (a.type = 1 or a.type = 3)
            union all
            select a.*, object_id, index_id from allocation_units a join partitions p
            on {on('a', 'p', 'database_name')} and a.container_id = p.partition_id and a.type = 2) u
        on {on('b', 'u', 'allocation_unit_id')} and u.database_name = d.name
        left join objects o on {on('u', 'o', 'database_name', 'object_id')}
        left join indexes i on {on('u', 'i', 'database_name', 'object_id', 'index_id')})
    group by server_name, snapshot_ts, database_name, table_name, index_id, index_name, index_type
    union all
    select b.server_name, b.snapshot_ts, null, null, null, null, count(*)
    from buffer_descriptors b left join databases d on {on('b', 'd', 'database_id')}
    where d.database_id is null group by b.server_name, b.snapshot_ts""",
)
add(
    r.os_memory,
    f"""select {KEY}, total_physical_memory_kb // 1024 as total_physical_memory_mb,
        available_physical_memory_kb // 1024 as available_physical_memory_mb,
        total_page_file_kb // 1024 as total_page_file_mb,
        available_page_file_kb // 1024 as available_page_file_mb,
        system_cache_kb // 1024 as system_cache_mb,
        system_memory_state_desc as system_memory_state
    from sys_memory""",
)
add(r.process_memory, "select * from process_memory")
add(
    r.memory_over_physical,
    f"""select m.server_name, m.snapshot_ts, c.minimum as min_memory_mb,
        c.value_in_use as max_memory_mb, total_physical_memory_kb // 1024 as server_memory_mb
    from sys_memory m join configurations c on {on('m', 'c')} and c.name = 'max server memory (MB)'
    where total_physical_memory_kb < c.value_in_use * 1024""",
)
add(
    r.agent_jobs,
    f"""select j.server_name, j.snapshot_ts, j.name as job_name,
        substring(j.description, 1, 87) as job_description, l.name as job_owner, date_created,
        enabled, notify_email_operator_id, c.name as category_name
    from jobs j join job_categories c on {on('j', 'c', 'category_id')}
    left join logins l on {on('j', 'l')} and l.sid = j.owner_sid""",
)
add(
    r.sysadmins,
    f"""select {KEY}, 'Sysadmins' as label, 'Login: [' || rtrim(name) || ']' as details
    from logins where sysadmin = 1 and name <> 'sa' and denylogin = 0""",
)
add(
    r.security_admins,
    f"""select {KEY}, 'Security Admin' as label, rtrim(name) as login
    from logins where securityadmin = 1 and name <> 'sa' and denylogin = 0""",
)
add(
    r.index_fragmentation,
    f"""select p.server_name, p.snapshot_ts, p.database_name, t.name as table_name,
        i.name as index_name, s.rowcnt, avg_fragmentation_in_percent
    from index_physical_stats p
    join indexes i on {on('p', 'i', 'database_name', 'object_id', 'index_id')}
    join tables t on {on('p', 't', 'database_name', 'object_id')}
    join sysindexes s on {on('i', 's', 'database_name', 'object_id', 'index_id')}
    where i.name is not null and page_count > 5000""",
)
add(
    r.statistics_dates,
    f"""select i.server_name, i.snapshot_ts, i.database_name, t.name as table_name,
        i.name as index_name,
        (select max(last_updated) from stats_properties s
         where {on('s', 'i', 'database_name', 'object_id')} and s.stats_id = i.index_id)
            as stats_updated
    from indexes i join tables t on {on('i', 't', 'database_name', 'object_id')}""",
)
add(
    r.volatile_statistics,
    f"""select p.server_name, p.snapshot_ts, p.database_name, o.name as object_name, p.object_id,
        o.type_desc, s.name as statistics_name, p.stats_id, no_recompute, auto_created,
        modification_counter, p.rows, rows_sampled, last_updated
    from stats_properties p
    join stats s on {on('p', 's', 'database_name', 'object_id', 'stats_id')}
    join objects o on {on('p', 'o', 'database_name', 'object_id')}
    where modification_counter > 0
    qualify row_number() over (
        partition by p.server_name, p.snapshot_ts, p.database_name
        order by modification_counter desc, o.name, p.object_id, p.stats_id) <= 50""",
)


def _query(report: Report, options: ReportOptions) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return report(derived_tables(spark, folder), options)

    run.__doc__ = report.__doc__
    return run


QUERIES = {name: _query(report, options) for name, (report, options, _) in REPORTS.items()}
ORACLE = {name: with_clause(sql) for name, (_, _, sql) in REPORTS.items()}
