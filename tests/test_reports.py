"""Every report on hand-made snapshots, with the rows that go wrong most easily."""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from fleetvitals.plans import derived
from fleetvitals.plans import reports as r
from fleetvitals.plans.constants import IDLE_WAITS
from fleetvitals.plans.reports import ReportOptions
from tests.conftest import T0, cells


def shown_sorted(**chosen) -> ReportOptions:
    return ReportOptions(sorted=True, **chosen)


ALL = shown_sorted()
SALES = shown_sorted(database="sales")



def D(text):
    return Decimal(text)


@pytest.fixture(scope="session")
def names(snapshot):
    """Databases 1 to 16; 5 is sales, 6 is hr, the others are db<n>."""
    known = {5: "sales", 6: "hr"}
    return snapshot(
        "databases", *[{"database_id": i, "name": known.get(i, f"db{i}")} for i in range(1, 17)]
    )


def test_product_versions_by_date(snapshot):
    t = {"product_history": snapshot(
        "product_history",
        {"product_version": "2", "mod_time": datetime(2024, 2, 1)},
        {"product_version": "1", "mod_time": datetime(2024, 1, 1)},
    )}
    assert cells(r.product_versions(t, ALL), "product_version") == ["1", "2"]


def test_plain_listings_keep_all_columns(snapshot):
    t = {
        "server_properties": snapshot("server_properties", {"edition": "Enterprise"}),
        "trace_flags": snapshot("trace_flags", {"flag": 3604, "global": 1}, {"flag": 1118, "global": 1}),
        "windows_info": snapshot("windows_info", {"windows_release": "6.3", "windows_sku": 4}),
        "services": snapshot("services", {"servicename": "Engine", "process_id": 77}),
        "process_memory": snapshot("process_memory", {"page_fault_count": 3}),
    }
    found = r.server_properties(t, ALL).first()
    assert found.edition == "Enterprise" and found.is_hadr_enabled is None
    assert cells(r.trace_flags(t, ALL), "flag") == [1118, 3604]
    assert cells(r.windows_information(t, ALL), "windows_release", "windows_sku") == [("6.3", 4)]
    assert cells(r.services(t, ALL), "servicename", "process_id") == [("Engine", 77)]
    assert cells(r.process_memory(t, ALL), "page_fault_count") == [3]


def test_database_settings(snapshot):
    used, size = "Log File(s) Used Size (KB)", "Log File(s) Size (KB)"

    def counter(name, instance, value):
        return {"counter_name": name, "instance_name": instance, "cntr_value": value}

    t = {
        "databases": snapshot(
            "databases",
            *[{"name": n, "recovery_model_desc": "FULL"} for n in ("a", "b", "c", "empty")],
        ),
        "performance_counters": snapshot(
            "performance_counters",
            counter(used + "   ", "a", 3), counter(size, "a", 7),
            counter(used, "b", 1024), counter(size, "b", 2048),
            counter(used, "empty", 5), counter(size, "empty", 0),
            counter(used, "_Total", 5), counter(size, "_Total", 10),
            counter("Other", "c", 1),
        ),
    }
    found = r.database_settings(t, ALL)
    assert cells(found, "name", "log_size_mb", "log_used_mb", "log_used_percent") == [
        ("a", D("0.01"), D("0.00"), D("43.00")),
        ("b", D("2.00"), D("1.00"), D("50.00")),
    ]
    assert "target_recovery_time_in_seconds" in found.columns


def test_connections_count_known_sessions(snapshot):
    t = {"sessions": snapshot(
        "sessions",
        {"login_name": "x", "program_name": "p", "session_id": 1},
        {"login_name": "x", "program_name": "q", "session_id": 2},
        {"login_name": "x", "program_name": "q", "session_id": 3},
        {"login_name": "y", "program_name": "p", "session_id": None},
    )}
    assert cells(r.connections(t, ALL), "login_name", "program_name", "session_count") == [
        ("x", "q", 2), ("x", "p", 1), ("y", "p", 0),
    ]


def test_numa_nodes_leave_the_admin_connection_out(snapshot):
    t = {"nodes": snapshot(
        "nodes",
        {"node_id": 64, "node_state_desc": "ONLINE DAC"},
        {"node_id": 0, "node_state_desc": "ONLINE"},
        {"node_id": 1, "node_state_desc": None},
    )}
    assert cells(r.numa_nodes(t, ALL), "node_id") == [0]


def test_hardware_units(snapshot):
    t = {"sys_info": snapshot(
        "sys_info", {"cpu_count": 7, "hyperthread_ratio": 2, "physical_memory_kb": 2047}
    )}
    assert cells(r.hardware(t, ALL), "physical_cpu_count", "physical_memory_mb") == [(3, 1)]


def test_manufacturer(snapshot):
    t = {"error_log": snapshot("error_log", {"text": "System Manufacturer: 'X'"}, {"text": "other"})}
    assert cells(r.manufacturer(t, ALL), "line") == ["System Manufacturer: 'X'"]


def test_file_paths_choose_user_databases_and_the_temporary_one(snapshot, names):
    t = {"databases": names, "master_files": snapshot(
        "master_files",
        *[{"database_id": i, "file_id": 1, "growth": 10, "is_percent_growth": 1, "size": 1025}
          for i in (1, 2, 4, 5, 32767)],
    )}
    assert cells(r.file_paths(t, ALL), "database_name", "growth_mb", "size_mb") == [
        ("db2", 0, 8), ("sales", 0, 8),
    ]


def test_integrity_checks(snapshot):
    def info(name, field, value):
        return {"database_name": name, "Field": field, "Value": value}

    field = "dbi_dbccLastKnownGood"
    t = {"dbinfo": snapshot(
        "dbinfo",
        info("b", field, "2014-11-08 13:05:00.000"), info("b", field, "2014-11-08 13:05:00.000"),
        info("a", field, "1900-01-01 00:00:00.000"),
        info("c", field, "2014-09-30 01:05:00.000"),
        info("c", "dbi_version", "706"),
    )}
    assert cells(r.integrity_checks(t, ALL), "database_name", "last_clean_check") == [
        ("a", "Never ran DBCC CHECKDB"),
        ("c", "Sep 30 2014  1:05AM"),
        ("b", "Nov  8 2014  1:05PM"),
    ]
    assert cells(r.integrity_checks(t, shown_sorted(database="b")), "database_name") == ["b"]


def wait(name, total, signal=0, tasks=1, **more):
    return {
        "wait_type": name, "wait_time_ms": total, "signal_wait_time_ms": signal,
        "waiting_tasks_count": tasks, **more,
    }


def test_waits_between_snapshots(snapshot):
    later = T0 + timedelta(seconds=10)
    t = {"wait_stats": snapshot(
        "wait_stats",
        wait("A", 100, 10, 1), wait("A", 150, 15, 3, snapshot_ts=later),
        wait("B", 900, 90, 9), wait("B", 30, 3, 2, snapshot_ts=later),
        wait("ONCE", 5, snapshot_ts=later),
    )}
    found = r.waits_between_snapshots(t, ALL).where("snapshot_ts > timestamp_ntz'2024-05-01 12:00:00'")
    assert sorted(cells(
        found, "wait_type", "wait_time_ms_delta", "signal_wait_time_ms_delta",
        "waiting_tasks_count_delta",
    )) == [("A", 50, 5, 2), ("B", 30, 3, 2), ("ONCE", None, None, None)]


def test_wait_statistics(snapshot):
    t = {"wait_stats": snapshot(
        "wait_stats",
        wait("BIG", 6001, 1000, 3), wait("TIE2", 1999, 0, 1), wait("TIE1", 1999, 0, 1),
        wait("SMALL", 1, 0, 1), wait("IDLE0", 99999, 0, 0), wait(IDLE_WAITS[0], 99999, 0, 5),
        wait("ALONE", 1000, 0, 1, server_name="srv2"), wait("REST", 9, 0, 1, server_name="srv2"),
        wait("Z", 0, 0, 1, server_name="srv3"),
    )}
    found = r.wait_statistics(t, ALL)
    columns = ["server_name", "wait_type", "wait_sec", "resource_sec", "signal_sec", "wait_count",
               "wait_percentage", "avg_wait_sec", "avg_resource_sec", "avg_signal_sec"]
    assert cells(found, *columns) == [
        ("srv1", "BIG", D("6.00"), D("5.00"), D("1.00"), 3, D("60.01"), D("2.0003"), D("1.6670"), D("0.3333")),
        ("srv1", "TIE1", D("2.00"), D("2.00"), D("0.00"), 1, D("19.99"), D("1.9990"), D("1.9990"), D("0.0000")),
        ("srv1", "TIE2", D("2.00"), D("2.00"), D("0.00"), 1, D("19.99"), D("1.9990"), D("1.9990"), D("0.0000")),
        ("srv2", "ALONE", D("1.00"), D("1.00"), D("0.00"), 1, D("99.11"), D("1.0000"), D("1.0000"), D("0.0000")),
    ]


@pytest.fixture(scope="session")
def backups(snapshot):
    def at(day, hour=0):
        return datetime(2024, 4, day, hour)

    def one(number, kind, finish, database="sales", size=100, secs=10):
        return {
            "backup_set_id": number, "media_set_id": number * 10, "database_name": database,
            "type": kind, "backup_finish_date": finish, "backup_size": D(size),
            "backup_start_date": finish - timedelta(seconds=secs) if finish else at(1),
        }

    return {
        "backupset": snapshot(
            "backupset",
            one(1, "D", at(1)), one(2, "D", at(2)), one(3, "D", at(2), size=777),
            one(4, "L", at(3)), one(5, "L", at(4)), one(6, "L", at(5)), one(7, "L", at(6)),
            one(8, "D", at(1), "hr", 5), one(9, "L", at(9), "hr"),
        ),
        "backupmediafamily": snapshot(
            "backupmediafamily",
            *[{"media_set_id": n * 10, "physical_device_name": f"disk{n}"} for n in range(1, 10)],
            {"media_set_id": 30, "physical_device_name": "copy3"},
            {"media_set_id": 70, "physical_device_name": "copy7"},
            {"media_set_id": 60, "physical_device_name": "copy6"},
        ),
        "backupfile": snapshot(
            "backupfile",
            {"backup_set_id": 1, "file_size": D(3145727), "backup_size": D(1048576), "logical_name": "f"},
            {"backup_set_id": 3, "file_size": D(3145728), "backup_size": D(1048575), "logical_name": "f"},
            {"backup_set_id": 3, "file_size": D(0), "backup_size": D(0), "logical_name": "e"},
            {"backup_set_id": 4, "file_size": D(0), "backup_size": D(0), "logical_name": "log"},
        ),
    }


def test_last_full_backup_keeps_all_media_of_the_newest(backups):
    found = r.last_full_backup(backups, SALES)
    assert cells(found, "database_name", "backup_date", "physical_device_name") == [
        ("sales", datetime(2024, 4, 2), "copy3"), ("sales", datetime(2024, 4, 2), "disk3"),
    ]
    assert cells(r.last_full_backup(backups, ALL), "database_name") == ["hr", "sales", "sales"]


def test_last_log_backups_count_media_rows(backups):
    found = r.last_log_backups(backups, SALES)
    assert cells(found, "physical_device_name") == ["copy7", "disk7", "copy6", "disk6", "disk5"]
    assert cells(r.last_log_backups(backups, shown_sorted(database="hr")), "physical_device_name") == ["disk9"]


def test_backup_sizes(backups):
    assert cells(r.backup_sizes(backups, SALES), "uncompressed_size") == [D(777), D(777)]


def test_file_growth(backups):
    found = r.file_growth(backups, SALES)
    assert cells(found, "logical_name", "file_size_mb", "consumed_size_mb", "backup_finish_date") == [
        ("e", 0, 0, datetime(2024, 4, 2)), ("f", 3, 0, datetime(2024, 4, 2)),
        ("f", 2, 1, datetime(2024, 4, 1)),
    ]


def test_backup_throughput(snapshot):
    mb, large = 1048576, 5368709120

    def one(size, secs, finish=datetime(2024, 4, 2), kind="D"):
        return {"type": kind, "backup_size": D(size), "backup_finish_date": finish,
                "backup_start_date": datetime(2024, 4, 2) - timedelta(seconds=secs)}

    t = {"backupset": snapshot(
        "backupset",
        one(large, 10), one(6000 * mb, 1), one(6000 * mb, 2), one(6000 * mb, 7),
        one(6000 * mb, 10, finish=None), one(9000 * mb, 10, kind="L"),
    )}
    found = r.backup_throughput(t, ALL)
    # 3000 and 857.14: the mean of the rates, not total by total
    assert cells(found, "year", "month", "rate_avg", "rate_min", "rate_max") == [
        (2024, 4, 1928, 857, 3000)
    ]


def test_log_segments_show_zero(snapshot, names):
    t = {"databases": names, "vlf_info": snapshot(
        "vlf_info", {"database_name": "sales"}, {"database_name": "sales"}, {"database_name": "hr"}
    )}
    found = cells(r.log_segments(t, ALL), "database_name", "segment_count")
    assert found[:3] == [("sales", 2), ("hr", 1), ("db1", 0)] and len(found) == 16


def test_volumes_once_each(snapshot):
    def volume(file, mount="C:"):
        return {"database_id": 1, "file_id": file, "volume_mount_point": mount,
                "total_bytes": 7 * 2**30, "available_bytes": 3 * 2**30}

    t = {
        "master_files": snapshot("master_files", *[{"database_id": 1, "file_id": f} for f in (1, 2, 3)]),
        "volume_stats": snapshot("volume_stats", volume(1), volume(2), volume(9, "D:")),
    }
    assert cells(r.volumes(t, ALL), "volume_mount_point", "total_gb", "available_gb", "free_percent") == [
        ("C:", D("7.00"), D("3.00"), D("43.00"))
    ]


def test_io_by_database_ranks_as_numbers(snapshot, names):
    t = {"databases": names, "file_stats": snapshot(
        "file_stats",
        *[{"database_id": i, "file_id": f, "num_of_bytes_read": i * 2**20, "num_of_bytes_written": 2**19}
          for i in range(1, 12) for f in (1, 2)],
    )}
    found = cells(r.io_by_database(t, ALL), "io_rank", "database_name", "total_io_mb", "io_percent")
    assert [f[0] for f in found] == list(range(1, 12))
    assert found[0] == (1, "db11", D("23.00"), D("16.08"))
    assert found[9] == (10, "db2", D("5.00"), D("3.50"))


def test_file_stalls_with_no_operations(snapshot, names):
    t = {
        "databases": names,
        "file_stats": snapshot(
            "file_stats",
            {"database_id": 5, "file_id": 1, "io_stall_read_ms": 0, "num_of_reads": 0,
             "io_stall_write_ms": 0, "num_of_writes": 0},
            {"database_id": 6, "file_id": 1, "io_stall_read_ms": 10, "num_of_reads": 3,
             "io_stall_write_ms": 5, "num_of_writes": 1},
        ),
        "master_files": snapshot(
            "master_files",
            *[{"database_id": d, "file_id": f, "physical_name": f"{d}-{f}"} for d in (5, 6) for f in (1, 2)],
        ),
    }
    assert cells(
        r.file_stalls(t, ALL), "database_name", "physical_name", "avg_read_stall_ms",
        "avg_write_stall_ms", "avg_io_stall_ms", "io_stalls", "total_io",
    ) == [
        ("hr", "6-1", D("2.5"), D("2.5"), D("3.0"), 15, 4),
        ("sales", "5-1", D("0.0"), D("0.0"), D("0.0"), 0, 0),
    ]


def test_missing_indexes(snapshot, names):
    t = {
        "databases": names,
        "missing_index_group_stats": snapshot(
            "missing_index_group_stats",
            *[{"group_handle": g, "user_seeks": g, "avg_total_user_cost": 2.0, "avg_user_impact": 50.0}
              for g in (1, 2, 3, 4)],
        ),
        "missing_index_groups": snapshot(
            "missing_index_groups",
            *[{"index_group_handle": g, "index_handle": g * 10} for g in (1, 2, 3, 4)],
        ),
        "missing_index_details": snapshot(
            "missing_index_details",
            {"index_handle": 10, "database_id": 5, "statement": "t1"},
            {"index_handle": 20, "database_id": 5, "statement": "t2"},
            {"index_handle": 30, "database_id": 6, "statement": "t3"},
        ),
    }
    found = r.missing_indexes(t, SALES)
    assert cells(found, "statement", "index_advantage") == [("t2", 2.0), ("t1", 1.0)]
    assert cells(r.missing_indexes(t, ALL), "statement") == ["t3", "t2", "t1"]


def test_autogrowth(snapshot, names):
    def event(kind, database, file, minute, duration=1999):
        return {"EventClass": kind, "databaseid": database, "Filename": file, "IntegerData": 200,
                "duration": duration, "StartTime": T0 + timedelta(minutes=minute)}

    t = {
        "databases": names,
        "trace_rows": snapshot(
            "trace_rows",
            event(93, 5, "log_10.trc", 2), event(92, 5, "log_9.trc", 1), event(94, 5, "log_9.trc", 0),
            event(92, None, "log_9.trc", 0), event(92, 6, "log_9.trc", 0),
        ),
        "trace_events": snapshot(
            "trace_events",
            {"trace_event_id": 92, "name": "Data File Auto Grow"},
            {"trace_event_id": 93, "name": "Log File Auto Grow"},
        ),
    }
    found = r.autogrowth_events(t, SALES)
    assert cells(found, "event_name", "Filename", "growth_mb", "dur_ms") == [
        ("Data File Auto Grow", "log_9.trc", 1.5625, 1), ("Log File Auto Grow", "log_10.trc", 1.5625, 1),
    ]
    assert r.autogrowth_events(t, ALL).where("database_name is null").count() == 1


def test_cpu_history(snapshot):
    def record(number, health):
        return {"ring_buffer_type": "RING_BUFFER_SCHEDULER_MONITOR", "timestamp": number * 1000,
                "record": f'<Record id="{number}" type="x"><SchedulerMonitorEvent>{health}'
                          f"</SchedulerMonitorEvent></Record>"}

    def health(idle, used):
        used = "" if used is None else f"<ProcessUtilization>{used}</ProcessUtilization>"
        return f"<SystemHealth>{used}<SystemIdle>{idle}</SystemIdle></SystemHealth>"

    t = {
        "sys_info": snapshot("sys_info", {"cpu_ticks": 500000, "ms_ticks": 400000}),
        "ring_buffers": snapshot(
            "ring_buffers",
            *[record(n, health(60, 30)) for n in range(1, 257)],
            record(300, "<Other/>"), record(301, health(50, None)),
            {**record(302, health(1, 1)), "ring_buffer_type": "OTHER"},
        ),
    }
    found = cells(r.cpu_history(t, ALL), "sql_cpu", "idle", "other_cpu", "event_time")
    assert len(found) == 256
    # cpu_ticks / (cpu_ticks / ms_ticks) in whole numbers is 500000 / 1
    assert found[0] == (None, 50, None, T0 - timedelta(milliseconds=500000 - 301000))
    assert found[1] == (30, 60, 10, T0 - timedelta(milliseconds=500000 - 256000))
    assert found[-1][3] == T0 - timedelta(milliseconds=500000 - 2000)


def test_signal_waits(snapshot):
    t = {"wait_stats": snapshot(
        "wait_stats",
        wait("A", 100, 20), wait("B", 200, 25, 0), wait(IDLE_WAITS[3], 10**6, 10**6),
        wait("A", 0, 0, server_name="srv2"),
    )}
    assert cells(r.signal_waits(t, ALL), "server_name", "signal_percent", "resource_percent") == [
        ("srv1", D("15.00"), D("85.00")), ("srv2", None, None),
    ]


def test_cpu_by_database(snapshot, names):
    handles = [(f"h{i}", str(i)) for i in range(1, 12)] + [("res", "32767"), ("nul", None)]
    t = {
        "databases": names,
        "query_stats": snapshot(
            "query_stats",
            *[{"plan_handle": h, "total_worker_time": 100 * n} for n, (h, _) in enumerate(handles, 1)],
            {"plan_handle": "h1", "total_worker_time": 1}, {"plan_handle": "lost", "total_worker_time": 9},
        ),
        "plan_attributes": snapshot(
            "plan_attributes",
            *[{"plan_handle": h, "attribute": "dbid", "value": v} for h, v in handles],
            {"plan_handle": "h1", "attribute": "set_options", "value": "x"},
        ),
    }
    found = cells(r.cpu_by_database(t, ALL), "cpu_rank", "database_name", "cpu_time", "cpu_percent")
    assert [f[0] for f in found] == list(range(1, 12))
    assert found[0] == (1, "db11", 1100, D("16.66"))
    assert found[-1] == (11, "db1", 101, D("1.53"))


def test_gauges(snapshot):
    def counter(name, value, hour=0, object_name="INST$X:Memory Manager"):
        return {"object_name": object_name, "counter_name": name, "cntr_value": value,
                "snapshot_ts": T0 + timedelta(hours=hour)}

    t = {"performance_counters": snapshot(
        "performance_counters",
        counter("Page life expectancy", 500, object_name="INST$X:Buffer Manager"),
        counter("Page life expectancy", 7, object_name="INST$X:Buffer Node"),
        *[counter("Memory Grants Pending", n, n) for n in range(17)],
    )}
    assert cells(r.page_life_expectancy(t, ALL), "page_life_expectancy") == [500]
    assert cells(r.memory_grants_pending(t, ALL), "sample", "memory_grants_pending") == [
        (n + 1, n) for n in range(16)
    ]


def test_buffer_by_database(snapshot, names):
    t = {"databases": names, "buffer_descriptors": snapshot(
        "buffer_descriptors", *[{"database_id": d} for d in (1, 5, 5, 5, 6, 32767, None)]
    )}
    assert cells(r.buffer_by_database(t, ALL), "database_name", "cached_size_mb") == [
        ("sales", 3 / 128), ("hr", 1 / 128),
    ]


def test_buffer_by_object(snapshot, names):
    own = {"database_name": "sales"}
    t = {
        "databases": names,
        "buffer_descriptors": snapshot(
            "buffer_descriptors",
            *[{"database_id": 5, "allocation_unit_id": u} for u in (1, 1, 2, 3, 4, 5, 6)],
            {"database_id": 6, "allocation_unit_id": 1},
        ),
        "allocation_units": snapshot(
            "allocation_units",
            *[{**own, "allocation_unit_id": u, "container_id": c, "type": kind}
              for u, c, kind in [(1, 100, 1), (2, 200, 2), (3, 100, 3), (4, 100, 4), (5, 101, 1), (6, 102, 1)]],
        ),
        "partitions": snapshot(
            "partitions",
            *[{**own, "hobt_id": h, "partition_id": p, "object_id": o, "index_id": i}
              for h, p, o, i in [(100, 200, 1, 1), (101, 201, 1, 2), (102, 202, 2, 0)]],
        ),
        "objects": snapshot("objects", {**own, "object_id": 1, "name": "orders"}),
        "indexes": snapshot(
            "indexes",
            {**own, "object_id": 1, "index_id": 1, "name": "ix", "type_desc": "CLUSTERED"},
            {**own, "object_id": 1, "index_id": 2, "name": "ix", "type_desc": "CLUSTERED"},
        ),
    }
    found = r.buffer_by_object(t, SALES)
    # units 1 (two pages), 3 by row store; 2 by partition; 4 has no branch; two indexes of one
    # name stay two rows; unit 6 has neither index nor known table
    assert cells(found, "table_name", "index_name", "cached_pages") == [
        ("orders", "ix", 4), (None, None, 1), ("orders", "ix", 1),
    ]
    assert "index_id" not in found.columns


def test_memory_reports(snapshot):
    t = {"sys_memory": snapshot(
        "sys_memory", {"total_physical_memory_kb": 2047, "system_memory_state_desc": "high"}
    )}
    found = r.os_memory(t, ALL).first()
    assert (found.total_physical_memory_mb, found.system_cache_mb) == (1, None)


def test_memory_setting_below_equal_and_above(snapshot):
    servers = [("below", 1), ("equal", 2), ("above", 3)]
    t = {
        "sys_memory": snapshot(
            "sys_memory", *[{"server_name": s, "total_physical_memory_kb": 2048} for s, _ in servers]
        ),
        "configurations": snapshot(
            "configurations",
            *[{"server_name": s, "name": "max server memory (MB)", "minimum": 128, "value_in_use": v}
              for s, v in servers],
            {"server_name": "below", "name": "other", "value_in_use": 99},
        ),
    }
    assert cells(
        r.memory_over_physical(t, ALL), "server_name", "min_memory_mb", "max_memory_mb", "server_memory_mb"
    ) == [("above", 128, 3, 2)]


@pytest.fixture(scope="session")
def logins(snapshot):
    def login(name, sysadmin=1, securityadmin=1, denied=0):
        return {"sid": f"sid-{name.strip()}", "name": name, "sysadmin": sysadmin,
                "securityadmin": securityadmin, "denylogin": denied}

    return snapshot(
        "logins", login("sa"), login("ann  "), login("ben", 0, 1), login("cy", 1, 0),
        login("denied", denied=1), login("unknown", None, None),
    )


def test_agent_jobs(snapshot, logins):
    t = {
        "logins": logins,
        "jobs": snapshot(
            "jobs",
            {"name": "b", "description": "x" * 100, "owner_sid": "sid-ben", "category_id": 1},
            {"name": "a", "description": None, "owner_sid": "gone", "category_id": 1},
            {"name": "c", "owner_sid": "sid-ben", "category_id": 9},
        ),
        "job_categories": snapshot("job_categories", {"category_id": 1, "name": "Maintenance"}),
    }
    assert cells(r.agent_jobs(t, ALL), "job_name", "job_description", "job_owner", "category_name") == [
        ("a", None, None, "Maintenance"), ("b", "x" * 87, "ben", "Maintenance"),
    ]


def test_admins(logins):
    t = {"logins": logins}
    assert cells(r.sysadmins(t, ALL), "label", "details") == [
        ("Sysadmins", "Login: [ann]"), ("Sysadmins", "Login: [cy]"),
    ]
    assert cells(r.security_admins(t, ALL), "label", "login") == [
        ("Security Admin", "ann"), ("Security Admin", "ben"),
    ]


def test_index_fragmentation(snapshot):
    own = {"database_name": "sales"}
    keys = [(1, 1, "ix", 5001), (2, 1, "ix", 6000), (1, 2, "small", 5000), (1, 0, None, 9000)]
    t = {
        "index_physical_stats": snapshot(
            "index_physical_stats",
            *[{**own, "object_id": o, "index_id": i, "page_count": p, "avg_fragmentation_in_percent": 1.5}
              for o, i, _, p in keys],
        ),
        "indexes": snapshot("indexes", *[{**own, "object_id": o, "index_id": i, "name": n} for o, i, n, _ in keys]),
        "tables": snapshot("tables", *[{**own, "object_id": o, "name": f"t{o}"} for o in (1, 2)]),
        "sysindexes": snapshot(
            "sysindexes",
            *[{**own, "object_id": o, "index_id": i, "name": n, "rowcnt": o * 100} for o, i, n, _ in keys],
        ),
    }
    found = r.index_fragmentation(t, SALES)
    assert cells(found, "table_name", "index_name", "rowcnt") == [("t1", "ix", 100), ("t2", "ix", 200)]
    loose = r.index_fragmentation(t, shown_sorted(database="sales", strict_index_names=False))
    assert sorted(cells(loose, "table_name", "rowcnt")) == [
        ("t1", 100), ("t1", 200), ("t2", 100), ("t2", 200),
    ]


def test_statistics_dates(snapshot):
    own = {"database_name": "sales"}
    t = {
        "indexes": snapshot(
            "indexes",
            {**own, "object_id": 1, "index_id": 0}, {**own, "object_id": 1, "index_id": 1, "name": "pk"},
            {**own, "object_id": 1, "index_id": 2, "name": "ix"},
            {**own, "object_id": 9, "index_id": 1, "name": "view index"},
        ),
        "tables": snapshot("tables", {**own, "object_id": 1, "name": "orders"}),
        "stats_properties": snapshot(
            "stats_properties",
            {**own, "object_id": 1, "stats_id": 1, "last_updated": T0},
            {**own, "object_id": 1, "stats_id": 2, "last_updated": None},
        ),
    }
    assert cells(r.statistics_dates(t, SALES), "table_name", "index_name", "stats_updated") == [
        ("orders", None, None), ("orders", "ix", None), ("orders", "pk", T0),
    ]


def test_volatile_statistics(snapshot):
    own = {"database_name": "sales"}
    numbers = list(range(1, 52))
    t = {
        "stats_properties": snapshot(
            "stats_properties",
            *[{**own, "object_id": n, "stats_id": 1, "modification_counter": 7 if n < 3 else n * 10}
              for n in numbers],
            {**own, "object_id": 60, "stats_id": 1, "modification_counter": 0},
            {**own, "object_id": 61, "stats_id": 1, "modification_counter": None},
        ),
        "stats": snapshot("stats", *[{**own, "object_id": n, "stats_id": 1, "name": f"s{n}"} for n in (*numbers, 60, 61)]),
        "objects": snapshot("objects", *[{**own, "object_id": n, "name": f"o{n:02}"} for n in (*numbers, 60, 61)]),
    }
    found = cells(r.volatile_statistics(t, SALES), "object_name", "modification_counter")
    assert len(found) == 50
    assert found[0] == ("o51", 510) and found[-1] == ("o01", 7)


def test_tables_derived_in_spark_have_the_rows_of_their_sql(spark):
    """Spark groups by the numbers that names are made of, and reads the two log counters at once."""
    folder, changed = "/root/testdata/sf0.001", ("performance_counters", "master_files", "file_stats", "wait_stats")
    for table in changed:
        plain = None
        for selection in derived.DERIVED[table]:
            text = selection.sql()
            views = {n: derived.read_table(spark, folder, n) for n in derived._USED.findall(text)}
            part = derived.align(spark.sql(text, **views), table)
            plain = part if plain is None else plain.unionByName(part)
        found = derived._open(spark, folder, table)
        assert found.schema == plain.schema and found.count() > 0
        assert found.exceptAll(plain).isEmpty() and plain.exceptAll(found).isEmpty(), table
    plan = derived._open(spark, folder, "performance_counters")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet [^\n]*lineitem", plan)) == 1
