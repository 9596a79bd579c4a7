"""Snapshot tables worked out from the driver's tables, so every report can run on them.

Suppliers, customers, orders and users play servers and databases; quantities and prices play
counters. Each snapshot table is one or more selections written in SQL that Spark and DuckDB read
alike; columns not named are NULL. ``derived_tables`` opens them in Spark, ``with_clause`` says the
same as common table expressions for DuckDB.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import TABLES, Tables, read_table
from ..sources.telemetry import SNAPSHOTS, align

ONCE = "cast('2024-01-01 00:00:00' as timestamp)"


@dataclass(frozen=True)
class Selection:
    """``select columns source``; the first ``group`` columns are grouped, or rows made distinct."""

    source: str
    columns: dict[str, str] = field(default_factory=dict)
    group: int = 0
    distinct: bool = False

    def sql(self) -> str:
        chosen = ", ".join(f'{e} as {c}' for c, e in self.columns.items())
        grouped = f" group by {', '.join(map(str, range(1, self.group + 1)))}" if self.group else ""
        return f"select {'distinct ' if self.distinct else ''}{chosen} from {self.source}{grouped}"


def reserved(expression: str) -> str:
    """Ids 0 to 49, the last one standing for the reserved database."""
    return f"case when {expression} % 50 = 49 then 32767 else {expression} % 50 end"


def padded(expression: str) -> str:
    """Counters come with names filled up with blanks, as the servers give them."""
    return f"rpad({expression}, 128, ' ')"


def database(expression: str) -> str:
    return f"concat('db', {reserved(expression)})"


# A supplier is a server, seen once a year; parts are its databases, line numbers their files.
YEARLY = {
    "server_name": "concat('srv', l_suppkey)",
    "snapshot_ts": "cast(date_trunc('year', l_shipdate) as timestamp)",
}
YEARLY_FILE = {**YEARLY, "database_id": reserved("l_partkey"), "file_id": "l_linenumber"}
PRICE = "cast(floor(l_extendedprice) as bigint)"

# Orders spread over four servers that were collected once.
ORDER_ONCE = {"server_name": "concat('srv', o_orderkey % 4)", "snapshot_ts": ONCE}
LINE_ONCE = {"server_name": "concat('srv', l_orderkey % 4)", "snapshot_ts": ONCE}
TOTAL = "cast(floor(o_totalprice) as bigint)"

# A customer is a server, every order a snapshot of it.
ORDER_EACH = {"server_name": "concat('srv', o_custkey)", "snapshot_ts": "o_orderdate"}

# A user is a server, seen once a day.
DAILY = {
    "server_name": "concat('srv', user_id)",
    "snapshot_ts": "cast(cast(ts as date) as timestamp)",
}
EVENT_ONCE = {"server_name": "concat('srv', user_id % 10)", "snapshot_ts": ONCE}
VALUE = "cast(floor(value) as bigint)"
EVENT_CLASS = """case event_type when 'error' then 92 when 'purchase' then 93
    when 'view' then 94 else 10 end"""

PART_ONCE = {"server_name": "concat('srv', p_partkey % 4)", "snapshot_ts": ONCE}

# Inside a database: a customer's number names a table, its rest by three an index.
CATALOG = {
    **ORDER_ONCE,
    "database_name": database("o_orderkey"),
    "object_id": "o_custkey % 100",
    "index_id": "o_custkey % 3",
}
TABLE_OF_CATALOG = {key: CATALOG[key] for key in list(CATALOG)[:4]}
INDEX_NAME = "case when o_custkey % 3 = 0 then null else concat('ix', o_custkey % 3) end"

_DATABASES = """(
    select concat('srv', l_suppkey) as server_name,
           cast(date_trunc('year', l_shipdate) as timestamp) as snapshot_ts,
           case when l_partkey % 50 = 49 then 32767 else l_partkey % 50 end as database_id
    from {lineitem}
    union select concat('srv', o_orderkey % 4), cast('2024-01-01 00:00:00' as timestamp),
           case when o_orderkey % 50 = 49 then 32767 else o_orderkey % 50 end from {orders}
    union select concat('srv', p_partkey % 4), cast('2024-01-01 00:00:00' as timestamp), p_size
    from {part}
    union select concat('srv', user_id), cast(cast(ts as date) as timestamp), user_id % 50
    from {events}) known"""

DERIVED: dict[str, list[Selection]] = {
    "product_history": [Selection("{orders}", {
        **ORDER_EACH, "product_version": "o_orderpriority", "mod_time": "o_orderdate",
    })],
    "server_properties": [Selection("{orders}", {
        **ORDER_EACH, "machine_name": "concat('m', o_custkey)", "edition": "o_orderpriority",
        "product_level": "o_orderstatus", "process_id": "o_orderkey",
    })],
    "databases": [Selection(_DATABASES, {
        "server_name": "server_name", "snapshot_ts": "snapshot_ts", "database_id": "database_id",
        "name": "concat('db', database_id)",
        "recovery_model_desc": "concat('model', database_id % 3)",
        "compatibility_level": "100 + database_id % 20",
    })],
    "performance_counters": [
        Selection("{lineitem}", {
            **YEARLY,
            "object_name": padded("concat('INST', l_suppkey, ':Databases')"),
            "counter_name": padded("'Log File(s) Size (KB)'"),
            "instance_name": padded(database("l_partkey")),
            "cntr_value": f"sum({PRICE})",
        }, group=5),
        Selection("{lineitem}", {
            **YEARLY,
            "object_name": padded("concat('INST', l_suppkey, ':Databases')"),
            "counter_name": padded("'Log File(s) Used Size (KB)'"),
            "instance_name": padded(database("l_partkey")),
            "cntr_value": "sum(cast(floor(l_extendedprice * l_tax) as bigint))",
        }, group=5),
        Selection("{events}", {
            **DAILY, "snapshot_ts": "ts",
            "object_name": padded("""case when event_type = 'view' then 'INST:Buffer Manager'
                else 'INST:Memory Manager' end"""),
            "counter_name": padded("""case when event_type = 'view' then 'Page life expectancy'
                when event_type = 'error' then 'Memory Grants Pending' else 'Other' end"""),
            "instance_name": padded("event_type"), "cntr_value": VALUE,
        }),
    ],
    "sessions": [Selection("{events}", {
        **DAILY, "session_id": "case when event_type = 'error' then null else event_id end",
        "login_name": "concat('u', user_id % 7)", "program_name": "event_type",
    })],
    "trace_flags": [Selection("{events}", {**DAILY, "flag": "event_id", "global": "user_id % 2"})],
    "windows_info": [Selection("{orders}", {
        **ORDER_EACH, "windows_release": "o_orderpriority", "windows_sku": "o_orderkey % 50",
        "os_language_version": "1033 + o_custkey",
    })],
    "services": [Selection("{orders}", {
        **ORDER_EACH, "servicename": "concat('service ', o_orderpriority)",
        "process_id": "o_orderkey", "status_desc": "o_orderstatus",
        "last_startup_time": "o_orderdate",
    })],
    "nodes": [Selection("{lineitem}", {
        **YEARLY, "node_id": "l_linenumber",
        "node_state_desc": """case l_returnflag when 'R' then 'ONLINE DAC' when 'N' then 'ONLINE'
            else null end""",
        "active_worker_count": "l_partkey",
    })],
    "sys_info": [
        Selection("{orders}", {
            **ORDER_EACH, "cpu_count": "o_orderkey % 64 + 1", "scheduler_count": "o_orderkey % 64",
            "hyperthread_ratio": "o_orderkey % 4", "physical_memory_kb": f"{TOTAL} * 7",
            "affinity_type_desc": "o_orderpriority", "sqlserver_start_time": "o_orderdate",
            "cpu_ticks": f"{TOTAL} * 1000", "ms_ticks": TOTAL,
        }),
        Selection("{events}", {
            **EVENT_ONCE, "cpu_count": "max(user_id) % 16 + 1", "scheduler_count": "null",
            "hyperthread_ratio": "2", "physical_memory_kb": "count(*) * 1000",
            "affinity_type_desc": "null", "sqlserver_start_time": "min(ts)",
            "cpu_ticks": "count(*) * 10000", "ms_ticks": "count(*) * 3",
        }, group=2),
    ],
    "error_log": [Selection("{documents}", {
        "server_name": "concat('srv', source)", "snapshot_ts": ONCE, "text": "text",
    })],
    "master_files": [Selection("{lineitem}", {
        **YEARLY_FILE, "name": "concat('file', min(l_partkey))",
        "physical_name": "concat('/data/', min(l_orderkey))", "type_desc": "min(l_linestatus)",
        "state_desc": "min(l_returnflag)", "is_percent_growth": "count(*) % 2",
        "growth": "cast(sum(l_quantity) as bigint)", "size": f"sum({PRICE})",
    }, group=4)],
    "volume_stats": [Selection("{lineitem}", {
        **YEARLY_FILE, "volume_mount_point": "concat('vol', max(l_linenumber) % 3)",
        "file_system_type": "'NTFS'", "logical_volume_name": "null",
        "total_bytes": "(cast(max(l_linenumber) % 3 as bigint) + 1) * 3221225472",
        "available_bytes": "cast(max(l_linenumber) % 3 as bigint) * 1073741824",
    }, group=4)],
    "file_stats": [Selection("{lineitem}", {
        **YEARLY_FILE, "num_of_bytes_read": f"sum({PRICE}) * 1000",
        "num_of_bytes_written": f"sum({PRICE}) * 900",
        "io_stall_read_ms": "cast(sum(l_quantity) as bigint)",
        "num_of_reads": "sum(case when l_returnflag = 'R' then l_linenumber else 0 end)",
        "io_stall_write_ms": f"sum({PRICE})",
        "num_of_writes": "count(*)",
    }, group=4)],
    "dbinfo": [Selection("{lineitem}", {
        **YEARLY, "database_name": database("l_partkey"),
        "Field": "case when l_returnflag = 'R' then 'dbi_version' else 'dbi_dbccLastKnownGood' end",
        "Value": """case when l_quantity < 10 then '1900-01-01 00:00:00.000'
            else cast(l_shipdate as string) end""",
    })],
    "wait_stats": [Selection("{lineitem}", {
        **YEARLY,
        "wait_type": """case when l_partkey % 40 = 0 then 'CHECKPOINT_QUEUE'
            when l_partkey % 40 = 1 then 'WAITFOR' else concat('WAIT_', l_partkey % 40) end""",
        "waiting_tasks_count": "sum(case when l_quantity > 10 then l_linenumber else 0 end)",
        "wait_time_ms": f"sum({PRICE})",
        "signal_wait_time_ms": "sum(cast(floor(l_extendedprice * l_discount) as bigint))",
    }, group=3)],
    "backupset": [Selection(
        """{orders} join (select l_orderkey, max(l_shipdate) as finished from {lineitem}
            group by l_orderkey) shipped on l_orderkey = o_orderkey""",
        {
            **ORDER_ONCE, "database_name": "concat('db', o_custkey)",
            "backup_set_id": "o_orderkey", "media_set_id": "o_orderkey",
            "type": "case when o_orderstatus = 'O' then 'L' else 'D' end",
            "backup_start_date": "o_orderdate", "backup_finish_date": "finished",
            "backup_size": f"{TOTAL} * 50000",
        },
    )],
    "backupmediafamily": [Selection("{lineitem}", {
        **LINE_ONCE, "media_set_id": "l_orderkey",
        "physical_device_name": "concat('disk', l_partkey)",
        "logical_device_name": "concat('dev', l_suppkey)",
    })],
    "backupfile": [Selection("{lineitem}", {
        **LINE_ONCE, "backup_set_id": "l_orderkey", "file_size": f"{PRICE} * 1000",
        "backup_size": "cast(floor(l_extendedprice * (1 - l_discount)) as bigint) * 1000",
        "logical_name": "concat('f', l_linenumber)", "physical_name": "concat('p', l_partkey)",
    })],
    "vlf_info": [Selection("{lineitem}", {
        **YEARLY, "database_name": "concat('db', l_orderkey % 60)", "FileID": "l_linenumber",
        "FileSize": PRICE,
    })],
    "missing_index_group_stats": [Selection("{part}", {
        **PART_ONCE, "group_handle": "p_partkey", "user_seeks": "p_size",
        "avg_total_user_cost": "p_retailprice",
        "avg_user_impact": "cast(p_partkey % 100 as double)", "unique_compiles": "p_size",
    })],
    "missing_index_groups": [Selection("{part}", {
        **PART_ONCE, "index_group_handle": "p_partkey", "index_handle": "p_partkey * 10",
    })],
    "missing_index_details": [Selection("{part}", {
        **PART_ONCE, "index_handle": "p_partkey * 10", "database_id": "p_size",
        "statement": "concat('t', p_partkey)", "equality_columns": "p_brand",
        "inequality_columns": "p_type", "included_columns": "p_name",
    })],
    "trace_rows": [Selection("{events}", {
        **DAILY, "StartTime": "ts", "EventClass": EVENT_CLASS, "databaseid": "user_id % 50",
        "Filename": "concat('log_', event_id, '.trc')", "IntegerData": VALUE,
        "duration": "event_id * 7",
    })],
    "trace_events": [Selection("{events}", {
        **DAILY, "trace_event_id": EVENT_CLASS, "name": "concat('class ', upper(min(event_type)))",
    }, group=3)],
    "ring_buffers": [Selection("{events}", {
        **EVENT_ONCE,
        "ring_buffer_type": """case when event_type = 'signup' then 'OTHER'
            else 'RING_BUFFER_SCHEDULER_MONITOR' end""",
        "timestamp": "event_id",
        "record": f"""case when event_type = 'error'
            then concat('<Record id="', event_id, '"><SchedulerMonitorEvent/></Record>')
            when event_type = 'click'
            then concat('<Record id="', event_id, '"><SchedulerMonitorEvent><SystemHealth>',
                        '<SystemIdle>', {VALUE} % 100,
                        '</SystemIdle></SystemHealth></SchedulerMonitorEvent></Record>')
            else concat('<Record id="', event_id, '"><SchedulerMonitorEvent><SystemHealth>',
                        '<ProcessUtilization>', {VALUE} % 60, '</ProcessUtilization>',
                        '<SystemIdle>', user_id % 40,
                        '</SystemIdle></SystemHealth></SchedulerMonitorEvent></Record>') end""",
    })],
    "query_stats": [Selection("{lineitem}", {
        **LINE_ONCE, "plan_handle": "concat('h', l_orderkey)", "total_worker_time": PRICE,
    })],
    "plan_attributes": [
        Selection("{orders}", {
            **ORDER_ONCE, "plan_handle": "concat('h', o_orderkey)", "attribute": "'dbid'",
            "value": f"""case when o_orderstatus = 'P' then null
                else cast({reserved('o_orderkey')} as string) end""",
        }),
        Selection("{orders}", {
            **ORDER_ONCE, "plan_handle": "concat('h', o_orderkey)",
            "attribute": "'set_options'", "value": "o_orderpriority",
        }),
    ],
    "buffer_descriptors": [Selection("{lineitem}", {
        **LINE_ONCE, "database_id": reserved("l_orderkey"), "allocation_unit_id": "l_orderkey",
    })],
    "allocation_units": [Selection("{orders}", {
        **ORDER_ONCE, "database_name": database("o_orderkey"),
        "allocation_unit_id": "o_orderkey", "container_id": "o_custkey",
        "type": "o_orderkey % 7 % 4 + 1",
    })],
    "partitions": [Selection("{orders}", {
        **ORDER_ONCE, "database_name": database("o_orderkey"), "hobt_id": "o_custkey",
        "partition_id": "o_custkey", "object_id": "o_custkey % 100", "index_id": "o_custkey % 3",
    }, distinct=True)],
    "objects": [Selection("{orders}", {
        **TABLE_OF_CATALOG, "name": "concat('t', o_custkey % 100)", "type_desc": "'USER_TABLE'",
    }, distinct=True)],
    "indexes": [Selection("{orders}", {
        **CATALOG, "name": INDEX_NAME, "type_desc": "min(o_orderpriority)",
    }, group=6)],
    "tables": [Selection("{orders}", {
        **TABLE_OF_CATALOG, "name": "concat('t', o_custkey % 100)",
    }, distinct=True)],
    "sysindexes": [Selection("{orders}", {
        **CATALOG, "name": INDEX_NAME, "rowcnt": f"sum({TOTAL})",
    }, group=6)],
    "index_physical_stats": [Selection("{orders}", {
        **CATALOG, "avg_fragmentation_in_percent": "count(*) * cast(1.5 as double)",
        "page_count": f"sum({TOTAL} % 6000)",
    }, group=5)],
    "stats": [Selection("{orders}", {
        **{key: CATALOG[key] for key in list(CATALOG)[:4]}, "stats_id": "o_custkey % 3",
        "name": "concat('stat', o_custkey % 3)", "auto_created": "count(*) % 2",
        "no_recompute": "0",
    }, group=6)],
    "stats_properties": [Selection("{orders}", {
        **{key: CATALOG[key] for key in list(CATALOG)[:4]}, "stats_id": "o_custkey % 3",
        "modification_counter": "sum(case when o_orderstatus = 'F' then o_custkey else 0 end)",
        "rows": f"sum({TOTAL})", "rows_sampled": "count(*)", "last_updated": "max(o_orderdate)",
    }, group=5)],
    "sys_memory": [Selection("{orders}", {
        **ORDER_EACH, "total_physical_memory_kb": f"{TOTAL} * 1000",
        "available_physical_memory_kb": f"{TOTAL} * 333", "total_page_file_kb": f"{TOTAL} * 2000",
        "system_memory_state_desc": "o_orderpriority",
    })],
    "process_memory": [Selection("{orders}", {
        **ORDER_EACH, "physical_memory_in_use_kb": TOTAL, "page_fault_count": "o_orderkey",
        "memory_utilization_percentage": "o_orderkey % 101",
        "process_physical_memory_low": "o_orderkey % 2",
    })],
    "configurations": [
        Selection("{orders}", {
            **ORDER_EACH, "name": "'max server memory (MB)'", "minimum": "128",
            "value_in_use": "o_custkey * 300",
        }),
        Selection("{orders}", {
            **ORDER_EACH, "name": "'other'", "minimum": "0", "value_in_use": "o_orderkey",
        }),
    ],
    "jobs": [Selection("{documents}", {
        "server_name": "concat('srv', doc_id % 25)", "snapshot_ts": ONCE,
        "name": "concat('job', doc_id)", "description": "text",
        "owner_sid": "concat('sid', doc_id)", "enabled": "doc_id % 2",
        "category_id": "doc_id % 9",
    })],
    "job_categories": [Selection("{documents}", {
        "server_name": "concat('srv', doc_id % 25)", "snapshot_ts": ONCE,
        "category_id": "doc_id % 9", "name": "concat('category ', doc_id % 9)",
    }, distinct=True)],
    "logins": [Selection("{customer}", {
        "server_name": "concat('srv', c_nationkey)", "snapshot_ts": ONCE,
        "sid": "concat('sid', c_custkey)",
        "name": "case when c_custkey % 50 = 0 then 'sa' else concat(c_name, '  ') end",
        "sysadmin": "case when c_acctbal < 5000 then 1 else 0 end",
        "securityadmin": "case when c_acctbal > 3000 then 1 when c_acctbal < 0 then null else 0 end",
        "denylogin": "case when c_mktsegment = 'MACHINERY' then 1 else 0 end",
    })],
}

#: Expressions of a group's keys that stand for one value each: what Spark groups by, and how the key
#: is made of it afterwards. Numbers are shorter than the padded names to hash, sort and shuffle.
RAW = {
    YEARLY["server_name"]: ("l_suppkey", YEARLY["server_name"].replace("l_suppkey", "{}")),
    **{
        key: (reserved("l_partkey"), key.replace(reserved("l_partkey"), "{}"))
        for key in (database("l_partkey"), padded(database("l_partkey")))
    },
}

_SIZE, _USED_SIZE = DERIVED["performance_counters"][:2]

#: The same rows for Spark alone: two counters of one table are added up in one pass over it.
IN_SPARK: dict[str, list[Selection]] = {
    "performance_counters": [
        Selection(
            f"""(select l_suppkey, {YEARLY["snapshot_ts"]} as year, {reserved("l_partkey")} as id,
                {_SIZE.columns["cntr_value"]} as size, {_USED_SIZE.columns["cntr_value"]} as used
                from {{lineitem}} group by 1, 2, 3)
            lateral view explode(map({_SIZE.columns["counter_name"]}, size,
                {_USED_SIZE.columns["counter_name"]}, used)) as counter, kb""",
            {
                **_SIZE.columns, "snapshot_ts": "year", "counter_name": "counter",
                "instance_name": padded("concat('db', id)"), "cntr_value": "kb",
            },
        ),
        *DERIVED["performance_counters"][2:],
    ],
}


def _spark_sql(selection: Selection) -> str:
    """The selection, with names of its keys made after the grouping."""
    keys = list(selection.columns.items())[: selection.group]
    if not any(expression in RAW for _, expression in keys):
        return selection.sql()
    raw = [RAW.get(expression, (expression, "{}")) for _, expression in keys]
    values = dict(list(selection.columns.items())[selection.group :])
    inner = {**{f"key{i}": own for i, (own, _) in enumerate(raw)}, **values}
    shown = {name: raw[i][1].replace("{}", f"key{i}") for i, (name, _) in enumerate(keys)}
    grouped = Selection(selection.source, inner, selection.group).sql()
    return Selection(f"({grouped})", {**shown, **{v: v for v in values}}).sql()


_USED = re.compile(r"\{(\w+)\}")


def _sql_of(table: str, **names: str) -> list[str]:
    return [selection.sql().format(**names) for selection in DERIVED[table]]


def _open(spark: SparkSession, folder: str, table: str) -> DataFrame:
    parts = []
    for selection in IN_SPARK.get(table, DERIVED[table]):
        text = _spark_sql(selection)
        views = {name: read_table(spark, folder, name) for name in set(_USED.findall(text))}
        parts.append(align(spark.sql(text, **views), table))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def derived_tables(spark: SparkSession, folder: str) -> Tables:
    return Tables(
        {table: (lambda table=table: _open(spark, folder, table)) for table in DERIVED}
    )


_DUCK_TYPES = {"string": "varchar", "int": "integer", "timestamp_ntz": "timestamp"}


def _fields(table: str) -> list[tuple[str, str]]:
    pairs = re.findall(r"(\w+)\s+(\w+(?:\(\d+,\d+\))?)", SNAPSHOTS[table])
    return [(name, _DUCK_TYPES.get(kind, kind)) for name, kind in pairs]


def _typed(expression: str, kind: str) -> str:
    value = f"cast({expression} as {kind})"
    return f"rtrim({value})" if kind == "varchar" else value


def with_clause(sql: str) -> str:
    """``sql`` with a common table expression in front for every snapshot table it reads."""
    needed = [t for t in DERIVED if re.search(rf"\b(?:from|join)\s+{t}\b", sql)]
    expressions = []
    names = {name: name for name in TABLES}
    for table in needed:
        branches = []
        for selection, text in zip(DERIVED[table], _sql_of(table, **names)):
            typed = ", ".join(
                f"{_typed(name if name in selection.columns else 'null', kind)} as {name}"
                for name, kind in _fields(table)
            )
            branches.append(f"select {typed} from ({text}) s")
        expressions.append(f"{table} as ({' union all '.join(branches)})")
    return f"with {', '.join(expressions)} {sql}"
