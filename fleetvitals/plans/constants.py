"""Values that are part of the reports' meaning."""

# Waits of idle or background work, which say nothing about load.
IDLE_WAITS = (
    "BROKER_EVENTHANDLER",
    "BROKER_RECEIVE_WAITFOR",
    "BROKER_TASK_STOP",
    "BROKER_TO_FLUSH",
    "BROKER_TRANSMITTER",
    "CHECKPOINT_QUEUE",
    "CHKPT",
    "CLR_AUTO_EVENT",
    "CLR_MANUAL_EVENT",
    "CLR_SEMAPHORE",
    "DBMIRROR_DBM_EVENT",
    "DBMIRROR_EVENTS_QUEUE",
    "DBMIRROR_WORKER_QUEUE",
    "DBMIRRORING_CMD",
    "DIRTY_PAGE_POLL",
    "DISPATCHER_QUEUE_SEMAPHORE",
    "EXECSYNC",
    "FSAGENT",
    "FT_IFTS_SCHEDULER_IDLE_WAIT",
    "FT_IFTSHC_MUTEX",
    "HADR_CLUSAPI_CALL",
    "HADR_FILESTREAM_IOMGR_IOCOMPLETION",
    "HADR_LOGCAPTURE_WAIT",
    "HADR_NOTIFICATION_DEQUEUE",
    "HADR_TIMER_TASK",
    "HADR_WORK_QUEUE",
    "KSOURCE_WAKEUP",
    "LAZYWRITER_SLEEP",
    "LOGMGR_QUEUE",
    "ONDEMAND_TASK_QUEUE",
    "PWAIT_ALL_COMPONENTS_INITIALIZED",
    "QDS_PERSIST_TASK_MAIN_LOOP_SLEEP",
    "QDS_CLEANUP_STALE_QUERIES_TASK_MAIN_LOOP_SLEEP",
    "REQUEST_FOR_DEADLOCK_SEARCH",
    "RESOURCE_QUEUE",
    "SERVER_IDLE_CHECK",
    "SLEEP_BPOOL_FLUSH",
    "SLEEP_DBSTARTUP",
    "SLEEP_DCOMSTARTUP",
    "SLEEP_MASTERDBREADY",
    "SLEEP_MASTERMDREADY",
    "SLEEP_MASTERUPGRADED",
    "SLEEP_MSDBSTARTUP",
    "SLEEP_SYSTEMTASK",
    "SLEEP_TASK",
    "SLEEP_TEMPDBSTARTUP",
    "SNI_HTTP_ACCEPT",
    "SP_SERVER_DIAGNOSTICS_SLEEP",
    "SQLTRACE_BUFFER_FLUSH",
    "SQLTRACE_INCREMENTAL_FLUSH_SLEEP",
    "SQLTRACE_WAIT_ENTRIES",
    "WAIT_FOR_RESULTS",
    "WAITFOR",
    "WAITFOR_TASKSHUTDOWN",
    "WAIT_XTP_HOST_WAIT",
    "WAIT_XTP_OFFLINE_CKPT_NEW_LOG",
    "WAIT_XTP_CKPT_CLOSE",
    "XE_DISPATCHER_JOIN",
    "XE_DISPATCHER_WAIT",
    "XE_TIMER_EVENT",
)

# Kinds of backup.
FULL_BACKUP = "D"
LOG_BACKUP = "L"

# Event classes of a data file and of a log file growing by itself.
AUTOGROW_CLASSES = (92, 93)

# Ids of the reserved resource database and of the temporary database.
RESOURCE_DATABASE = 32767
TEMP_DATABASE = 2
LAST_SYSTEM_DATABASE = 4

# The field holding the last clean check, and the time that stands for "never".
CHECK_FIELD = "dbi_dbccLastKnownGood"
NEVER = "1900-01-01 00:00:00"
NEVER_LABEL = "Never ran DBCC CHECKDB"

# Counters and settings by name.
LOG_USED_COUNTER = "Log File(s) Used Size (KB)"
LOG_SIZE_COUNTER = "Log File(s) Size (KB)"
PAGE_LIFE_OBJECT = "Buffer Manager"
PAGE_LIFE_COUNTER = "Page life expectancy"
GRANTS_OBJECT = "Memory Manager"
GRANTS_COUNTER = "Memory Grants Pending"
MEMORY_SETTING = "max server memory (MB)"
CPU_RING = "RING_BUFFER_SCHEDULER_MONITOR"
CPU_RECORD_MARK = "<SystemHealth>"
ADMIN_CONNECTION_NODE = "ONLINE DAC"
MANUFACTURER_TERM = "Manufacturer"
