from __future__ import annotations

import os
import re
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fleetvitals.sources import (
    align,
    banner,
    block_records,
    latest_rollover_rows,
    log_files,
    newest_file,
    numbered_log_lines,
    read_snapshots,
    render_text,
    rollover_rows,
    rollover_set,
    write_logs,
    write_rollover,
    write_sections,
    write_snapshots,
)
from fleetvitals.sources.textsink import as_lines
from tests.conftest import SERVER, T0, cells


@pytest.mark.parametrize(
    "newest, base",
    [
        ("/x/log_12.trc", "/x/{log.trc,log_[0-9].trc,log_[0-9][0-9].trc,"),
        ("/x/log.trc", "/x/{log.trc,log_[0-9].trc,"),
        ("/x/audit_log.trc", "/x/{audit_log.trc,audit_log_[0-9].trc,"),
        ("/x_y/a_b_3.parquet", "/x_y/{a_b.parquet,a_b_[0-9].parquet,"),
        ("log_1", "{log,log_[0-9],"),
        ("/x{1}/log_1.trc", "/x\\{1\\}/{log.trc,"),
    ],
)
def test_rollover_set(newest, base):
    assert rollover_set(newest).startswith(base) and rollover_set(newest).endswith("}")


def test_rollover_rows_read_the_whole_set_and_no_stranger(spark, tmp_path):
    folder = tmp_path / "of {server} [1]*"
    folder.mkdir()
    numbers = {"log.csv": 1, "log_9.csv": 9, "log_10.csv": 10, "other_1.csv": 0, "log_backup_1.csv": 0, "log_2x.csv": 0, "audit_log.csv": 5, "audit_log_3.csv": 6, "audit_1.csv": 0, "audit.csv": 0}
    for name, number in numbers.items():
        (folder / name).write_text(f"{number}\n")
    found = rollover_rows(spark, f"{folder}/log_10.csv", "csv", "n int")
    assert sorted(cells(found, "n")) == [1, 9, 10]
    assert sorted(os.path.basename(f) for f in cells(found, "source_file")) == [
        "log.csv", "log_10.csv", "log_9.csv",
    ]
    assert sorted(cells(rollover_rows(spark, f"{folder}/audit_log.csv", "csv", "n int"), "n")) == [5, 6]


def test_the_newest_file_names_the_set_and_no_other_file_is_opened(spark, tmp_path):
    folder = tmp_path / "of {server} [1] + ü %41"
    folder.mkdir()
    rows = spark.range(40)
    write_rollover(rows.where("id < 5"), F.lit(3), str(folder), "other")
    write_rollover(rows, F.when(F.col("id") % 3 > 0, F.col("id") % 3 * 9), str(folder), "log")
    (folder / "log_x.parquet").write_bytes(b"no parquet at all")
    (folder / "stray.txt").write_text("x")
    for name, age in (("log_x.parquet", 50), ("stray.txt", 60), ("other_3.parquet", 40), ("log.parquet", 0), ("log_9.parquet", 0), ("log_18.parquet", 0)):
        os.utime(folder / name, (1_700_000_000 - age, 1_700_000_000 - age))
    assert newest_file(spark, str(folder)).endswith("/log_18.parquet")
    found = latest_rollover_rows(spark, str(folder), schema="id bigint").collect()
    assert sorted(r.id for r in found) == list(range(40))
    assert {(r.id % 3, None if r.rollover is None else int(r.rollover)) for r in found} == {(0, None), (1, 9), (2, 18)}
    os.utime(folder / "other_3.parquet", (1_800_000_000, 1_800_000_000))
    assert latest_rollover_rows(spark, str(folder), schema="id bigint").count() == 5


def test_no_file_is_no_set(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    assert newest_file(spark, f"{tmp_path}/empty") is None
    with pytest.raises(ValueError):
        latest_rollover_rows(spark, f"{tmp_path}/empty")


@pytest.mark.parametrize("split", [7, 64, 1000, None])
def test_line_numbers_do_not_depend_on_the_splits(spark, tmp_path, split):
    texts = {
        "a": "".join(f"line {i} {'long ' * (i % 40)}\n" for i in range(200)),
        "b": "no end", "c": "\n\nx 1\r\n\ny 1", "d": "", "e": "z" * 500 + "1\n" + "1",
    }
    for name, text in texts.items():
        (tmp_path / f"errorlog {name}").write_bytes(text.encode())
    want = {(n, i, x) for n, t in texts.items() for i, x in enumerate(re.split("\r?\n", t)[: -1 if t.endswith("\n") or not t else None])}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")

    def found(*term, **more):
        out = numbered_log_lines(spark, str(tmp_path), *term, split_bytes=split, **more).collect()
        return {(r.source_file[-1], r.line_no, r.line) for r in out}

    assert found() == want
    assert found("1") == {w for w in want if "1" in w[2]}
    assert found("LINE 7", ignore_case=True) == {w for w in want if "line 7" in w[2]}
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_written_logs_are_read_by_many_tasks(spark, tmp_path):
    df = spark.range(3000).select("id", (F.col("id") % 2).alias("of"))
    write_logs(df, F.concat(F.lit("entry "), F.col("id")), [F.desc("id")], "of", f"{tmp_path}/logs")
    lines = numbered_log_lines(spark, f"{tmp_path}/logs", split_bytes=2000).collect()
    assert sorted((r.of, r.line_no, r.line) for r in lines) == sorted((i % 2, (2999 - i) // 2, f"entry {i}") for i in range(3000))


@pytest.mark.parametrize("split", [5, 33, 400, None])
def test_records_are_put_together_over_any_splits(spark, tmp_path, split):
    """A record over many splits, splits of many records, no record, and lines before the first."""
    texts = {
        "a": "preamble\nDBCC 0\n" + "".join(f"DBCC {i}\n  name: n{i}\n  size = {i * 7}\n" + "  filler\n" * (i % 5) for i in range(1, 60)),
        "b": "nothing\nat all\n", "c": "DBCC 7\n" + "  more\n" * 200 + "  size = 1\n  size = 2", "d": "",
    }
    for name, text in texts.items():
        (tmp_path / f"out.{name}").write_text(text)
    fields = {"id": "^DBCC (.*)$", "name": "name: (.*)", "size": "size = ([0-9]+)"}
    found = block_records(spark, str(tmp_path), "^DBCC ", fields, split_bytes=split).collect()
    want = {("a", 0, "0", None, None), *(("a", i, str(i), f"n{i}", str(i * 7)) for i in range(1, 60)), ("c", 0, "7", None, "1")}
    assert {(r.source_file[-1], r.record, r.id, r["name"], r.size) for r in found} == want and len(found) == len(want)


def test_log_files(spark, tmp_path):
    (tmp_path / "errorlog.1").write_text("one\nManufacturer: x\n")
    found = log_files(spark, str(tmp_path)).where(F.col("text").contains("Manufacturer"))
    assert [os.path.basename(f) for f in cells(found, "source_file")] == ["errorlog.1"]


def test_align_fills_and_converts(spark):
    old = spark.createDataFrame(
        [(SERVER, T0, 8, 3 * 1024 + 1023)],
        "server_name string, snapshot_ts timestamp_ntz, cpu_count bigint, physical_memory_in_bytes bigint",
    )
    found = align(old, "sys_info")
    row = found.first()
    assert (row.cpu_count, row.physical_memory_kb, row.ms_ticks) == (8, 3, None)
    assert dict(found.dtypes)["cpu_count"] == "int"


def test_old_and_new_servers_become_one_table(spark):
    key = "server_name string, snapshot_ts timestamp_ntz"
    old = spark.createDataFrame([("old", T0, "a")], f"{key}, edition string")
    new = spark.createDataFrame([("new", T0, "b", "1")], f"{key}, edition string, is_hadr_enabled string")
    both = align(old, "server_properties").unionByName(align(new, "server_properties"))
    assert sorted(cells(both, "server_name", "is_hadr_enabled"), key=str) == [("new", "1"), ("old", None)]


def test_read_snapshots_prunes_days(spark, snapshot, tmp_path):
    rows = [
        {"flag": day, "server_name": server, "snapshot_ts": datetime(2024, 5, day)}
        for day in (1, 2, 3) for server in ("a", "b")
    ]
    written = snapshot("trace_flags", *rows).withColumn("snapshot_date", F.to_date("snapshot_ts"))
    written.write.partitionBy("snapshot_date").parquet(f"{tmp_path}/trace_flags")
    found = read_snapshots(
        spark, str(tmp_path), "trace_flags", days=("2024-05-02", "2024-05-03"), servers=["b"]
    )
    assert sorted(cells(found, "flag")) == [2, 3]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot_date" in plan
    assert "PushedFilters: [IsNotNull(server_name), EqualTo(server_name,b)]" in plan


def test_the_store_is_written_by_day_and_type(spark, snapshot, tmp_path):
    rows = [
        {"backup_set_id": 10 * day + n, "database_name": "db  ", "type": kind, "snapshot_ts": datetime(2024, 5, day)}
        for day in (1, 2, 3) for n, kind in enumerate(("D", "L", None))
    ]
    backups = snapshot("backupset", *rows)
    write_snapshots(backups, str(tmp_path), "backupset")
    write_snapshots(backups.where("backup_set_id = 10").withColumn("backup_set_id", F.lit(99)), str(tmp_path), "backupset")
    assert {p.name for p in (tmp_path / "backupset").iterdir() if p.is_dir()} == {f"snapshot_date=2024-05-0{d}" for d in (1, 2, 3)}
    whole = read_snapshots(spark, str(tmp_path), "backupset")
    assert sorted(cells(whole, "backup_set_id")) == [10, 11, 12, 20, 21, 22, 30, 31, 32, 99]
    assert whole.dtypes == backups.dtypes and set(cells(whole, "database_name")) == {"db"}
    assert {r.backup_set_id % 10 for r in whole.where("type is null").collect()} == {2}
    full = read_snapshots(spark, str(tmp_path), "backupset", days=("2024-05-01", "2024-05-02"), where=F.col("type") == "D")
    assert sorted(cells(full, "backup_set_id")) == [10, 20, 99]
    days = spark.createDataFrame([(date(2024, 5, 3), 1), (date(2024, 5, 3), 1), (date(2024, 5, 1), 0), (None, 1)], "snapshot_date date, busy int")
    of_days = read_snapshots(spark, str(tmp_path), "backupset", days_of=days.where("busy = 1"))
    assert sorted(cells(of_days, "backup_set_id")) == [30, 31, 32]


@pytest.fixture
def mixed(spark):
    return spark.createDataFrame(
        [("x" * 40, "padded   ", datetime(2014, 11, 8, 13, 5), Decimal("1.50"), date(2024, 1, 2)), (None,) * 5],
        "long string, padded string, at timestamp_ntz, n decimal(18,2), d date",
    )


def test_render_text(mixed):
    first, second = render_text(mixed, {"long": 50}).collect()
    assert tuple(first) == ("x" * 40, "padded", "Nov  8 2014  1:05PM", "1.50", "2024-01-02")
    assert set(second) == {None}
    assert render_text(mixed).first().long == "x" * 30


def test_lines_are_padded(mixed):
    found = cells(as_lines(mixed.select("padded", "n"), {"padded": 8}), "value")
    assert found == ["padded   1.50", "NULL     NULL"]


def written(folder):
    """The lines of a text folder, part after part."""
    parts = sorted(f for f in os.listdir(folder) if f.startswith("part-"))
    return [line for part in parts for line in open(f"{folder}/{part}").read().splitlines()]


def test_write_sections(spark, mixed, tmp_path):
    write_sections(
        {"one": mixed.select("padded"), "two": mixed.select("n", "long")},
        f"{tmp_path}/out",
        {"two": {"n": 5, "long": None}},
    )
    assert written(f"{tmp_path}/out/section=one") == [banner("one"), "padded", "padded", "NULL"]
    assert written(f"{tmp_path}/out/section=two") == [
        "##########  two #############", "n     long", "1.50  " + "x" * 40, "NULL  NULL",
    ]


def test_written_reports_keep_their_order(spark, tmp_path):
    df = spark.range(5000).select(F.xxhash64("id").alias("h")).repartition(7).orderBy("h")
    write_sections({"sorted": df}, f"{tmp_path}/out")
    numbers = [int(line) for line in written(f"{tmp_path}/out/section=sorted")[2:]]
    assert len(numbers) == 5000 and numbers == sorted(numbers)


def test_all_sections_are_one_write_in_order(spark, tmp_path):
    sections = {f"s{n}": spark.range(n * 300).repartition(5).select(F.col("id").alias(f"c{n}")).orderBy(f"c{n}") for n in range(7)}
    write_sections(sections, f"{tmp_path}/out", header=["title", "date"])
    done = [str(p.relative_to(tmp_path)) for p in tmp_path.rglob("_SUCCESS")]
    assert done == ["out/_SUCCESS"]
    assert written(f"{tmp_path}/out/section=header") == ["title", "date"]
    for n in range(7):
        assert written(f"{tmp_path}/out/section=s{n}") == [banner(f"s{n}"), f"c{n}", *map(str, range(n * 300))]
    write_sections({}, f"{tmp_path}/none")
    assert not (tmp_path / "none").exists()


def test_declared_schemas_are_those_of_the_files(spark):
    from fleetvitals.sources.tables import TABLES, read_table

    folder = "/root/testdata/sf0.001"
    for name in TABLES:
        inferred = spark.read.parquet(f"{folder}/{name}.parquet").dtypes
        assert read_table(spark, folder, name).dtypes == inferred, name


@pytest.mark.parametrize("rows", [7, 1 << 18])
def test_a_long_log_is_several_files_that_continue_each_other(spark, tmp_path, monkeypatch, rows):
    from fleetvitals.sources import files

    monkeypatch.setattr(files, "LOG_ROWS", rows)
    df = spark.range(90).select("id", F.when(F.col("id") % 9 == 0, "b").otherwise("a").alias("of")).repartition(3)
    block = F.concat(F.lit("HEAD @"), F.col("id"), F.lit("\n  noise\n  User = u"), F.col("id"), F.lit("\n  ----"))
    write_logs(df, block, [F.desc("id")], "of", f"{tmp_path}/logs")
    parts = list((tmp_path / "logs" / "of=a").glob("part-*"))
    assert len(parts) > 5 if rows == 7 else len(parts) == 1
    want = {of: [i for i in reversed(range(90)) if (i % 9 == 0) == (of == "b")] for of in "ab"}
    for split in (16, None):
        found = block_records(spark, f"{tmp_path}/logs", "^HEAD @", {"id": "@(.*)$", "user": "^  User = u(.*)$"}, split_bytes=split, continued=True).collect()
        assert sorted((r["of"], r["record"], int(r["id"]), int(r["user"])) for r in found) == [(of, n, i, i) for of in "ab" for n, i in enumerate(want[of])]
        lines = numbered_log_lines(spark, f"{tmp_path}/logs", "HEAD", split_bytes=split, continued=True).collect()
        assert sorted((r["of"], r["line_no"], r["line"]) for r in lines) == [(of, 4 * n, f"HEAD @{i}") for of in "ab" for n, i in enumerate(want[of])]
