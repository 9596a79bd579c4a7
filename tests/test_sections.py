from __future__ import annotations

import pytest

from fleetvitals.plans.reports import ReportOptions
from fleetvitals.plans.sections import (
    TEXT_WIDTHS,
    Switches,
    chosen_reports,
    run_sections,
    write_text,
)
from fleetvitals.sources import Tables
from fleetvitals.sources.telemetry import SNAPSHOTS

EVERYTHING = Switches(
    inventory=True, general=True, waits=True, wait_interval=True, backups=True, io=True, cpu=True,
    memory=True, buffer_objects=True, jobs=True, security=True, fragmentation=True,
    statistics=True, product_mark="PROD",
)


def chosen(database=None, **on):
    return [x.__name__ for x in chosen_reports(Switches(**on), ReportOptions(database=database))]


def test_nothing_is_on_by_default():
    assert chosen() == []


def test_everything_is_forty_one_reports():
    assert len(chosen_reports(EVERYTHING, ReportOptions(database="PROD6"))) == 41


def test_inventory_brings_general_fragmentation_and_statistics():
    found = chosen(inventory=True)
    assert found[0] == "server_properties" and "product_versions" not in found
    assert found[-3:] == ["index_fragmentation", "statistics_dates", "volatile_statistics"]
    assert len(found) == 14


def test_product_versions_need_inventory_and_the_name():
    assert "product_versions" in chosen("PROD6", inventory=True, product_mark="PROD")
    assert "product_versions" not in chosen("OTHER", inventory=True, product_mark="PROD")
    assert "product_versions" not in chosen("PROD6", general=True, product_mark="PROD")


def test_inner_switches_need_their_section():
    assert chosen(wait_interval=True, buffer_objects=True) == []
    assert "buffer_by_object" in chosen(memory=True, buffer_objects=True)
    assert chosen(waits=True, wait_interval=True) == ["waits_between_snapshots", "wait_statistics"]


def test_off_sections_open_no_table(snapshot):
    opened = []

    def opener(name):
        def build():
            opened.append(name)
            return snapshot(name)

        return build

    tables = Tables({name: opener(name) for name in SNAPSHOTS})
    found = run_sections(tables, Switches(security=True))
    assert list(found) == ["sysadmins", "security_admins"]
    assert opened == ["logins"]


def test_every_report_runs_on_empty_tables(snapshot):
    tables = Tables({name: (lambda name=name: snapshot(name)) for name in SNAPSHOTS})
    found = run_sections(tables, EVERYTHING, ReportOptions(database="PROD6"))
    for name, df in found.items():
        assert df.count() == 0, name
        assert df.columns[0] == "server_name", name


def test_text_widths_name_real_columns(snapshot):
    tables = Tables({name: (lambda name=name: snapshot(name)) for name in SNAPSHOTS})
    found = run_sections(tables, EVERYTHING, ReportOptions(database="PROD6"))
    for report, widths in TEXT_WIDTHS.items():
        assert set(widths) <= set(found[report].columns), report


def test_write_text(spark, snapshot, tmp_path):
    tables = Tables({"logins": lambda: snapshot(
        "logins", {"name": "n" * 60, "sysadmin": 1, "securityadmin": 1, "denylogin": 0})})
    write_text(run_sections(tables, Switches(security=True)), f"{tmp_path}/out")
    lines = [r.value for r in spark.read.text(f"{tmp_path}/out/section=security_admins").collect()]
    assert any(line.endswith(" " + "n" * 50) for line in lines)


@pytest.mark.parametrize("name", sorted(SNAPSHOTS))
def test_schema_starts_with_server_and_time(snapshot, name):
    assert snapshot(name).columns[:2] == ["server_name", "snapshot_ts"]
