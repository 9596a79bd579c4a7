from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql.types import StructType

from fleetvitals.session import build_session
from fleetvitals.sources.telemetry import SNAPSHOTS

SERVER = "srv1"
T0 = datetime(2024, 5, 1, 12, 0, 0)


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def snapshot(spark):
    """Build a snapshot table from rows that only name what matters."""

    def build(table: str, *rows: dict, **common):
        schema = StructType.fromDDL(SNAPSHOTS[table])
        base = {"server_name": SERVER, "snapshot_ts": T0, **common}
        unknown = {c for r in rows for c in {**base, **r}} - set(schema.fieldNames())
        assert not unknown, unknown
        data = [tuple({**base, **r}.get(c) for c in schema.fieldNames()) for r in rows]
        return spark.createDataFrame(data, schema)

    return build


def cells(df, *columns):
    """Rows in their order; a single column comes as plain values."""
    found = [tuple(row[c] for c in columns) for row in df.collect()]
    return [row[0] for row in found] if len(columns) == 1 else found
