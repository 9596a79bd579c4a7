"""Session defaults and the shared folder for what has to be written down."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "fleetvitals", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the numeric rules rely on (ANSI, UTC) and AQE.

    ``forceOptimizeSkewedJoin`` lets AQE split a hot join key even where that costs
    one more shuffle afterwards.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``).

    Only a local session without that setting gets a temporary folder; a folder of one machine is
    useless to the executors of a cluster, so there it is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fleetvitals-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/fleetvitals-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The same rows, read back from Parquet in the shared folder.

    Used where two branches of one plan must see the same placement of rows.
    """
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
