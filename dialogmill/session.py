"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "dialogmill", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", os.environ.get("DIALOGMILL_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new, empty folder name below the cluster's checkpoint folder.

    The folder has to be visible to every executor, so it comes from
    ``spark.checkpoint.dir``. Only where that is unset, as in local tests, is a
    temporary folder taken.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="dialogmill-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def settled(rows: DataFrame, purpose: str) -> DataFrame:
    """Write rows below the shared checkpoint folder and read them back.

    This cuts the lineage: a lost executor costs no more than its own tasks,
    and values such as generated row ids stay as they were written.
    """
    spark = rows.sparkSession
    path = shared_folder(spark, purpose)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
