"""Session helpers: local session for tests and benches, and the shared folder for cut lineage."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "versoflow") -> SparkSession:
    """A local session with the settings that the queries expect of any session (UTC, AQE)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("VERSOFLOW_DRIVER_MEMORY", "12g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder that ``spark.checkpoint.dir`` names.

    Only where that setting is absent (tests, local runs) a folder of this machine is chosen, which is
    right there because driver and executors are then one process. Checkpoint files survive lost executors.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="versoflow-checkpoint-"))
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once a session: they need not have it installed or share our folder."""
    sc = spark.sparkContext
    if getattr(sc, "_versoflow_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="versoflow-ship-")
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "versoflow"), "zip", root, "versoflow"))
    sc._versoflow_shipped = True
