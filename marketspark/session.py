"""Session factory and the settings every job of this package relies on."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that results or plans depend on.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "false",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def get_session(app: str = "marketspark", master: str | None = None, **conf: str) -> SparkSession:
    """Create or fetch a session. ``master`` is left to spark-submit when not given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        builder = builder.config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session, whose tasks all run on this machine, may do without: it gets a temporary folder that goes with
    the process. Anywhere else a machine-local folder would lose rows, so there the setting is required.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not runs_here(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
    return sc.getCheckpointDir()


def runs_here(master: str) -> bool:
    """Whether all tasks of a session with this master run in the driver's own process."""
    return re.fullmatch(r"local(\[[^\]]*\])?", master) is not None


def ship(spark: SparkSession) -> None:
    """Sends this package's source to the executors once, for clusters where it is not installed: tasks in Python import it."""
    sc = spark.sparkContext
    if getattr(sc, "_shipped_marketspark", False):
        return
    root = Path(__file__).resolve().parent
    into = Path(tempfile.mkdtemp(prefix="spark-")) / "marketspark.zip"  # the driver serves it from here
    with zipfile.ZipFile(into, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"marketspark/{f.relative_to(root)}")
    sc.addPyFile(str(into))
    sc._shipped_marketspark = True


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a small table inside a loop."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table that several later passes read, as Parquet in the shared folder.

    Later passes then read only the columns they need, and a lost executor costs one file read
    instead of the whole lineage.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)
