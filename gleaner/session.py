"""Session helpers shared by tests, the bench and the driver entry."""

from __future__ import annotations

import os
import shutil
import site
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine expects (UTC, AQE)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("gleaner")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("GLEANER_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, unless they find it where it is.

    They do where it is installed, where PYTHONPATH names its folder, and in local
    mode in the working folder. Otherwise a zip goes with the application, once.
    """
    root = Path(__file__).resolve().parent.parent
    context = spark.sparkContext
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), *site.getsitepackages(), *([os.getcwd()] if context.master.split("[")[0] == "local" else [])]
    if any(k and Path(k).resolve() == root for k in known) or getattr(ship, "done", None) == context.applicationId:
        return
    folder = tempfile.mkdtemp(prefix="gleaner-")
    context.addPyFile(shutil.make_archive(f"{folder}/gleaner", "zip", root, "gleaner"))
    ship.done = context.applicationId


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what the cluster names in ``spark.checkpoint.dir``. Only where that is unset
    and all of Spark runs in one process (tests, a laptop) a local folder is made and set;
    on a cluster no folder of one machine would do, so there it is an error.
    """
    ship(spark)
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(shared_dir, "own", None)
        if not found:
            found = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="gleaner-")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame) -> DataFrame:
    """df written to a table of its own in the shared folder and read again.

    For loops of many rounds. A checkpoint hands on the sort orders and constraints that the optimizer has inferred;
    they double from round to round until planning takes longer than the work. A table that is read has none.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/rounds-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def release(df: DataFrame) -> None:
    """Frees what earlier jobs left behind on executors' disks.

    Spark deletes the files of a shuffle when the driver's collector finds that no plan refers to it.
    After a checkpoint those before it are free, but a driver with memory to spare collects
    every half hour only, and many small rounds would fill disks until then.
    """
    df.sparkSession.sparkContext._jvm.System.gc()
