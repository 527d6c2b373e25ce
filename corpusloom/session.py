"""Session helpers. On a cluster the session is given; nothing here overrides it."""

from __future__ import annotations

import gc
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", app: str = "corpusloom", **conf: str) -> SparkSession:
    """A local session for tests and ``bench.py``."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for written intermediate tables.

    It lies in the shared folder the cluster names in ``spark.checkpoint.dir``; only a local
    session without that setting uses the machine's temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="scratch-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Give back the disk of shuffles that no table needs any more. Spark deletes their files once the driver's garbage is
    collected, which a driver with little to do may put off for the whole run."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    root = Path(__file__).parent.parent
    base = Path(tempfile.mkdtemp(prefix="package-")) / "corpusloom"
    archive = shutil.make_archive(str(base), "zip", root, Path(__file__).parent.name)
    spark.sparkContext.addPyFile(archive)
    _shipped.add(application)
