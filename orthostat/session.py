"""Session factory and the shared working folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "orthostat", master: str | None = None, partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings that the engine relies on (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    They then find it wherever the driver was started, on a cluster as well.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="orthostat-code-")
    atexit.register(shutil.rmtree, folder, True)
    root = Path(__file__).resolve().parent
    with zipfile.ZipFile(path := f"{folder}/orthostat.zip", "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def is_local(master: str) -> bool:
    """Whether driver and executors share one machine's folders."""
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, named by ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is made if all runs on one machine; on a
    cluster that is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("orthostat.shared.dir", None)
    if not named:
        if not is_local(spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="orthostat-")
        spark.conf.set("orthostat.shared.dir", named)
        atexit.register(shutil.rmtree, named.removeprefix("file://"), True)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _remove(path: str) -> None:
    if path.startswith("file://"):
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def table_path(spark: SparkSession, name: str) -> str:
    """A fresh table path in the shared folder; local paths are removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{os.getpid()}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    It cuts the lineage, survives the loss of executors, and is columnar, so that later
    reads prune columns.
    """
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
