"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import gc
import io
import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# AQE picks join strategies from measured sizes and splits skewed partitions,
# so no operator in this package forces a broadcast hint.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, name: str = "tidewright", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Hands this package to the executors, once per application, so that its functions run there from any folder.

    Spark copies the archive from the driver to every executor.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tidewright_shipped", None) is not None:
        return spark
    root = os.path.dirname(os.path.abspath(__file__))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                archive.write(path, os.path.relpath(path, os.path.dirname(root)))
    # the folder lives as long as the driver: executors that start later fetch the archive from it through Spark
    sc._tidewright_shipped = tempfile.TemporaryDirectory(prefix="tidewright-")
    path = os.path.join(sc._tidewright_shipped.name, "tidewright.zip")
    with open(path, "wb") as out:
        out.write(data.getvalue())
    sc.addPyFile(path)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. A local session may leave it unset and gets one beside the warehouse tables."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints").rstrip("/")


@contextmanager
def setting(spark: SparkSession, **values: str) -> Iterator[None]:
    """SQL settings, written with ``_`` for each dot, for what is planned inside."""
    names = {name: name.replace("_", ".") for name in values}
    before = {key: spark.conf.get(key, None) for key in names.values()}
    try:
        for name, key in names.items():
            spark.conf.set(key, values[name])
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder, so that the data survives the loss of an executor."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle and checkpoint files of finished rounds.

    They go when the driver's garbage collector finds that nothing refers to them any more, which may otherwise take half an hour.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
