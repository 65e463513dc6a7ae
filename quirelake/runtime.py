"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "quirelake", cores: int = 8, checkpoints: str | None = None, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use.

    ``checkpoints`` is the folder for cut lineages; without it a temporary one is made, which
    is only right because the session is local.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if checkpoints:
        builder = builder.config("spark.checkpoint.dir", checkpoints)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session, ``spark.checkpoint.dir``.

    Only a session in one process (master ``local``) gets a temporary folder where that is
    unset; on a cluster such a folder would be another one on each machine, so it raises.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="quirelake-ckpt-")
        atexit.register(shutil.rmtree, folder, True)
    context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder; survives the loss of executors.

    The files go when nothing refers to the result any more, in sessions with
    ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def widen(df: DataFrame, factor: int = 3) -> DataFrame:
    """Spread a table of few partitions over all cores before work that is heavy per row.

    Tables that already have at least one partition per core are left alone, so large
    inputs pay no shuffle. ``df`` must hold no shuffle itself: asking an adaptive plan for its
    partitions would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores * factor)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def micros(column):
    """Microseconds since 1970-01-01 of a timestamp, whatever the session's time zone."""
    ntz = column.cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ntz)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a context; they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_quirelake_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    file = os.path.join(tempfile.mkdtemp(prefix="quirelake-"), "quirelake.zip")
    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("quirelake", os.path.relpath(path, root)))
    context.addPyFile(file)
    context._quirelake_shipped = True
