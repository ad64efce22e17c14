"""Session settings, the shared scratch folder and size-checked broadcasts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str | None = None, cores: int = 8, **conf: str) -> SparkSession:
    """A session for local work; on a cluster spark-submit supplies the rest."""
    builder = SparkSession.builder.appName("terravalor")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: the one the cluster names, else our own.

    ``spark.checkpoint.dir`` wins. Only where it is unset and the executors run in
    this process (tests, a laptop) a local folder is made, once per session.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors and the driver share")
        configured = tempfile.mkdtemp(prefix="terravalor-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def landing_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one for files a job writes and reads back."""
    return os.path.join(session_dir(spark), f"{name}-{uuid.uuid4().hex}")


def session_dir(spark: SparkSession) -> str:
    return os.path.join(shared_dir(spark), f"terravalor-{spark.sparkContext.applicationId}")


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at)


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files and folders of a folder, sorted; none if it isn't there."""
    fs, at = _file_system(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def release(spark: SparkSession) -> None:
    """Delete every table this session wrote; call it when its results are stored elsewhere."""
    fs, at = _file_system(spark, session_dir(spark))
    fs.delete(at, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back: the lineage ends here.

    A Parquet table survives the loss of executors, is read column by column,
    and carries its true size, which the planner needs to choose a join.
    """
    path = landing_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame) -> DataFrame:
    """A summary to be joined back onto its source.

    No broadcast hint: the written table's size is known, so Spark broadcasts it
    below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles it above.
    """
    return materialize(df)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt to all cores, for work that costs more than the bytes it reads.

    A compressed file of a million rows may be one split, and Spark merges a small summary into one
    task: whatever is computed from either would stay there. The number of parts is given, so they
    aren't merged again, and rows are dealt by hash, so a task that runs again deals the same.
    """
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, F.xxhash64(*keys))


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows dealt by join keys to a given number of parts.

    Spark merges shuffled parts by their bytes; where a row meets thousands of others in the join, the
    bytes say nothing of the work, and one task may be left with most of it.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def by_keys(df: DataFrame) -> DataFrame:
    """The side of a join on cells that is hashed, a shuffled partition at a time.

    The other side's rows were copied by ``explode``. Spark estimates both by the compressed files they
    were read from and doesn't count the copies, so without a hint it may broadcast either.
    """
    return df.hint("shuffle_hash")


def fixed_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A constant reference table of the library, safe to broadcast: its size is fixed."""
    return F.broadcast(spark.createDataFrame(rows, schema))
