"""Shared scratch space: where a job may write tables that every executor reads.

The folder is the one that the cluster names in ``spark.checkpoint.dir``. Only
where that setting is absent and the master is local (tests, a laptop) is a
temporary folder created; on a cluster its absence raises, as executors would
each write to a disk of their own.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_folders: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared scratch folder of this session, without a trailing slash."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        folder = tempfile.mkdtemp(prefix="folioscan-")
        atexit.register(shutil.rmtree, folder, True)
        _own[app] = f"file://{folder}"
    return _own[app]


def scratch(spark: SparkSession, label: str) -> str:
    """A new unused path below the shared folder, in a folder of this session that goes when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        folder = f"{shared_root(spark)}/folioscan-{app}-{uuid.uuid4().hex[:8]}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
        _folders[app] = folder
    return f"{_folders[app]}/{label}-{uuid.uuid4().hex}"


def persist_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to shared Parquet and return a plan that reads it back.

    Lineage ends at durable files, so a lost executor costs a reread at most.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_once(df: DataFrame, path: str) -> DataFrame:
    """``persist_table`` at a path of the caller's; a table that is complete there already stays, so an interrupted job can go on."""
    spark = df.sparkSession
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
