"""Where operators that must write keep their files."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_LOCAL: dict[str, str] = {}
_RUNS: set[str] = set()


def run_folder(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables, in the shared checkpoint location.

    Only a session on a local master may go without that setting; it gets a temporary
    folder. A local session's folder goes when its process ends; on a cluster
    ``remove_run_folder`` is called at the end of a job.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    local = master == "local" or master.startswith("local[")
    if not base:
        if not local:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="spark-tracelake-")
            atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
        base = _LOCAL[app]
    folder = f"{base.rstrip('/')}/tracelake/{app}"
    if local and folder not in _RUNS:
        _RUNS.add(folder)
        atexit.register(shutil.rmtree, re.sub("^file:/+", "/", folder), ignore_errors=True)
    return folder


def remove_run_folder(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, on any store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder in the run's folder."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back.

    For frames that several branches of a plan use: later reads prune columns, and
    nothing above the table is computed again, also not after a lost executor.
    """
    path = work_dir(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)
