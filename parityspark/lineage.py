"""Durable hand-over points between the rounds of an iterative job.

A round's result is written as Parquet into the shared folder named by ``spark.checkpoint.dir`` and read
back. The next round then starts from files every executor can reach, so a lost executor costs one task
and not the whole loop, and the planner sees the true size of the table when it picks a join.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's own setting.

    Only a session whose executors are threads of the driver may do without one and gets a fresh local folder.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        return configured
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = sc.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="spark-parity-")
        sc.setCheckpointDir(_local_dirs[app])
    return _local_dirs[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "step", **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def settled(spark: SparkSession) -> Iterator[None]:
    """Inside, what a query has shuffled is deleted when that query ends; for chains of ``cut``, which never read it again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def drop(*tables: DataFrame) -> None:
    """Delete tables written by ``cut`` that no later step reads."""
    for table in tables:
        sc = table.sparkSession.sparkContext
        home = f"/{sc.applicationId}/"
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles() if home in f}:
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
