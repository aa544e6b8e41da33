"""Session helpers: a local session for tests, and lineage cuts that live in shared storage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_OWN_FOLDERS: dict[str, str] = {}


def local_session(
    cores: str | int = "*", partitions: int = 8, app: str = "diffloom", extra: dict[str, str] | None = None
) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]")
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    return (
        builder
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``. A local session that names none (a test) gets one of
    its own; on a cluster that would be a different disk on every machine, so there it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not folder:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        folder = _OWN_FOLDERS.setdefault(app, "") or tempfile.mkdtemp(prefix="spark-diffloom-")
        _OWN_FOLDERS[app] = folder
    return folder


_CUTS: list[tuple[str, str]] = []


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a table in shared storage, so that later steps neither recompute nor re-plan it
    and a lost executor costs nothing. Against ``checkpoint()`` a written table is computed once, not twice,
    is columnar, and tells the optimizer its size."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/diffloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _CUTS.append((spark.sparkContext.applicationId, path))
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """The exchanges of finished jobs are of no more use; a hint to the driver's collector lets Spark delete their files
    now rather than at some later time."""
    spark.sparkContext._jvm.System.gc()


def drop_cut(df: DataFrame) -> None:
    """Deletes a table that ``cut`` has written. Only for one that nothing unwritten is built on any more."""
    context = df.sparkSession.sparkContext
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = context._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
        _CUTS[:] = [x for x in _CUTS if x[1].rpartition("/")[2] != folder.rpartition("/")[2]]


def drop_cuts(spark: SparkSession) -> int:
    """Deletes the tables that ``cut`` has written for this application, and returns how many. For the caller to use
    once results are stored: a DataFrame that still reads one of them fails afterwards."""
    app, jvm = spark.sparkContext.applicationId, spark.sparkContext._jvm
    mine = [path for owner, path in _CUTS if owner == app]
    for path in mine:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _CUTS[:] = [x for x in _CUTS if x[0] != app]
    return len(mine)
