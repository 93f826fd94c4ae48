"""Session defaults and the one place that knows about the shared folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "foliant", cores: str = "*", shuffle: int = 8) -> SparkSession:
    """A local session with the settings the engine expects; on a cluster the caller's session is used as it is."""
    return (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where it is unset (tests, local mode) one is made and set."""
    sc = spark.sparkContext
    if (d := sc.getCheckpointDir()) is None:
        d = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not d:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
            d = os.path.join(tempfile.gettempdir(), f"foliant-{os.getpid()}")  # local mode and tests only
            atexit.register(shutil.rmtree, d, ignore_errors=True)
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir()
    return d


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of df through a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as a table in the shared folder and read it again; cheaper than computing it twice, and it survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _STORED:
        atexit.register(clean)
    _STORED.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


_STORED: list[tuple[SparkSession, str]] = []


def clean() -> None:
    """Remove the tables that `stored` wrote; at the end of the process, or when nothing that was built on them is needed any more."""
    while _STORED:
        spark, path = _STORED.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session may be over
            return
