"""Durable cut points for long plans.

A plan that must be read twice with identical row placement (row numbering,
carry tables) is written once as a Parquet table in the shared folder the
cluster names in ``spark.checkpoint.dir`` and read back.  A written table, other
than a cached one, survives the loss of executors and stays columnar, so later
operators still prune columns and push filters.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"
_WRITTEN: list[str] = []
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables; only a local session may fall back to a folder of its own under /tmp."""
    configured = spark.conf.get(_CONF, None) or spark.sparkContext.getConf().get(_CONF)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_CONF} to a folder every executor can reach")
    session = spark.sparkContext.applicationId
    if session not in _OWN:
        _OWN[session] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _OWN[session]


def materialize(df: DataFrame, label: str = "cut", by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return a scan of it; ``by`` columns become folders that filters skip."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").partitionBy(*by).parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables this process has written; results read from them become invalid."""
    done = 0
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        done += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return done
