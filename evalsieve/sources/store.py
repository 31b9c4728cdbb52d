"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_told: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir. Where that is unset, a temporary folder of this machine, which
    only local mode can do with. The folder is deleted when the driver's Python ends."""
    context = spark.sparkContext
    app, base = context.applicationId, spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="evalsieve-")
        base = _own[app]
    path = f"{base}/evalsieve/{app}"
    if path not in _told:
        _told.add(path)
        atexit.register(delete, spark, path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate tables; does nothing once the session has ended."""
    try:
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    except (AttributeError, AssertionError, OSError, PySparkException):
        pass
    except Exception as e:  # noqa: BLE001 the gateway's own errors differ by how the session ended
        if not type(e).__module__.startswith("py4j"):
            raise


def place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts lineage and survives lost executors."""
    path = place(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
