"""Logs and crawl state that survive retries: tables of committed batches.

A batch's rows are written to a folder of their own, and count only once a manifest names that folder. A manifest is a small
file that lists all committed batches; each commit makes the next one under a name that nobody else may take, by a rename. So
readers see whole batches or nothing, a batch that is written again changes nothing, and of two writers one takes the next
number and the other looks again. The rename must fail if the name is taken, as it does on HDFS and local disks.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


class Files:
    """What the log needs of the file system that holds a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path
        self.fs = self.place("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def place(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[str]:
        where = self.place(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.place(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> bool:
        """Makes a file with all of the text at once; False if there is one already."""
        spare = self.place(f"_spare-{uuid.uuid4().hex}")
        stream = self.fs.create(spare, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        taken = self.fs.exists(self.place(name))
        self.fs.mkdirs(self.place(name).getParent())
        if not taken and self.fs.rename(spare, self.place(name)):
            return True
        self.fs.delete(spare, False)
        return False

    def drop(self, name: str) -> None:
        self.fs.delete(self.place(name), True)


def manifest(files: Files) -> tuple[int, list[dict]]:
    """(number, batches: {batch, folder} in the order of their commits) of the last manifest; (0, []) for none."""
    found = files.names("_manifest")
    return (int(found[-1]), json.loads(files.read(f"_manifest/{found[-1]}"))) if found else (0, [])


def commit(rows: DataFrame, path: str, batch: str) -> bool:
    """Adds rows to the log at path as a batch, once: False, and nothing changes, if the batch is there already."""
    files = Files(rows.sparkSession, path)
    if any(x["batch"] == batch for x in manifest(files)[1]):
        return False
    folder = uuid.uuid4().hex
    rows.write.parquet(f"{path}/data/{folder}")
    while True:
        number, batches = manifest(files)
        if any(x["batch"] == batch for x in batches):
            files.drop(f"data/{folder}")
            return False
        if files.put_new(f"_manifest/{number + 1:012d}", json.dumps([*batches, {"batch": batch, "folder": folder}])):
            return True


def committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows of committed batches; none if there are none."""
    folders = [f"{path}/data/{x['folder']}" for x in manifest(Files(spark, path))[1]]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def latest(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """Of each key the row of the last batch that has it: commits as upserts. A batch has a key once."""
    batches = manifest(Files(spark, path))[1]
    if not batches:
        return spark.createDataFrame([], schema)
    numbers = spark.createDataFrame([(x["folder"], k) for k, x in enumerate(batches)], "_folder string, _number int")
    rows = spark.read.schema(schema).parquet(*[f"{path}/data/{x['folder']}" for x in batches])
    rows = rows.withColumn("_folder", F.regexp_extract("_metadata.file_path", "/data/([0-9a-f]+)/[^/]*$", 1)).join(F.broadcast(numbers), "_folder")
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_number")))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_folder", "_number", "_nth")


def compact(spark: SparkSession, path: str, schema: str, keys: list[str] | None = None) -> None:
    """Makes one folder of all committed ones (with keys: of their latest rows). The names of its batches stay known."""
    files = Files(spark, path)
    number, batches = manifest(files)
    if not batches:
        return
    folder = uuid.uuid4().hex
    rows = latest(spark, path, schema, keys) if keys else committed(spark, path, schema)
    rows.write.parquet(f"{path}/data/{folder}")
    empty = uuid.uuid4().hex
    rows.limit(0).write.parquet(f"{path}/data/{empty}")
    entries = [{"batch": x["batch"], "folder": empty} for x in batches[:-1]] + [{"batch": batches[-1]["batch"], "folder": folder}]
    if not files.put_new(f"_manifest/{number + 1:012d}", json.dumps(entries)):
        files.drop(f"data/{folder}")
        files.drop(f"data/{empty}")


def clean(spark: SparkSession, path: str) -> None:
    """Deletes what no manifest names: for when no writer is at work."""
    files = Files(spark, path)
    kept = {x["folder"] for x in manifest(files)[1]}
    for name in files.names("data"):
        if name not in kept:
            files.drop(f"data/{name}")


def not_yet(rows: DataFrame, path: str, key: str) -> DataFrame:
    """Rows whose key no committed batch holds."""
    kind = dict(rows.dtypes)[key]
    return rows.join(committed(rows.sparkSession, path, f"{key} {kind}").distinct(), key, "left_anti")
