"""Binary files in the shared folder: tasks write them, a manifest names those of successful attempts, Spark reads them back."""

from __future__ import annotations

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, fresh_path
from .pieces import arrow_map


def put(folder: str, name: str, data: bytes) -> str:
    """Write one file of a task; the attempt is part of the name, so a repeated task never touches another's file. It is written under
    a name that Spark's readers pass over and renamed when it is whole. Returns the name."""
    from pyarrow import fs

    name = f"{name}-{TaskContext.get().taskAttemptId()}"
    where, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    where.create_dir(path, recursive=True)
    with where.open_output_stream(f"{path}/_{name}") as out:
        out.write(data)
    where.move(f"{path}/_{name}", f"{path}/{name}")
    return name


def write(df: DataFrame, run, schema: str, name: str) -> tuple[str, DataFrame]:
    """Run a mapInArrow function of (folder) that calls put() and yields a row for each file; (folder, manifest)."""
    folder = fresh_path(df.sparkSession, name)
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    return folder, cut(arrow_map(df, run(folder), schema), f"{name}-manifest")


def read(spark: SparkSession, folder: str, manifest: DataFrame, run, schema: str) -> DataFrame:
    """What a mapInArrow function of (file, content) makes of the manifest's files, with the manifest's columns; schema holds `file`.

    Contents never move: each file is decoded where it is read, and only its rows meet the manifest, which drops those of attempts
    that didn't succeed. Spark chooses the join by the manifest's size."""
    if manifest.isEmpty():
        return spark.createDataFrame([], schema).join(manifest, "file")
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return arrow_map(files, run, schema).join(manifest, "file")
