"""What every job needs from the session: the package on the executors and a shared place for cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> SparkSession:
    """Put this package on the executors' path, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_facetflow_shipped", False):
        return spark
    archive = os.path.join(tempfile.mkdtemp(prefix="facetflow-"), "facetflow_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(_PACKAGE.rglob("*.py")):
            z.write(path, str(Path(_PACKAGE.name) / path.relative_to(_PACKAGE)))
    sc.addPyFile(archive)
    sc._facetflow_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where it is unset a local master gets a temporary one; a
    cluster has no folder to fall back on."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def _application_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/facetflow-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{_application_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, and a lost executor costs no recomputation."""
    spark = ship(df.sparkSession)
    path = fresh_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._cut_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame | str) -> None:
    """Delete tables that cut() wrote, and folders of fresh_path(), that no DataFrame still to be run reads."""
    for df in tables:
        if isinstance(df, str):
            _delete(SparkSession.active(), df)
            continue
        path = getattr(df, "_cut_path", None)
        if path:
            _delete(df.sparkSession, path)
            df._cut_path = None


def sweep(spark: SparkSession) -> None:
    """Delete all that this application wrote to the shared folder; for when its results are stored."""
    _delete(spark, _application_dir(spark))


def dealt(df: DataFrame) -> DataFrame:
    """df for a join in which both sides grow with the input: rows are dealt by key and merged. Spark takes a derived table to be as large as the
    files under it, so one that explode or decompression makes large would otherwise be sent whole through the driver."""
    return df.hint("merge")


def spread(df: DataFrame, *key: str) -> DataFrame:
    """df dealt by key over spark.sql.shuffle.partitions tasks before its rows are multiplied: a small file has few splits, and each would make, sort
    and sum all that comes of its rows. What is grouped by key and more needs no further shuffle."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
