"""Tables in the folder that all executors share (spark.checkpoint.dir), to cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import os
import shutil
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_MADE: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where that is unset and all runs on one machine, as in tests, a folder beside the warehouse."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset; it has to name a folder that the driver and all executors share")
        at = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_weirlight_shared")
    return at.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df as a table there, which is removed when the driver's program ends."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    _MADE.add(at)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def exists(spark: SparkSession, at: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def removed(made: set[str]) -> None:
    """Deletes these folders, through the file system of Spark while it runs, else where they are local."""
    sc = SparkContext._active_spark_context
    for at in made:
        if sc is not None and sc._jvm is not None:
            path = sc._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        elif at.startswith(("file:", "/")):
            shutil.rmtree("/" + at.removeprefix("file:").lstrip("/"), ignore_errors=True)
    made.clear()


atexit.register(removed, _MADE)
