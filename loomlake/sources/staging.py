"""Tables written to the shared folder, to cut a lineage or to be read more than once."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that are to go when the driver ends, and the sessions that wrote there.
WRITTEN: dict[str, SparkSession] = {}


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def remove_all() -> None:
    for path, spark in WRITTEN.items():
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before; its tables then stay
            return


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir, which driver and executors share; on one machine in a temporary folder where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="loomlake-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        root = f"file://{path}"
        spark.conf.set("spark.checkpoint.dir", root)
    folder = f"{root}/loomlake-tables/{spark.sparkContext.applicationId}"
    WRITTEN[folder] = spark
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df and read it back; partitions are then read as they were written, and a lost executor costs a read."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete what staged wrote, once nothing reads it any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/loomlake-tables/" in path:
            remove(df.sparkSession, path)
