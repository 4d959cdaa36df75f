"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on one machine a temporary one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="loomlake-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        found = f"file://{path}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Staged tables that are to go when the driver ends: folder and the session that wrote there.
STAGED: dict[str, SparkSession] = {}


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def delete_staged() -> None:
    for path, spark in STAGED.items():
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before; its tables then stay
            return


def stage_table(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back.

    Written rows survive a lost executor, and partitions of the table are read in a fixed order. Shuffle
    files go as soon as the table is written; the table goes by drop_table or when the driver ends.
    rows: about how many there are, where they are short and known; then no more files are written than they need.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/loomlake/{spark.sparkContext.applicationId}"
    STAGED[folder] = spark
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, rows // 200_000))
    size, width, clean = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = {k: spark.conf.get(k) for k in (size, width, clean)}
    most = int(before[size])
    spark.conf.set(size, str(min(2000, most) if most > 0 else 2000))  # whole texts are large rows
    spark.conf.set(width, "16m")
    spark.conf.set(clean, "true")
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete what stage_table wrote, once nothing reads it any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/loomlake/" in path:
            delete(df.sparkSession, path)


#: What operators keep in a worker from task to task, by name: how to drop it.
KEPT: dict[str, Callable[[], None]] = {}


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], owner: str = "") -> Callable:
    """work, for workers that outlive their tasks: it drops what other operators keep, and at its end gives freed memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from loomlake.llm.common import KEPT as kept  # this worker's own; a global name would be a copy from the driver

        others = [n for n in kept if n != owner]
        for name in others:
            kept.pop(name)()
        if others:
            gc.collect()
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run


def padded(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows' bytes in one array with pad zero bytes before each; and each row's first index in it."""
    lengths = ends - starts
    first = np.cumsum(lengths + pad) - lengths
    total = int(first[-1] + lengths[-1]) if len(first) else 0
    out = np.zeros(total, np.uint8)
    if total:
        index = np.repeat(starts - first, lengths) + ranges(first, lengths)
        out[ranges(first, lengths)] = raw[index]
    return out, first


def ranges(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """first[i], first[i]+1, ... for lengths[i] items, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    steps = np.ones(total, np.int64)
    some = lengths > 0
    at = np.cumsum(lengths[some]) - lengths[some]
    begin = first[some]
    steps[at] = begin
    steps[at[1:]] -= begin[:-1] + lengths[some][:-1] - 1
    return np.cumsum(steps)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_table(seed: int, kind: type = np.uint64) -> np.ndarray:
    """256 random words made from a seed."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)).astype(kind)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_text(column: str) -> "F.Column":
    """crc32 of a number's decimal digits."""
    return F.crc32(F.col(column).cast("string").cast("binary"))
