"""Sinks of whole files, as data sources whose tasks stage and whose driver commits.

A task writes into a staging folder of its own attempt, in the store that the path names, and tells the driver
what it wrote. On commit the driver moves the files of one attempt of each task to their places; on abort, and
after a commit, the staging folder goes. So a task that fails, or runs twice, leaves no file in its place. What a
task writes that outlives its job's abort stays in the staging folder, whose name Spark's readers pass over.
"""

from __future__ import annotations

import hashlib
import re
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

CHUNK = 1 << 20


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and place of a path: a plain one, or an address that pyarrow knows (file, hdfs, s3, gs)."""
    place = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), place) if place.startswith("/") else fs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    """The files that one attempt staged: its folder and their names."""

    folder: str
    names: list[str]


class StagedFiles(DataSourceArrowWriter):
    """files: gives the names of files as it writes them into a folder."""

    def __init__(self, path: str) -> None:
        self.path, self.job = path, uuid.uuid4().hex

    def files(self, batches: Iterator[pa.RecordBatch], at: fs.FileSystem, folder: str) -> Iterator[str]:
        raise NotImplementedError

    def staging(self) -> tuple[fs.FileSystem, str, str]:
        at, place = store(self.path)
        return at, place.rstrip("/"), f"{place.rstrip('/')}/_staging-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task = TaskContext.get()
        at, _, staging = self.staging()
        folder = f"{staging}/{task.partitionId()}-{task.taskAttemptId()}"
        at.create_dir(folder)
        return Written(folder, list(self.files(iterator, at, folder)))

    def commit(self, messages: list[Written | None]) -> None:
        at, place, staging = self.staging()
        for message in filter(None, messages):
            for name in message.names:
                at.move(f"{message.folder}/{name}", f"{place}/{name}")
        self.clear(at, staging)

    def abort(self, messages: list[Written | None]) -> None:
        at, _, staging = self.staging()
        self.clear(at, staging)

    @staticmethod
    def clear(at: fs.FileSystem, staging: str) -> None:
        if at.get_file_info(staging).type != fs.FileType.NotFound:
            at.delete_dir(staging)


class TarFiles(StagedFiles):
    """Archives of rows (archive, name, data), one member at a time; an archive's rows come together, in their order."""

    def files(self, batches: Iterator[pa.RecordBatch], at: fs.FileSystem, folder: str) -> Iterator[str]:
        now, out, tar = None, None, None
        try:
            for batch in batches:
                columns = [batch.column(batch.schema.get_field_index(c)) for c in ("archive", "name", "data")]
                for i in range(batch.num_rows):
                    archive, name, data = (c[i] for c in columns)
                    if archive.as_py() != now:
                        if tar:
                            tar.close()
                            out.close()
                            yield now
                        now = archive.as_py()
                        out = at.open_output_stream(f"{folder}/{now}")
                        tar = tarfile.open(fileobj=out, mode="w|")
                    info = tarfile.TarInfo(name.as_py())
                    content = data.as_buffer() if data.is_valid else pa.py_buffer(b"")
                    info.size = content.size
                    tar.addfile(info, pa.BufferReader(content))
            if tar:
                tar.close()
                yield now
        finally:
            if out:
                out.close()


class SingleFiles(StagedFiles):
    """A file for each row (name, data)."""

    def files(self, batches: Iterator[pa.RecordBatch], at: fs.FileSystem, folder: str) -> Iterator[str]:
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("name", "data")]
            for name, data in zip(*columns, strict=True):
                with at.open_output_stream(f"{folder}/{name.as_py()}") as out:
                    out.write(data.as_buffer() if data.is_valid else b"")
                yield name.as_py()


class TarArchives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tar_archives"

    def writer(self, schema: StructType, overwrite: bool) -> TarFiles:
        return TarFiles(self.options["path"])


class WholeFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "whole_files"

    def writer(self, schema: StructType, overwrite: bool) -> SingleFiles:
        return SingleFiles(self.options["path"])


def write_archives(members: DataFrame, folder: str, order: list[str]) -> None:
    """Write rows (archive, name, data) as tar files, members sorted by `order`; a file of the same name is replaced.

    Spark deals the rows out by archive and sorts them, spilling as it must; a task holds a batch of members.
    """
    spark = members.sparkSession
    spark.dataSource.register(TarArchives)
    dealt = members.repartition("archive").sortWithinPartitions("archive", *order).select("archive", "name", F.col("data").cast("binary").alias("data"))
    dealt.write.format("tar_archives").mode("append").option("path", folder).save()


def write_files(rows: DataFrame, folder: str) -> None:
    """Write each row (name, data) as a file; a file of the same name is replaced, by any one of rows of one name."""
    rows.sparkSession.dataSource.register(WholeFiles)
    rows.select("name", F.col("data").cast("binary").alias("data")).write.format("whole_files").mode("append").option("path", folder).save()


def archive_files(spark: SparkSession, folder: str) -> DataFrame:
    """(archive, path, bytes) of the tar files of a folder; their content is not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar").load(folder)
    return found.select(F.regexp_extract("path", "([^/]+)$", 1).alias("archive"), "path", F.col("length").alias("bytes"))


def archive_members(spark: SparkSession, folder: str) -> DataFrame:
    """(archive, nth, name, size, sha256) of every member of the archives of a folder, read from the first byte to the last in small pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, place = store(path)
                rows = []
                with at.open_input_stream(place) as source, tarfile.open(fileobj=source, mode="r|") as tar:
                    for nth, member in enumerate(tar):
                        digest, content = hashlib.sha256(), tar.extractfile(member)
                        while piece := content.read(CHUNK):
                            digest.update(piece)
                        rows.append((archive, nth, member.name, member.size, digest.hexdigest()))
                if rows:
                    yield pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], names=["archive", "nth", "name", "size", "sha256"])

    return archive_files(spark, folder).select("archive", "path").mapInArrow(run, "archive string, nth long, name string, size long, sha256 string")
