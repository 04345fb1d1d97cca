"""A folder's files as a Spark data source: listed by the tasks, written with a commit.

Spark's own file index leaves out files of zero bytes, which label files may be; and one
file a row, with a commit for all of them, is no format of its own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Files that the driver renames at a time when it commits.
RENAMES = 32


def _system(root: str):
    """The file system of a folder that driver and executors share (a path, file:, hdfs:, s3:, gs:, abfs:), and the folder in it."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(root)
    return system, base.rstrip("/")


@dataclass
class _Part(InputPartition):
    path: str
    deep: bool


class _Lister(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[InputPartition]:
        """The folder itself, and each folder in it with all below."""
        from pyarrow import fs

        system, base = _system(self.root)
        found = system.get_file_info(fs.FileSelector(base))
        return [_Part(base, False), *(_Part(f.path, True) for f in found if f.type == fs.FileType.Directory)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        system, _ = _system(self.root)
        for f in system.get_file_info(fs.FileSelector(partition.path, recursive=partition.deep)):
            if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")):
                yield f.path, f.size


@dataclass
class _Written(WriterCommitMessage):
    """Files of a task, as (name in the staging folder, path), and paths that it could not write."""

    staged: list[tuple[str, str]] = field(default_factory=list)
    failed: list[str] = field(default_factory=list)


class _Writer(DataSourceWriter):
    """Tasks write into a hidden folder; files get their places when all tasks are done, or the folder goes if one fails.

    Tasks make no folders, so one that is still at work when the job fails can't bring the hidden one back.
    """

    def __init__(self, root: str, run: str):
        self.root, self.run = root, run

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        system, base = _system(self.root)
        done = _Written()
        for row in iterator:
            path, content, name = row["path"].lstrip("/"), row["content"], uuid.uuid4().hex
            try:
                with system.open_output_stream(f"{base}/.{self.run}/{name}") as f:
                    f.write(content if isinstance(content, (bytes, bytearray)) else content.encode())
                done.staged.append((name, path))
            except OSError:
                done.failed.append(path)
        return done

    def commit(self, messages: list) -> None:
        system, base = _system(self.root)
        staged = [x for m in messages if m is not None for x in m.staged]

        def place(x: tuple[str, str]) -> str | None:
            try:
                system.create_dir(f"{base}/{x[1]}".rpartition("/")[0], recursive=True)
                system.move(f"{base}/.{self.run}/{x[0]}", f"{base}/{x[1]}")
            except OSError:
                return x[1]
            return None

        levels: dict[int, list[tuple[str, str]]] = {}
        for x in staged:
            levels.setdefault(x[1].count("/"), []).append(x)
        with ThreadPoolExecutor(RENAMES) as pool:  # a file before what would need a folder of its name
            lost = [p for k in sorted(levels) for p in pool.map(place, levels[k]) if p]
        failed = [p for m in messages if m is not None for p in m.failed] + lost
        with system.open_output_stream(f"{base}/.{self.run}.report") as f:
            f.write(json.dumps({"written": len(staged) - len(lost), "failed": sorted(failed)}).encode())
        system.delete_dir(f"{base}/.{self.run}")

    def abort(self, messages: list) -> None:
        system, base = _system(self.root)
        system.delete_dir(f"{base}/.{self.run}")


class Folder(DataSource):
    """``path``: the folder. Reading gives (path, size) of its files; writing takes (path, content)."""

    @classmethod
    def name(cls) -> str:
        return "boxwright_folder"

    def schema(self) -> str:
        return "path string, size bigint"

    def reader(self, schema) -> DataSourceReader:
        return _Lister(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options["run"])


def _uri(root: str) -> str:
    return "/" + root.removeprefix("file:").lstrip("/") if root.startswith("file:") or "://" not in root else root


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, size of all files below a folder, those of zero bytes too; hidden ones are left out."""
    spark.dataSource.register(Folder)
    return spark.read.format(Folder.name()).load(_uri(root))


def write(files: DataFrame, root: str) -> tuple[int, list[str]]:
    """One file a row of (path, content): how many were written, and the paths that could not be.

    A file has its name only once all tasks are done; if the job fails, none is left.
    """
    spark, run = files.sparkSession, uuid.uuid4().hex[:12]
    spark.dataSource.register(Folder)
    system, base = _system(_uri(root))
    system.create_dir(f"{base}/.{run}", recursive=True)
    files.select("path", "content").write.format(Folder.name()).option("run", run).mode("append").save(_uri(root))
    with system.open_input_stream(f"{base}/.{run}.report") as f:
        report = json.loads(f.read())
    system.delete_file(f"{base}/.{run}.report")
    return report["written"], report["failed"]
