"""Whole files by name: finding and opening them in local and remote stores, and a sink that commits.

    spark.dataSource.register(NamedFiles)
    df.select("name", "content").write.format("named_files").mode("overwrite").save(folder)

Each task writes its files to a folder of its own beside the final one; when all have ended well they
are moved into place, and on failure removed.  A reader never sees a part of a result.  `append` adds
to a folder, `overwrite` puts the new files in its place, and other modes refuse a folder with files.
"""

from __future__ import annotations

import fnmatch
import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: A folder of the sink's own inside the target; names that begin so are hidden to Spark's readers.
STAGED = "_staged-"


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def found(path: str, pattern: str) -> list[tuple[str, int]]:
    """Paths and sizes of the files under a folder, at any depth, whose name fits, in order of path; a file is itself."""
    where, at = store(path)
    info = where.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    every = where.get_file_info(fs.FileSelector(at, allow_not_found=True, recursive=True))
    back = path[: len(path) - len(at)] if "://" in path and path.endswith(at) else ""
    fits = [x for x in every if x.type == fs.FileType.File and fnmatch.fnmatch(x.base_name, pattern) and STAGED not in x.path]
    return sorted((back + x.path, x.size) for x in fits)


def opened(path: str):
    """A file for random access."""
    where, at = store(path)
    return where.open_input_file(at)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: in spark.checkpoint.dir, and only where that is unset, as in
    tests, in a temporary one of this machine."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if named is None and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{named or tempfile.mkdtemp(prefix='quadrat-')}/{name}-{uuid.uuid4().hex}"


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, f"{STAGED}{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        where, at = store(self.path)
        task = TaskContext.get()
        folder, names = f"{at}/{self.run}/{task.partitionId()}-{task.taskAttemptId()}", []
        where.create_dir(folder, recursive=True)
        for row in iterator:
            name, content = row["name"], row["content"]
            if not name or name.startswith(("/", "_", ".")) or ".." in name.split("/"):
                raise ValueError(f"no name for a file: {name!r}")
            if "/" in name:
                where.create_dir(f"{folder}/{name.rsplit('/', 1)[0]}", recursive=True)
            with where.open_output_stream(f"{folder}/{name}") as f:
                f.write(bytes(content or b""))
            names.append(name)
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        where, at = store(self.path)
        done = [m for m in messages if m]
        names = [n for m in done for n in m.names]
        if len({*names}) < len(names):
            self.abort(messages)
            raise ValueError("two files have one name")
        if self.overwrite:
            for x in where.get_file_info(fs.FileSelector(at, allow_not_found=True)):
                if STAGED not in x.path:
                    where.delete_dir(x.path) if x.type == fs.FileType.Directory else where.delete_file(x.path)
        for m in done:
            for name in m.names:
                if "/" in name:
                    where.create_dir(f"{at}/{name.rsplit('/', 1)[0]}", recursive=True)
                where.move(f"{m.folder}/{name}", f"{at}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        where, at = store(self.path)
        if where.get_file_info(f"{at}/{self.run}").type == fs.FileType.Directory:
            where.delete_dir(f"{at}/{self.run}")


class NamedFiles(DataSource):
    """Sink of `name string, content binary`, a file a row."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return NamedFilesWriter(self.options["path"], overwrite)


def lines_of(folder: str, pattern: str) -> Iterator[bytes]:
    """Lines of all files that fit, for tests and small looks."""
    for path, _ in found(folder, pattern):
        with opened(path) as f:
            yield from f.read().splitlines()
