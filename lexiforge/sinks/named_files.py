"""Text files with names given by the rows, published together (B1, B7, A2's layout).

Spark's own writers choose their file names. This data source takes rows (path, content): the relative
path of a file and its text, or a part of it; parts of one file must follow each other in one task.
Each task attempt writes below a staging folder of its own and reports that folder. Only the
attempts that Spark commits count: the driver moves their files to their names and removes the staging
folder, so failed, repeated and speculative attempts leave nothing, and a job that fails leaves the old files.
The driver holds the names of one task's files at a time, and a number for each file.

Folders are reached through Arrow's file systems, so a shared folder of any kind that it knows will do.
"""

from __future__ import annotations

import posixpath
import time
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "lexiforge_named_text"
ABORT_LOOKS = 100  # a fifth of a second each


def _filesystem(root: str):
    from pyarrow import fs

    if "://" not in root and not root.startswith("file:"):
        return fs.LocalFileSystem(), root.rstrip("/")
    if root.startswith("file:"):
        return fs.LocalFileSystem(), "/" + root[len("file:") :].strip("/")
    system, path = fs.FileSystem.from_uri(root)
    return system, path.rstrip("/")


def _relative(path: str | None) -> str:
    """The path below the root; one that would leave it is an error."""
    clean = posixpath.normpath(path or "")
    if not path or clean.startswith(("/", "..")) or clean == "." or clean.startswith("_staging-"):
        raise ValueError(f"not a path below the folder: {path!r}")
    return clean


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class _Writer(DataSourceWriter):
    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite = root, overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        system, root = _filesystem(self.root)
        folder = f"{self.staging}/{uuid.uuid4().hex}"
        last = None
        seen: set[str] = set()
        out = None
        for row in iterator:
            name = _relative(row[0])
            if name != last:
                if name in seen:
                    raise ValueError(f"the parts of {name} do not follow each other")
                if out is not None:
                    out.close()
                seen.add(name)
                last = name
                target = f"{root}/{folder}/{name}"
                system.create_dir(posixpath.dirname(target), recursive=True)
                out = system.open_output_stream(target)
            out.write((row[1] or "").encode())
        if out is not None:
            out.close()
        return Written(folder, len(seen))

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        system, root = _filesystem(self.root)
        folders = [f"{root}/{m.folder}" for m in messages if m is not None and m.files]

        def names(folder: str) -> list[str]:
            found = system.get_file_info(fs.FileSelector(folder, recursive=True))
            return [f.path[len(folder) + 1 :] for f in found if f.type == fs.FileType.File]

        every = np.sort(np.concatenate([np.fromiter(map(hash, names(f)), np.int64) for f in folders] or [np.empty(0, np.int64)]))
        doubtful = set(every[1:][every[1:] == every[:-1]].tolist())
        twice = [n for n, k in Counter(n for f in folders for n in names(f) if hash(n) in doubtful).items() if k > 1] if doubtful else []
        if twice:
            self.abort(messages)
            raise ValueError(f"two tasks wrote {min(twice)}")
        system.create_dir(root, recursive=True)
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(root)):
                if info.base_name != self.staging:
                    (system.delete_dir if info.type == fs.FileType.Directory else system.delete_file)(info.path)
        made = {""}
        for folder in folders:
            for f in names(folder):
                if posixpath.dirname(f) not in made:
                    made.add(posixpath.dirname(f))
                    system.create_dir(f"{root}/{posixpath.dirname(f)}", recursive=True)
                system.move(f"{folder}/{f}", f"{root}/{f}")
        self._clean(system, root)

    def abort(self, messages: list) -> None:
        """Tasks that were told to stop may write on for a moment: the folder has to stay away."""
        gone = 0
        for _ in range(ABORT_LOOKS):
            try:
                gone = 0 if self._clean(*_filesystem(self.root)) else gone + 1
            except OSError:
                gone = 0
            if gone == 5:
                break
            time.sleep(0.2)

    def _clean(self, system, root: str) -> bool:
        from pyarrow import fs

        there = system.get_file_info(f"{root}/{self.staging}").type != fs.FileType.NotFound
        if there:
            system.delete_dir(f"{root}/{self.staging}")
        return there


class NamedText(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, content string"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite)


def write_named_files(files: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Write rows (path, content) below the folder ``path``; returns it. A null content is empty."""
    spark = files.sparkSession
    spark.dataSource.register(NamedText)
    files.select(F.col("path").cast("string").alias("path"), F.col("content").cast("string").alias("content")).write.format(FORMAT).mode(mode).save(path)
    return path


def write_labelled_folders(files: DataFrame, spark: SparkSession, path: str) -> str:
    """A2's layout: (label, file_name, content) as ``{label}/{file_name}`` below ``path``."""
    return write_named_files(files.select(F.concat_ws("/", "label", "file_name").alias("path"), "content"), path)


def write_shards(lines: DataFrame, path: str, order: list[str], n_shards: int, prefix: str = "shard", suffix: str = ".txt") -> str:
    """Text shards named ``{prefix}-00000-of-{n}{suffix}``: lines dealt out by their ``shard`` (0 to n - 1), each shard in
    ``order``, one task per shard at least (a shard is the unit that its size bounds)."""
    name = F.format_string(f"{prefix}-%05d-of-{n_shards:05d}{suffix}", "shard")
    x = lines.repartition(n_shards, "shard").sortWithinPartitions("shard", *order)
    return write_named_files(x.select(name.alias("path"), F.concat("line", F.lit("\n")).alias("content")), path)
