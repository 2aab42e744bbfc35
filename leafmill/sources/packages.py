"""Zip packages (office files are such) as a Spark data source: parts are read a package to a partition, and packages are written so
that none is seen before it is whole.

spark.dataSource.register(Packages) makes the format "packages" known. Reading a folder gives path, part, place and payload. Writing
takes rows of package (a file name), part, place and payload, all parts of a package in one partition and in a row (`to_packages`
deals them so). A task writes into a folder of its own under _staged and names what it finished; commit moves these files to their
places, and what failed, cut short or second attempts of a task left goes with the folder. The path is one that all executors see."""

from __future__ import annotations

import os
import shutil
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

READ = "path string, part string, place int, payload binary"
STAGED = "_staged"


def _local(path: str) -> str:
    return path.removeprefix("file://")


@dataclass
class _File(InputPartition):
    path: str


@dataclass
class _Done(WriterCommitMessage):
    folder: str
    names: list[str]


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = _local(path)

    def partitions(self) -> list[InputPartition]:
        if os.path.isfile(self.path):
            return [_File(self.path)]
        found = (os.path.join(top, n) for top, folders, names in os.walk(self.path) for n in names if not n.startswith(("_", ".")) and STAGED not in os.path.relpath(top, self.path).split(os.sep))
        return [_File(f) for f in sorted(found)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not isinstance(partition, _File):  # an empty folder
            return
        with zipfile.ZipFile(partition.path) as z:
            for place, info in enumerate(z.infolist()):
                yield partition.path, info.filename, place, z.read(info)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = _local(path), overwrite
        self.job = os.path.join(self.path, STAGED, uuid.uuid4().hex)

    def write(self, rows: Iterator) -> WriterCommitMessage:
        folder = os.path.join(self.job, uuid.uuid4().hex)  # of this attempt alone
        os.makedirs(folder)
        names: list[str] = []
        open_: zipfile.ZipFile | None = None
        try:
            for r in rows:
                if open_ is None or r["package"] != names[-1]:
                    if open_ is not None:
                        open_.close()
                    name = r["package"]
                    if not name or name != os.path.basename(name) or name.startswith(("_", ".")):
                        raise ValueError(f"no name of a package: {name!r}")
                    if name in names:
                        raise ValueError(f"the parts of {name} don't stand in a row")
                    names.append(name)
                    open_ = zipfile.ZipFile(os.path.join(folder, name), "w", zipfile.ZIP_DEFLATED)
                info = zipfile.ZipInfo(r["part"], (1980, 1, 1, 0, 0, 0))  # equal parts give equal files
                info.compress_type = zipfile.ZIP_DEFLATED
                open_.writestr(info, bytes(r["payload"] or b""))
        finally:
            if open_ is not None:
                open_.close()
        return _Done(folder, names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        done = [m for m in messages if isinstance(m, _Done)]
        names = [n for m in done for n in m.names]
        try:
            if len(set(names)) < len(names):
                raise ValueError("a package has parts in several partitions")
            taken = sorted(n for n in names if os.path.exists(os.path.join(self.path, n)))
            if taken and not self.overwrite:
                raise FileExistsError(", ".join(taken[:5]))
            for m in done:
                for n in m.names:
                    os.replace(os.path.join(m.folder, n), os.path.join(self.path, n))
        finally:
            self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        shutil.rmtree(self.job, ignore_errors=True)
        try:
            os.rmdir(os.path.join(self.path, STAGED))
        except OSError:
            pass  # another job writes here, too


class Packages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packages"

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


def to_packages(parts: DataFrame) -> DataFrame:
    """package, part, place and payload dealt so that each package is in one partition, its parts in order of place. A package is one
    task's, as a file is."""
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.select("package", "part", "place", "payload").repartition(n, "package").sortWithinPartitions("package", "place", "part")
