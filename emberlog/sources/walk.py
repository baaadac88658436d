"""Files that Spark's own sources cannot tell of: a listing with all names, and texts that may turn out to be damaged.

``Walk`` is a data source that lists files as a plain directory walk does: hidden names and files of zero bytes as well.
Folders are listed by tasks, a partition for each folder below the root. Conditions on ``cluster_id`` and
``application_id`` are pushed into the source, so of the layout ``<root>/<cluster>/containers/<application>`` only the
folders that they allow are looked into at all.

``streamed`` reads compressed files one to a task as a stream, line by line, and gives each a last row with a status. What
a damaged file gave before its fault can so be taken back by its status, and the run goes on.
"""

from __future__ import annotations

import bz2
import fnmatch
import gzip
import os
import zlib
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

FILES = "path string, name string, n_bytes long, hidden boolean, cluster_id string, application_id string"
STREAMED = (".gz", ".bz2")
#: Characters of a line batch, and bytes that are read at once.
BATCH, PIECE = 4 << 20, 1 << 20
OK, DAMAGED = "ok", "unreadable"
#: Row number of the status.
LAST = 2**63 - 1


def reachable(spark: SparkSession) -> None:
    """Lets Python workers find this package where the session was begun in another folder."""
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


def walkable(path: str) -> bool:
    """Whether there is a file system for the path outside of Spark's readers."""
    try:
        opened(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path in it. A path without a scheme is local."""
    if "://" not in path and not path.startswith("file:"):
        return pa.fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pa.fs.FileSystem.from_uri(path)


class Folder(InputPartition):
    def __init__(self, path: str, cluster: str | None, application: str | None, deep: bool):
        self.path, self.cluster, self.application, self.deep = path, cluster, application, deep


class Walk(DataSource):
    """``FILES`` of all files below ``path`` whose name fits ``pattern``. Links are not followed twice: a folder is listed where it stands."""

    @classmethod
    def name(cls) -> str:
        return "emberlog_walk"

    def schema(self) -> str:
        return FILES

    def reader(self, schema: object) -> DataSourceReader:
        return Lister(self.options["path"], self.options.get("pattern", "*"))


class Lister(DataSourceReader):
    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for condition in filters:
            if isinstance(condition, (EqualTo, In)) and condition.attribute in (("cluster_id",), ("application_id",)):
                values = {condition.value} if isinstance(condition, EqualTo) else set(condition.value)
                name = condition.attribute[0]
                self.wanted[name] = self.wanted.get(name, values) & values
            yield condition  # Spark tests the rows as well, so a folder too many does no harm

    def inside(self, files: pa.fs.FileSystem, path: str) -> list[pa.fs.FileInfo]:
        return sorted(files.get_file_info(pa.fs.FileSelector(path)), key=lambda info: info.base_name)

    def partitions(self) -> list[Folder]:
        files, root = opened(self.path)
        if files.get_file_info(root).type == pa.fs.FileType.File:
            return [Folder(root, None, None, False)]
        if not self.wanted:
            folders = [info.path for info in self.inside(files, root) if info.type == pa.fs.FileType.Directory]
            return [Folder(root, None, None, False), *(Folder(folder, None, None, True) for folder in folders)]
        found = []
        clusters = self.wanted.get("cluster_id")
        for cluster in sorted(clusters) if clusters is not None else [i.base_name for i in self.inside(files, root) if i.type == pa.fs.FileType.Directory]:
            below = f"{root}/{cluster}/containers"
            if files.get_file_info(below).type == pa.fs.FileType.Directory:
                applications = self.wanted.get("application_id")
                for application in sorted(applications) if applications is not None else [i.base_name for i in self.inside(files, below) if i.type == pa.fs.FileType.Directory]:
                    if files.get_file_info(f"{below}/{application}").type == pa.fs.FileType.Directory:
                        found.append(Folder(f"{below}/{application}", cluster, application, True))
        return found

    def read(self, folder: Folder | None) -> Iterator[tuple]:
        if folder is None:  # there is no partition
            return
        files, root = opened(self.path)
        info = files.get_file_info(folder.path)
        waiting = [folder.path]
        if info.type == pa.fs.FileType.File:
            yield from self.row(info, root)
            return
        while waiting:
            for info in self.inside(files, waiting.pop()):
                if info.type == pa.fs.FileType.File:
                    yield from self.row(info, root)
                elif info.type == pa.fs.FileType.Directory and folder.deep:
                    waiting.append(info.path)

    def row(self, info: pa.fs.FileInfo, root: str) -> Iterator[tuple]:
        if fnmatch.fnmatchcase(info.base_name, self.pattern):
            below = info.path[len(root) :].split("/")
            cluster, application = layout(info.path)
            yield (self.shown(info.path, root), info.base_name, info.size, any(part.startswith(("_", ".")) for part in below), cluster, application)

    def shown(self, path: str, root: str) -> str:
        """The path as the root was written by the caller, local ones without a scheme."""
        prefix = self.path.removesuffix(root) if self.path.endswith(root) and not self.path.startswith("file:") else ""
        return prefix + path


def layout(path: str) -> tuple[str | None, str | None]:
    """Names of cluster and application: the last ``<cluster>/containers/<application>/`` that a path goes through first."""
    parts = path.split("/")
    for i in range(1, len(parts) - 2):
        if parts[i] == "containers" and parts[i - 1] and parts[i + 1]:
            return parts[i - 1], parts[i + 1]
    return None, None


def walk(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``FILES`` below ``path``."""
    reachable(spark)
    spark.dataSource.register(Walk)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("emberlog_walk").option("path", path).option("pattern", pattern).load()


# --- streams --------------------------------------------------------------------------------


def unpacked(path: str) -> Iterator[bytes]:
    """Bytes of a file in pieces, decompressed by its name; a fault in it raises."""
    files, local = opened(path)
    with files.open_input_stream(local, compression=None) as raw:
        if path.endswith(".gz"):
            with gzip.GzipFile(fileobj=raw) as text:
                while piece := text.read(PIECE):
                    yield piece
        elif path.endswith(".bz2"):
            with bz2.BZ2File(raw) as text:
                while piece := text.read(PIECE):
                    yield piece
        else:
            while piece := raw.read(PIECE):
                yield piece


#: Byte order mark, dropped at the start of a file.
MARK = b"\xef\xbb\xbf"
FAULTS = (OSError, EOFError, zlib.error, ValueError)


def cut_lines(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Lines between line feeds, the empty one after a last line feed included; no more than a piece beyond the line is held."""
    held: list[bytes] = []
    for piece in pieces:
        first, *more = piece.split(b"\n")
        held.append(first)
        if more:
            yield b"".join(held)
            yield from more[:-1]
            held = [more[-1]]
    yield b"".join(held)


LINES = pa.schema([("path", pa.string()), ("row", pa.int64()), ("line", pa.binary()), ("status", pa.string())])


def streamed(listed: DataFrame) -> DataFrame:
    """Lines of the files of ``listed`` (``path``): ``path``, ``row`` from 0, ``line`` (bytes as text) and ``status`` (null).

    The last row of a file has ``LAST`` for its row and the status. A file without a fault gives all lines.
    """

    def read(path: str) -> Iterator[pa.RecordBatch]:
        row, lines, size, status = 0, [], 0, OK

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([path] * len(lines)), pa.array(range(row - len(lines), row), pa.int64()), pa.array(lines, pa.binary()), pa.nulls(len(lines), pa.string())], schema=LINES)

        try:
            for line in cut_lines(unpacked(path)):
                lines.append(line.removeprefix(MARK) if row == 0 else line)
                row, size = row + 1, size + len(line)
                if size >= BATCH or len(lines) >= 10_000:
                    yield batch()
                    lines, size = [], 0
        except FAULTS:
            status = DAMAGED
        else:
            yield batch()
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([LAST]), pa.array([None], pa.binary()), pa.array([status])], schema=LINES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield from read(path)

    found = each_alone(listed).mapInArrow(run, "path string, row long, line binary, status string")
    return found.withColumn("line", F.col("line").cast("string"))


def each_alone(listed: DataFrame) -> DataFrame:
    """``path`` of the files, so dealt that files of any size lie in different tasks as far as there are tasks."""
    return listed.select("path").repartitionByRange(int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("path"))


def whole(listed: DataFrame) -> DataFrame:
    """``path`` and ``value`` of small files, whole; a null value where a file is damaged."""

    def read(path: str) -> bytes | None:
        try:
            return b"".join(unpacked(path))
        except FAULTS:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([read(path)], pa.binary())], ["path", "value"])

    return each_alone(listed).mapInArrow(run, "path string, value binary").withColumn("value", F.col("value").cast("string"))


def is_streamed(name: Column) -> Column:
    return F.endswith(name, F.lit(STREAMED[0])) | F.endswith(name, F.lit(STREAMED[1]))
