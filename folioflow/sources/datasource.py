"""Folders of documents as a Spark data source: `spark.read.format("folioflow")`, a stream of new files, and a sink.

Files are listed once, on the driver, and dealt to partitions by their bytes; filters on suffix and name choose among them
before any is opened.  A partition opens, names and parses its files one at a time.  File systems are pyarrow's, so a path is a
local or shared folder, or a URI that it knows."""

from __future__ import annotations

import datetime
import fnmatch
import hashlib
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)

from folioflow.sources import files

NAME = "folioflow"
SCHEMA = "path string, suffix string, " + files.PARSED
#: Bytes of files, about, that one task reads.
PARTITION_BYTES = 16 << 20
#: A stream leaves files alone that changed less than so many milliseconds ago: another may still come with the same time.
SETTLE_MS = 1000


@dataclass
class Files(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]):
        self.paths = paths


@dataclass
class Written(WriterCommitMessage):
    n: int


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri("file://" + unquote(path[5:]) if path.startswith("file:/") and not path.startswith("file://") else path)
    return pafs.LocalFileSystem(), path


def listed(path: str, wanted: str) -> list[pafs.FileInfo]:
    """The files of a folder and its folders, or the one file, whose names fit the pattern; hidden ones are left out."""
    system, inner = opened(path)
    info = system.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else system.get_file_info(pafs.FileSelector(inner, recursive=True))
    seen = (f for f in found if f.is_file and not f.base_name.startswith((".", "_")) and fnmatch.fnmatch(f.base_name, wanted))
    return sorted(seen, key=lambda f: f.path)


def suffix_of(name: str) -> str:
    return ("." + name.rpartition(".")[2]).lower() if "." in name else ""


def dealt(found: Iterable[pafs.FileInfo], most: int) -> list[Files]:
    out: list[Files] = []
    held = most
    for f in found:
        if held + f.size > most:
            out.append(Files([]))
            held = 0
        out[-1].paths.append(f.path)
        held += f.size
    return out


def parsed(path: str, part: Files) -> Iterator[tuple]:
    system, _ = opened(path)
    for name in part.paths:
        with system.open_input_stream(name) as stream:
            content = stream.read()
        doc_name = name.rpartition("/")[2]
        for row in files.rows_of(hashlib.sha256(content).hexdigest()[:12], doc_name, suffix_of(doc_name), content, files.PARSERS):
            yield (name, suffix_of(doc_name), *row)


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.most = int(options.get("partitionBytes", PARTITION_BYTES))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = getattr(f, "attribute", ())
            kind = {EqualTo: "in", In: "in", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "holds"}.get(type(f))
            if len(column) == 1 and column[0] in ("suffix", "doc_name") and kind:
                self.tests.append((column[0], kind, (f.value,) if isinstance(f, EqualTo) else f.value))
            else:
                yield f

    def fits(self, name: str) -> bool:
        checks = {"in": lambda x, v: x in v, "starts": str.startswith, "ends": str.endswith, "holds": lambda x, v: v in x}
        return all(checks[kind](suffix_of(name) if column == "suffix" else name, value) for column, kind, value in self.tests)

    def partitions(self) -> list[InputPartition]:
        return dealt((f for f in listed(self.path, self.pattern) if self.fits(f.base_name)), self.most) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return parsed(self.path, partition)


class StreamReader(DataSourceStreamReader):
    """Offsets are times of change: a batch has the files that changed after its start, up to its end."""

    def __init__(self, options):
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.most = int(options.get("partitionBytes", PARTITION_BYTES))
        self.until = 0

    def initialOffset(self) -> dict:
        return {"until": 0}

    def latestOffset(self) -> dict:
        settled = time.time() * 1000 - SETTLE_MS
        self.until = max([self.until, *(t for f in listed(self.path, self.pattern) if (t := changed(f)) <= settled)])
        return {"until": self.until}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return dealt((f for f in listed(self.path, self.pattern) if start["until"] < changed(f) <= end["until"]), self.most)

    def read(self, partition: Files) -> Iterator[tuple]:
        return parsed(self.path, partition)


def changed(f: pafs.FileInfo) -> int:
    return -(-f.mtime_ns // 1_000_000)


class Writer(DataSourceWriter):
    """Rows (name, content) as files.  A task that runs again writes the same files."""

    def __init__(self, options):
        self.path = options["path"]

    def write(self, iterator) -> Written:
        system, folder = opened(self.path)
        system.create_dir(folder, recursive=True)
        n, mark = 0, f"{datetime.datetime.now().timestamp():.6f}"
        for row in iterator:
            hidden = f"{folder}/.{row['name']}.{mark}"
            with system.open_output_stream(hidden) as out:
                out.write(bytes(row["content"]))
            system.move(hidden, f"{folder}/{row['name']}")
            n += 1
        return Written(n)


class Source(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Source)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """(path, suffix, *files.PARSED): a row a segment or block of each file; a file that can't be parsed is a row with `error`."""
    register(spark)
    return spark.read.format(NAME).options(**options).load(path)


def write(documents: DataFrame, path: str) -> None:
    """Rows (name, content) as files of a folder."""
    register(documents.sparkSession)
    documents.select("name", "content").write.format(NAME).mode("append").save(path)
