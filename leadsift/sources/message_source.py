"""A data source over a folder of message text files, for batch reads and for streams.

``spark.dataSource.register(MessageFolder)``, then ``spark.read.format("message_folder").load(path)``
or ``spark.readStream...``: one row (name, text) per ``*.txt`` file, for ``parse_message_text``. Text
is UTF-8, malformed bytes become U+FFFD. An empty file is an empty text, a missing folder has no
files.

Options: ``splitBytes`` (a task's files, 32 MiB unless one file is larger), ``settleSeconds`` (a
stream leaves files changed less than that ago, 2 by default, for later, so that a file still
being written, or one with the same time, is not passed over). A stream takes files by time of
change and name; a file that is put into the folder with an old time is not seen.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "name STRING, text STRING"


@dataclass
class Files(InputPartition):
    """Files that one task reads."""

    paths: list[str]


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _listed(path: str) -> list[tuple[int, str, int, str]]:
    """(time of change in ns, name, bytes, path) of the folder's messages, oldest first."""
    from pyarrow import fs

    system, folder = _filesystem(path)
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    kept = [f for f in found if f.is_file and f.base_name.endswith(".txt") and f.base_name[0] not in "._"]
    return sorted((f.mtime_ns or 0, f.base_name, f.size or 0, f.path) for f in kept)


def _split(files: list[tuple[int, str, int, str]], size: int) -> list[Files]:
    parts, held = [Files([])], 0
    for _, _, n, path in files:
        if parts[-1].paths and held + n > size:
            parts.append(Files([]))
            held = 0
        parts[-1].paths.append(path)
        held += n
    return parts


class _Reading:
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.size = int(options.get("splitbytes", 32 << 20))
        self.settle = float(options.get("settleseconds", 2))

    def read(self, partition: Files) -> Iterator[tuple[str, str]]:
        system, _ = _filesystem(self.path)
        for path in partition.paths:
            with system.open_input_stream(path) as stream:
                yield path.rsplit("/", 1)[-1], stream.read().decode("utf-8", "replace")


class BatchReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Files]:
        return _split(_listed(self.path), self.size)


class StreamReader(_Reading, DataSourceStreamReader):
    """Offsets are (time, name) of the last file taken, so that a restart takes none twice."""

    def initialOffset(self) -> dict:
        return {"time": -1, "name": ""}

    def latestOffset(self) -> dict:
        settled = time.time_ns() - int(self.settle * 1e9)
        last = [f for f in _listed(self.path) if f[0] <= settled][-1:]
        return {"time": last[0][0], "name": last[0][1]} if last else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        first, last = ((o["time"], o["name"]) for o in (start, end))
        return _split([f for f in _listed(self.path) if first < f[:2] <= last], self.size)


class MessageFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "message_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BatchReader:
        return BatchReader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> StreamReader:
        return StreamReader({k.lower(): v for k, v in self.options.items()})


def message_folder(spark: SparkSession, path: str, stream: bool = False, **options) -> DataFrame:
    """(name, text) rows of a folder, registered on the way."""
    spark.dataSource.register(MessageFolder)
    reader = spark.readStream if stream else spark.read
    return reader.format("message_folder").options(**options).load(path)
