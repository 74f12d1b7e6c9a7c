"""Surfaces as a data source: folders of JSON lines with drafts and answers, read in batch or as a stream.

``spark.dataSource.register(DraftSource)``, then ``spark.read.format("drafts").load(folder)`` or
``spark.readStream.format("drafts").load(folder)``. Files are found with pyarrow's file systems, so a folder
may be in any store that it knows. Each partition reads some files; a stream's offset is the last file taken, by time of change and name.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

DRAFT = "surface string, conversation string, seq long, kind string, text string, at timestamp, problem string"
#: Bytes of files that a partition takes, unless one file has more.
PART_BYTES = 64 << 20


def _store(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    uri = urlparse(path)
    if uri.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(uri.path)
    return fs.FileSystem.from_uri(path)


def listed(path: str) -> list[tuple[int, str, int]]:
    """(time of change in ns, file, bytes) of a folder's .json and .jsonl files, oldest first; names that begin with '_' or '.' are not data."""
    from pyarrow import fs

    store, folder = _store(path)
    found = store.get_file_info(fs.FileSelector(folder, recursive=False, allow_not_found=True))
    files = [(f.mtime_ns or 0, f.path, f.size or 0) for f in found if f.type == fs.FileType.File and f.base_name[:1] not in "_." and f.extension in ("json", "jsonl")]
    return sorted(files)


class Files(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


def parts(files: list[tuple[int, str, int]], most: int = PART_BYTES) -> list[Files]:
    out, size = [], 0
    for _, name, length in files:
        if not out or size + length > most:
            out.append(Files([]))
            size = 0
        out[-1].names.append(name)
        size += length
    return out


def rows_of(path: str, names: list[str]) -> Iterator[tuple]:
    """A row for each line; lines that are no JSON objects, or have fields of other types, come out with a problem and nothing else."""
    import datetime as dt

    store, _ = _store(path)
    for name in names:
        with store.open_input_stream(name) as f:
            rest = b""
            while True:
                block = f.read(1 << 20)
                *lines, rest = (rest + block).split(b"\n")
                for line in [*lines, *([] if block else [rest])]:
                    if not line.strip():
                        continue
                    try:
                        d = json.loads(line)
                        at = dt.datetime.fromisoformat(d["at"]).replace(tzinfo=dt.timezone.utc) if d.get("at") else None
                        texts = [None if d.get(k) is None else str(d[k]) for k in ("surface", "conversation", "kind", "text")]
                        seq = None if d.get("seq") is None else int(d["seq"])
                        yield texts[0], texts[1], seq, texts[2], texts[3], at, None
                    except (ValueError, TypeError, AttributeError) as e:
                        yield None, None, None, None, None, None, type(e).__name__
                if not block:
                    break


class DraftReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Files]:
        return parts(listed(self.path)) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return rows_of(self.path, partition.names)


class DraftStream(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"time": -1, "name": ""}

    def latestOffset(self) -> dict:
        files = listed(self.path)
        return {"time": files[-1][0], "name": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        after, until = (start["time"], start["name"]), (end["time"], end["name"])
        return parts([f for f in listed(self.path) if after < f[:2] <= until])

    def read(self, partition: Files) -> Iterator[tuple]:
        return rows_of(self.path, partition.names)

    def commit(self, end: dict) -> None:
        pass


class DraftSource(DataSource):
    """Format "drafts"; the folder is the path. Rows are DRAFT."""

    @classmethod
    def name(cls) -> str:
        return "drafts"

    def schema(self) -> str:
        return DRAFT

    def reader(self, schema: StructType) -> DraftReader:
        return DraftReader(self.options["path"])

    def streamReader(self, schema: StructType) -> DraftStream:
        return DraftStream(self.options["path"])
