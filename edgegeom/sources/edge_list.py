"""Edge lists as a data source of their own: ``spark.read.format("edge_list").load(path)``.

Files are cut into byte ranges and every range is a partition, so one large file is read by many tasks.
Rows that are no edge are skipped by the reader; what is left is ``(graph_id, src, dst)``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..columns import EDGE_KEY
from ..operators.clean import canonical_edges

#: Bytes of a file that one partition reads, and rows of a batch.
SPLIT_BYTES, BATCH_ROWS = 64 << 20, 65_536
_INTEGER = re.compile(rb"[+-]?[0-9]+")
_LARGEST = 2**63
SCHEMA = "graph_id STRING, src BIGINT, dst BIGINT"


class Split(InputPartition):
    """Lines of a file that start in a byte range."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def _number(cell: bytes) -> int | None:
    cell = cell.strip()
    if len(cell) > 1 and cell[:1] == b'"' == cell[-1:]:
        cell = cell[1:-1].strip()
    if not _INTEGER.fullmatch(cell):
        return None
    x = int(cell)
    return x if -_LARGEST <= x < _LARGEST else None


def edge_of(line: bytes) -> tuple[int, int] | None:
    """The first two cells of a line if they are integers and the line is no remark."""
    if line.lstrip().startswith(b"#"):
        return None
    cells = line.split(b",", 2)
    if len(cells) < 2:
        return None
    src, dst = _number(cells[0]), _number(cells[1])
    return None if src is None or dst is None else (src, dst)


def _located(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    return fs.FileSystem.from_uri(path)


class EdgeListReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [x for x in options.get("paths", options.get("path", "")).split(",") if x]
        self.size = int(options.get("splitbytes", SPLIT_BYTES))

    def _files(self) -> Iterator[tuple[str, int]]:
        for path in self.paths:
            system, inner = _located(path)
            info = system.get_file_info(inner)
            if info.type == fs.FileType.File:
                yield path, info.size
            elif info.type == fs.FileType.Directory:
                for x in sorted(system.get_file_info(fs.FileSelector(inner)), key=lambda x: x.path):
                    if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")):
                        yield path.rstrip("/") + "/" + x.base_name, x.size
            # A file that is not there is skipped.

    def partitions(self) -> list[Split]:
        return [Split(path, at, min(size, at + self.size)) for path, size in self._files() for at in range(0, size, self.size)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        system, inner = _located(split.path)
        graph = unquote(re.sub(r"\.csv$", "", inner.rsplit("/", 1)[-1]))
        src, dst = [], []

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([graph] * len(src), pa.string()), pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["graph_id", "src", "dst"])
            src.clear()
            dst.clear()
            return batch

        with system.open_input_file(inner) as raw:
            raw.seek(max(0, split.start - 1))
            with pa.BufferedInputStream(raw, 1 << 20) as file:
                place = max(0, split.start - 1)
                first = split.start > 0  # the rest of a line that began before, or its end alone
                for line in _lines(file):
                    begun, place = place, place + len(line)
                    if first:
                        first = False
                        continue
                    if begun >= split.end:
                        break
                    found = edge_of(line)
                    if found:
                        src.append(found[0])
                        dst.append(found[1])
                        if len(src) == BATCH_ROWS:
                            yield made()
        yield made()


def _lines(file) -> Iterator[bytes]:
    """Lines with their ends."""
    rest = b""
    while block := file.read(1 << 20):
        lines = (rest + block).split(b"\n")
        rest = lines.pop()
        yield from (x + b"\n" for x in lines)
    if rest:
        yield rest


class EdgeListSource(DataSource):
    """Options: ``path`` or ``paths`` (comma-separated files or folders), ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return "edge_list"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> EdgeListReader:
        return EdgeListReader({k.lower(): x for k, x in self.options.items()})


def load_edges(spark: SparkSession, paths: str | list[str], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Clean edges of files or folders; those that are missing are skipped."""
    spark.dataSource.register(EdgeListSource)
    joined = paths if isinstance(paths, str) else ",".join(paths)
    arcs = spark.read.format("edge_list").option("paths", joined).option("splitBytes", split_bytes).load()
    return canonical_edges(arcs).select(*EDGE_KEY)
