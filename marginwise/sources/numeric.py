"""A Spark data source for header-less files of numbers whose width is not known beforehand."""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "numbers"
RANGE_BYTES = 64 << 20
READ_BYTES = 4 << 20
BATCH_LINES = 20_000


@dataclass
class ByteRange(InputPartition):
    """The lines of a file that begin in [begin, end)."""

    file: str
    begin: int
    end: int


class NumericSource(DataSource):
    """(file, at, x): every line as an array of numbers, with the byte at which it begins.

    Options: ``path`` (a file or folder), ``sep`` (default a comma), ``range_bytes``. Files are planned as
    byte ranges, so one large file is read by many tasks and in one pass. An empty cell is NULL, a blank line is
    left out, a cell that is no number is an error that names its place.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "file string, at bigint, x array<double>"

    def reader(self, schema) -> DataSourceReader:
        return NumericReader(self.options)


class NumericReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.sep = options["path"], options.get("sep", ",").encode()
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))

    def _locate(self) -> tuple[fs.FileSystem, str]:
        if "://" not in self.path and not self.path.startswith("file:"):
            return fs.LocalFileSystem(), self.path
        return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", self.path))

    def partitions(self) -> list[ByteRange]:
        system, path = self._locate()
        found = system.get_file_info(path)
        files = [found] if found.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
        shown = [f for f in files if f.is_file and not f.base_name.startswith(("_", "."))]
        return [
            ByteRange(f.path, begin, min(f.size, begin + self.range_bytes))
            for f in sorted(shown, key=lambda f: f.path)
            for begin in range(0, f.size, self.range_bytes)
        ]

    def _lines(self, part: ByteRange) -> Iterator[tuple[int, bytes]]:
        """The lines that begin in the range; the last one may end beyond it."""
        system, _ = self._locate()
        with system.open_input_file(part.file) as file:
            # A line begins where the byte before is a line feed.
            at = max(part.begin - 1, 0)
            file.seek(at)
            held, skipping = b"", part.begin > 0
            while True:
                block = file.read(READ_BYTES)
                pieces = (held + block).split(b"\n")
                # Without more bytes the last piece is a line as well.
                held = pieces.pop() if block else b""
                for piece in pieces:
                    if skipping:
                        skipping = False
                    elif at >= part.end:
                        return
                    else:
                        yield at, piece
                    at += len(piece) + 1
                if not block or (at >= part.end and not skipping):
                    return

    def read(self, partition: ByteRange | None) -> Iterator[pa.RecordBatch]:
        # Without any range Spark asks once, for nothing.
        if partition is None:
            return
        starts, rows = [], []

        def batch() -> pa.RecordBatch:
            columns = [pa.array([partition.file] * len(rows)), pa.array(starts, pa.int64()), pa.array(rows, pa.list_(pa.float64()))]
            return pa.RecordBatch.from_arrays(columns, names=["file", "at", "x"])

        for at, line in self._lines(partition):
            line = line.strip()
            if not line:
                continue
            try:
                rows.append([float(c) if (c := cell.strip()) else None for cell in line.split(self.sep)])
            except ValueError as error:
                raise ValueError(f"{partition.file}, byte {at}: {error}") from None
            starts.append(at)
            if len(rows) == BATCH_LINES:
                yield batch()
                starts, rows = [], []
        if rows:
            yield batch()


def register(spark: SparkSession) -> None:
    """Makes ``spark.read.format("numbers")`` known to the session."""
    spark.dataSource.register(NumericSource)
