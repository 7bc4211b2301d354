"""Flat files of fixed records as a data source: ``flat_records``.

A record is so many values of one little-endian number type, with no header or separator. Reading cuts every file into byte ranges
aligned to records, so a file of any length is read by many tasks, each holding BATCH records at a time; ``row`` is a record's number in
its file. Writing gives a folder with a file for each value of ``part``; files take their names only when the whole write succeeded, so a
lost executor leaves no file that is read.

Files are opened by path on driver and executors alike: a folder that all of them mount. What only Spark reaches is read whole by
``tables.read_quintuples`` instead.
"""

from __future__ import annotations

import glob
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Records in memory at once, and bytes of a byte range.
BATCH, RANGE = 1 << 16, 64 << 20
#: Number types by the names that schemas use.
KINDS = {"double": "<f8", "float": "<f4", "int": "<i4", "long": "<i8"}


def local(path: str) -> str:
    return path.removeprefix("file://").replace("//", "/") if path.startswith("file:") else path


class FlatRecords(DataSource):
    """Options: path (a file or folder), columns (comma-separated), kind (double), range (bytes of a task)."""

    @classmethod
    def name(cls) -> str:
        return "flat_records"

    def _columns(self) -> list[str]:
        return [c.strip() for c in self.options["columns"].split(",")]

    def schema(self) -> str:
        kind = {"long": "bigint"}.get(self.options.get("kind", "double"), self.options.get("kind", "double"))
        return "file string, row long, " + ", ".join(f"{c} {kind}" for c in self._columns())

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, self._columns())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, self._columns())


@dataclass
class _Span(InputPartition):
    path: str
    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.columns = local(options["path"]), columns
        self.kind = np.dtype(KINDS[options.get("kind", "double")])
        self.width = self.kind.itemsize * len(columns)
        self.step = max(1, int(options.get("range", RANGE)) // self.width)

    def partitions(self) -> list[_Span]:
        files = sorted(p for p in glob.glob(f"{self.path}/*") if not os.path.basename(p).startswith(("_", "."))) if os.path.isdir(self.path) else [self.path]
        spans = []
        for f in files:
            size = os.path.getsize(f)
            if size % self.width:
                raise ValueError(f"{f}: {size} bytes aren't whole records of {self.width}")
            n = size // self.width
            spans += [_Span(f, a, min(n, a + self.step)) for a in range(0, n, self.step)]
        return spans

    def read(self, partition: _Span) -> Iterator[pa.RecordBatch]:
        with open(partition.path, "rb") as f:
            f.seek(partition.first * self.width)
            for at in range(partition.first, partition.last, BATCH):
                n = min(BATCH, partition.last - at)
                values = np.frombuffer(f.read(n * self.width), self.kind).reshape(n, len(self.columns))
                cells = [pa.array(np.ascontiguousarray(values[:, i])) for i in range(len(self.columns))]
                names = pa.array([os.path.basename(partition.path)] * n)
                yield pa.RecordBatch.from_arrays([names, pa.array(np.arange(at, at + n)), *cells], ["file", "row", *self.columns])


@dataclass
class _Wrote(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.columns = local(options["path"]), columns
        self.kind = np.dtype(KINDS[options.get("kind", "double")])
        os.makedirs(self.path, exist_ok=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Wrote:
        """A task's rows in a file for each value of ``part``, which the rows are ordered by."""
        files: list[tuple[str, str]] = []
        part, out = None, None
        for batch in iterator:
            parts = batch.column("part").to_numpy()
            cells = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in self.columns]).astype(self.kind)
            edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for a, b in zip(edges, edges[1:]):
                if a < b and parts[a] != part:
                    part = parts[a]
                    if out:
                        out.close()
                    files.append((f"{self.path}/.{uuid.uuid4().hex}", f"{self.path}/part-{part:010d}.bin"))
                    out = open(files[-1][0], "wb")  # noqa: SIM115
                if a < b:
                    out.write(cells[a:b].tobytes())
        if out:
            out.close()
        return _Wrote(files)

    def commit(self, messages: list[_Wrote | None]) -> None:
        for made, name in (f for m in messages if m for f in m.files):
            os.replace(made, name)

    def abort(self, messages: list[_Wrote | None]) -> None:
        for made, _ in (f for m in messages if m for f in m.files):
            if os.path.exists(made):
                os.remove(made)


def read_records(spark: SparkSession, path: str, columns: list[str], kind: str = "double", span: int = RANGE) -> DataFrame:
    """(file, row, columns) of a flat file or of a folder's."""
    spark.dataSource.register(FlatRecords)
    return spark.read.format("flat_records").options(path=path, columns=",".join(columns), kind=kind, range=span).load()


def write_records(rows: DataFrame, path: str, columns: list[str], index: str, per_file: int, kind: str = "double") -> None:
    """Rows in the order of ``index`` (dense, from 0) in files of ``per_file`` records, so that a file's number and a record's place in it
    are the index. Files are dealt by range and sorted each for itself."""
    rows.sparkSession.dataSource.register(FlatRecords)
    files = rows.withColumn("part", F.floor(F.col(index) / per_file)).select(index, "part", *columns)
    dealt = files.repartition("part").sortWithinPartitions(index).select("part", *columns)
    dealt.write.format("flat_records").mode("append").options(path=path, columns=",".join(columns), kind=kind).save()


def permuted(index: Column, shape: list[int], axes: list[int]) -> Column:
    """Place of a cell of an array in row-major order after its axes are put in another order: axes[k] is the old axis at place k."""
    strides, s = [], 1
    for n in reversed(shape):
        strides.insert(0, s)
        s *= n
    out = F.lit(0).cast("long")
    for axis in axes:
        out = out * shape[axis] + F.floor(index / strides[axis]) % shape[axis]
    return out
