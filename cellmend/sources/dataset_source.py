"""Data sets as a format that Spark reads: ``spark.read.format("cellmend")`` after ``register``.

The schema comes from the data set's ``discrete_cols.json``, before any row is read. A file is read in byte ranges; whether a range begins
inside a quoted value, and how many records come before it, are told by an index with a row for each range, which ``index_ranges`` has made
by a job over the ranges. So a range needs its own bytes only, and the end of its last record. Only the asked columns of the asked variant
are handed on.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

from cellmend.operators.stats import MARKER
from cellmend.sources.tables import _OPENS, _STAYS, NA_TOKENS, data_path

#: Bytes of a range, and records of a batch.
RANGE, BATCH = 64 << 20, 4096


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "/", path))


def _lines(path: str, start: int, end: int | None) -> Iterator[str]:
    """The lines, with their ends, that begin at ``start`` or later (in a line: after it) and before ``end``."""
    system, name = _open(path)
    with system.open_input_file(name) as f:
        f.seek(max(0, start - 1))
        left, at = b"", max(0, start - 1)
        skip = start > 0  # the rest of the line that holds the byte before the range
        while True:
            block = f.read(1 << 20)
            parts = (left + block).split(b"\n")
            left = parts.pop()
            for part in parts:
                if not skip:
                    if end is not None and at >= end:
                        return
                    yield part.decode() + "\n"
                skip, at = False, at + len(part) + 1
            if not block:
                if left and not skip and (end is None or at < end):
                    yield left.decode()
                return


def _ends_inside(line: str, inside: bool) -> bool:
    """Whether a line ends inside a quoted value, from whether it begins inside of one."""
    if '"' not in line:
        return inside
    return bool(re.match(_STAYS if inside else _OPENS, line.removesuffix("\n")))


def _starts(lines: Iterator[str], inside: bool) -> tuple[int, bool]:
    """Records that begin among the lines, and whether the last line ends inside a value."""
    n = 0
    for line in lines:
        n += not inside and line.strip("\r\n") != ""
        inside = _ends_inside(line, inside)
    return n, inside


def _files(path: str) -> list[tuple[str, int]]:
    """The files of a path, which may be a folder of parts, by name, with their sizes."""
    system, name = _open(path)
    if system.get_file_info(name).type != fs.FileType.Directory:
        return [(path, system.get_file_info(name).size)]
    parts = [i for i in system.get_file_info(fs.FileSelector(name)) if i.is_file and i.base_name[0] not in "._"]
    return [(f"{path.rstrip('/')}/{i.base_name}", i.size) for i in sorted(parts, key=lambda i: i.base_name)]


def index_ranges(spark: SparkSession, path: str, size: int = RANGE) -> list[tuple[str, int, int, bool, int, int]]:
    """``(file, start, end, inside, first, rows)`` of each range: whether its first line begins inside a value, the records before it in
    its file, and the rows of the files before."""
    ranges = [(f, s, min(s + size, length)) for f, length in _files(path) for s in range(0, length, size)]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for f, s, e in batch[["file", "start", "end"]].itertuples(index=False, name=None):
                (n0, e0), (n1, e1) = (_starts(_lines(f, s, e), inside) for inside in (False, True))
                rows.append((f, s, e, n0, e0, n1, e1))
            yield pd.DataFrame(rows, columns=["file", "start", "end", "n0", "e0", "n1", "e1"])

    if not ranges:
        return []
    asked = spark.createDataFrame(ranges, "file string, start long, end long").repartition(min(len(ranges), 10_000))
    found = asked.mapInPandas(scan, "file string, start long, end long, n0 long, e0 boolean, n1 long, e1 boolean").collect()  # a row for each range
    out, last, inside, first, rows = [], None, False, 0, 0
    for r in sorted(found):
        if r["file"] != last:
            rows += max(0, first - 1)
            last, inside, first = r["file"], False, 0
        out.append((r["file"], r["start"], r["end"], inside, first, rows))
        first, inside = first + (r["n1"] if inside else r["n0"]), r["e1"] if inside else r["e0"]
    return out


class Range(InputPartition):
    def __init__(self, file: str, start: int, end: int, inside: bool, first: int, rows: int):
        self.file, self.start, self.end, self.inside, self.first, self.rows = file, start, end, inside, first, rows


class DatasetReader(DataSourceReader):
    def __init__(self, columns: list[str], marker: str, ranges: list[list]):
        self.columns, self.marker, self.ranges = columns, marker, ranges

    def partitions(self) -> list[Range]:
        return [Range(*r) for r in self.ranges]

    def _records(self, part: Range) -> Iterator[str]:
        """The records that begin in the range; its last one to the end, wherever that is."""
        inside, record, begun = part.inside, "", not part.inside
        lines = chain(_lines(part.file, part.start, part.end), ((None, x) for x in _lines(part.file, part.end, None)))
        for item in lines:
            beyond, line = isinstance(item, tuple), item[1] if isinstance(item, tuple) else item
            if beyond and not inside:
                break
            was, inside = inside, _ends_inside(line, inside)
            if not was:
                begun = True
            if begun:
                record += line
                if not inside:
                    if record.strip("\r\n"):
                        yield record
                    record = ""
        if record.strip("\r\n"):
            yield record

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        head = next(self._records(Range(part.file, 0, 1, False, 0, 0)), "")
        names = next(csv.reader([head.removeprefix("﻿").rstrip("\r\n")]), [])
        if lacking := [c for c in self.columns if head and c not in names]:
            raise ValueError(f"{part.file} lacks {', '.join(lacking)}")
        at, missing = [names.index(c) for c in self.columns] if head else [], set(NA_TOKENS)
        row, ids, cells = part.first, [], [[] for _ in self.columns]

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(c, pa.string()) for c in cells]], names=["row_id", *self.columns])

        for record in self._records(part):
            if row > 0:  # the first record of the file is its header
                values = next(csv.reader(io.StringIO(record.rstrip("\r\n"), newline="")))
                ids.append(part.rows + row - 1)
                for c, i in zip(cells, at):
                    v = values[i] if i < len(values) else ""
                    c.append(self.marker if v in missing else v)
            row += 1
            if len(ids) == BATCH:
                yield batch()
                ids, cells = [], [[] for _ in self.columns]
        if ids:
            yield batch()


class Dataset(DataSource):
    """Options: ``root``, ``dataset``, ``kind`` (dirty or clean), ``variant``, ``columns`` (some of the data set's, as JSON), ``marker``, and
    ``ranges`` (of ``index_ranges``, as JSON; without it the file is one range)."""

    @classmethod
    def name(cls) -> str:
        return "cellmend"

    def _columns(self) -> list[str]:
        system, path = _open(f"{self.options['root']}/{self.options['dataset']}/discrete_cols.json")
        with system.open_input_stream(path) as f:
            known = json.loads(f.read())
        asked = json.loads(self.options["columns"]) if "columns" in self.options else known
        if unknown := [c for c in asked if c not in known]:
            raise ValueError(f"the data set has no column {', '.join(unknown)}")
        return asked

    def schema(self) -> StructType:
        return StructType([StructField("row_id", LongType()), *[StructField(c, StringType()) for c in self._columns()]])

    def reader(self, schema: StructType) -> DatasetReader:
        path = f"{data_path(self.options['root'], self.options['dataset'], self.options.get('variant'))}/{self.options.get('kind', 'dirty')}.csv"
        if "ranges" in self.options:
            ranges = json.loads(self.options["ranges"])
        elif len(files := _files(path)) == 1:
            ranges = [[*files[0][:1], 0, files[0][1], False, 0, 0]]
        else:
            raise ValueError("files of several parts need ranges; use read_dataset")
        return DatasetReader([f.name for f in schema.fields if f.name != "row_id"], self.options.get("marker", MARKER), ranges)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Dataset)


def read_dataset(spark: SparkSession, root: str, dataset: str, kind: str = "dirty", variant: str | None = None, columns: list[str] | None = None, size: int = RANGE, marker: str = MARKER) -> DataFrame:
    """``row_id`` and the columns as strings, missing values as the marker, of a data set's file, read in ranges of ``size`` bytes."""
    register(spark)
    path = f"{data_path(root, dataset, variant)}/{kind}.csv"
    options = {"root": root, "dataset": dataset, "kind": kind, "marker": marker, "ranges": json.dumps(index_ranges(spark, path, size))}
    options |= ({"variant": variant} if variant else {}) | ({"columns": json.dumps(columns)} if columns else {})
    return spark.read.format("cellmend").options(**options).load()
