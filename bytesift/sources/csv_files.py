"""CSV files of any size, in byte ranges that are parsed side by side.

Whether a range begins inside quotes depends on all quotes before it. A first pass counts, per range, its quotes and the rows that
begin in it for either state; a running sum over the ranges of a file gives every range's state and first row number.
The second pass parses each range: a row belongs to the range in which it begins, and is read past the range's end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import kernels
from ..operators.csvscan import Dialect, field_texts

RANGE_BYTES = 64 << 20
#: bytes read past a range's end at first
_TAIL = 1 << 14


def _open(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        system, inner = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path)
        return system.open_input_file(inner)
    return fs.LocalFileSystem().open_input_file(path)


def _row_starts(data: np.ndarray, dialect: Dialect, carry: int, at_begin: bool, more: bool) -> np.ndarray:
    """Where rows begin in data, whose first byte is at state carry; more: further bytes follow."""
    pos, tok, _ = kernels.csv_tokens(data, ord(dialect.delimiter), ord(dialect.quote), carry)
    end = pos[tok >= kernels.LF]
    kind = tok[tok >= kernels.LF]
    pair = (kind == kernels.CR) & (end + 1 < len(data)) & (data[np.minimum(end + 1, len(data) - 1)] == 10)
    starts = (end + 1)[~pair]
    starts = starts[starts < len(data)] if not more else starts
    return np.concatenate(([0], starts)) if at_begin and len(data) else starts


def _ranges(spark: SparkSession, paths: list[str], size: int) -> tuple[DataFrame, int]:
    """(a row per range, the number of partitions that they are dealt to): RANGE_BYTES to a partition, and less as long as there are cores without any."""
    rows = []
    for path in paths:  # lengths alone
        with _open(path) as f:
            total = f.size()
        rows.append((path, max(1, -(-total // size)), total))
    n_ranges, n_bytes = sum(r[1] for r in rows), sum(r[2] for r in rows)
    n = max(1, min(n_ranges, max(2 * spark.sparkContext.defaultParallelism, -(-n_bytes // RANGE_BYTES))))
    files = spark.createDataFrame(rows, "path string, n long, total long").select("path", "total", F.explode(F.expr("sequence(0, cast(n - 1 as int))")).alias("part"))
    start = F.col("part").cast("long") * size
    return files.select("path", "part", start.alias("start"), F.least("total", start + size).alias("stop"), "total").repartition(n), n


def _counts(dialect: Dialect):
    def run(batches):
        for batch in batches:
            out = []
            for path, part, start, stop, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with _open(path) as f:
                    lead = int(start > 0)
                    f.seek(start - lead)
                    data = np.frombuffer(f.read(stop - start + lead + 1), dtype=np.uint8)
                begin = []
                quotes = int((data[lead : lead + stop - start] == ord(dialect.quote)).sum())
                first = int(lead and data[0] == ord(dialect.quote))
                for state in (0, 1):
                    s = _row_starts(data, dialect, state ^ first, not lead, stop < total) - lead + start
                    begin.append(int(((s >= start) & (s < stop)).sum()))
                out.append((path, part, start, stop, total, quotes, *begin))
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "part", "start", "stop", "total", "quotes", "rows0", "rows1"), r, strict=True)) for r in out], schema=pa.schema([("path", pa.string()), ("part", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("total", pa.int64()), ("quotes", pa.int64()), ("rows0", pa.int64()), ("rows1", pa.int64())]))

    return run


_FIELDS = "path string, row long, col int, start long, end long, quoted boolean, value string"
_ROWS = "path string, row long, fields array<string>"


def _body(path: str, start: int, stop: int, total: int, state: int, dialect: Dialect) -> tuple[bytes, int]:
    """(the bytes of all rows that begin in the range, where in the file they begin)."""
    with _open(path) as f:
        lead, step = int(start > 0), _TAIL
        f.seek(start - lead)
        raw = f.read(min(stop - start + lead + 1, total - start + lead))
        data = np.frombuffer(raw, dtype=np.uint8)
        at, first = start - lead, int(lead and len(data) and data[0] == ord(dialect.quote))
        begin = _row_starts(data, dialect, state ^ first, not lead, at + len(raw) < total) + at
        beyond = begin[(begin >= stop) & (begin < at + len(raw))]
        inside = (state ^ first ^ int((data == ord(dialect.quote)).sum())) & 1
        tails = [raw]
        while not len(beyond) and at + len(raw) < total:  # read on until a row begins at the range's end or later; the last byte is looked at again, for CR LF
            at += len(raw) - 1
            raw = raw[-1:] + f.read(min(step, total - at - 1))
            data = np.frombuffer(raw, dtype=np.uint8)
            inside ^= int(data[0] == ord(dialect.quote))
            beyond = _row_starts(data, dialect, inside, False, at + len(raw) < total) + at
            beyond = beyond[(beyond >= stop) & (beyond < at + len(raw))]
            inside = (inside ^ int((data == ord(dialect.quote)).sum())) & 1
            tails.append(raw[1:])
            step *= 2
        raw = b"".join(tails)
    mine = begin[(begin >= start) & (begin < stop)]
    if not len(mine):
        return b"", start
    return raw[int(mine[0]) - start + lead : int(beyond[0]) - start + lead if len(beyond) else len(raw)], int(mine[0])


def _parse(path: str, start: int, stop: int, total: int, state: int, first_row: int, dialect: Dialect) -> Iterator[pa.RecordBatch]:
    body, base = _body(path, start, stop, total, state, dialect)
    data = np.frombuffer(body, dtype=np.uint8)
    row, col, s, e, quoted = kernels.csv_fields(data, ord(dialect.delimiter), ord(dialect.quote))
    shift = 1 if dialect.header else 0
    for i in range(0, len(row), 1 << 16):
        c = slice(i, i + (1 << 16))
        values = field_texts(data, s[c], e[c], quoted[c], dialect)
        yield pa.RecordBatch.from_arrays([pa.array([path] * len(values)), pa.array(row[c] + first_row - shift), pa.array(col[c].astype(np.int32)), pa.array(s[c] + base), pa.array(e[c] + base), pa.array(quoted[c]), values], names=["path", "row", "col", "start", "end", "quoted", "value"])


def _parse_rows(path: str, start: int, stop: int, total: int, state: int, first_row: int, dialect: Dialect) -> Iterator[pa.RecordBatch]:
    body, _ = _body(path, start, stop, total, state, dialect)
    data = np.frombuffer(body, dtype=np.uint8)
    row, col, s, e, quoted = kernels.csv_fields(data, ord(dialect.delimiter), ord(dialect.quote))
    first = np.flatnonzero(col == 0)
    bounds = np.concatenate((first, [len(row)]))
    for i in range(0, len(first), 1 << 13):
        to = min(len(first), i + (1 << 13))
        c = slice(int(bounds[i]), int(bounds[to]))
        lists = pa.ListArray.from_arrays(pa.array((bounds[i : to + 1] - bounds[i]).astype(np.int32)), field_texts(data, s[c], e[c], quoted[c], dialect))
        yield pa.RecordBatch.from_arrays([pa.array([path] * (to - i)), pa.array(row[first[i:to]] + first_row - int(dialect.header)), lists], names=["path", "row", "fields"])


def _planned(spark: SparkSession, paths: list[str], dialect: Dialect, range_bytes: int) -> tuple[DataFrame, int]:
    """(path, start, stop, total, state, first_row of every range, the number of partitions to parse them in)."""
    ranges, n = _ranges(spark, paths, range_bytes)
    counted = ranges.mapInArrow(_counts(dialect), "path string, part int, start long, stop long, total long, quotes long, rows0 long, rows1 long")
    before = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    stated = counted.withColumn("state", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).cast("int"))
    stated = stated.withColumn("rows", F.when(F.col("state") == 1, F.col("rows1")).otherwise(F.col("rows0")))
    return stated.withColumn("first_row", F.coalesce(F.sum("rows").over(before), F.lit(0))).select("path", "start", "stop", "total", "state", "first_row"), n


def _read(spark: SparkSession, paths: list[str], dialect: Dialect, range_bytes: int, parse, schema: str) -> DataFrame:
    planned, n = _planned(spark, paths, dialect, range_bytes)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                yield from parse(r["path"], r["start"], r["stop"], r["total"], r["state"], r["first_row"], dialect)

    return planned.repartition(n).mapInArrow(run, schema)


def read_fields(spark: SparkSession, paths: list[str], *, dialect: Dialect = Dialect(), range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, row, col, start, end (bytes in the file), quoted, value of every field; a header counts as row -1. An empty file has no row.

    Files are read in ranges of range_bytes, which are dealt out evenly: the number of tasks follows the input's bytes, however few the files or small the ranges."""
    return _read(spark, paths, dialect, range_bytes, _parse, _FIELDS)


def read_rows(spark: SparkSession, paths: list[str], *, dialect: Dialect = Dialect(), range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, row, fields (array of values) of every row, without the header, each made where its bytes are read."""
    return _read(spark, paths, dialect, range_bytes, _parse_rows, _ROWS).where("row >= 0")


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class CsvScanSource(DataSource):
    """spark.read.format("csvscan").option("delimiter" | "quote" | "header", ...).load(path): one partition per file (path may name several, comma-separated); for files too large for
    one task use read_fields()."""

    @classmethod
    def name(cls) -> str:
        return "csvscan"

    def schema(self) -> str:
        return _FIELDS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = options["path"].split(",")
        self.dialect = Dialect(options.get("delimiter", ","), options.get("quote", '"'), str(options.get("header", "false")).lower() == "true", options.get("compat", "lossless"))

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition):
        with _open(partition.path) as f:
            total = f.size()
        yield from _parse(partition.path, 0, total, total, 0, 0, self.dialect)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CsvScanSource)
