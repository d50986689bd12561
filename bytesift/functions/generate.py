"""Buffers for benchmarks: bytes with a set share of targets, and CSV. Each row is made from the seed and its own number, where it is needed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_LETTERS = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", dtype=np.uint8)


def byte_buffer(rng: np.random.Generator, size: int, targets: bytes, density: float, wide: str = "") -> bytes:
    """size bytes: a byte is one of targets with probability density, a letter otherwise; characters of wide replace some letters (and may add a few bytes)."""
    hit = rng.random(size) < density
    out = np.where(hit, rng.choice(np.frombuffer(targets, dtype=np.uint8), size), rng.choice(_LETTERS, size)).astype(np.uint8)
    if not wide:
        return out.tobytes()
    return "".join(c if c != "z" else wide[i % len(wide)] for i, c in enumerate(out.tobytes().decode())).encode()


def csv_buffer(rng: np.random.Generator, rows: int, columns: int, quoted: float, length: int, numeric: float, crlf: bool) -> bytes:
    """rows lines of so many columns: a field is a number, or letters of which some are quoted with a delimiter and a doubled quote inside."""
    end, kinds, sizes = b"\r\n" if crlf else b"\n", rng.random((rows, columns)), rng.integers(1, 2 * length, (rows, columns))
    out = []
    for kind, size in zip(kinds.tolist(), sizes.tolist(), strict=True):
        line = []
        for k, n in zip(kind, size, strict=True):
            if k < numeric:
                line.append(b"%d" % (n * 7919 % 10 ** min(n, 9)))
            elif k < numeric + quoted * (1 - numeric):
                line.append(b'"' + b"x" * (n // 2) + b',""' + b"y" * (n - n // 2) + b'"')
            else:
                line.append(b"w" * n)
        out.append(b",".join(line))
    return end.join([*out, b""])


def _rows(spark: SparkSession, n: int, seed: int, make) -> DataFrame:
    def run(batches):
        for batch in batches:
            for i in batch["id"].to_pylist():
                yield pa.RecordBatch.from_pydict({"id": [i], "content": [make(np.random.default_rng([seed, i]))]}, pa.schema([("id", pa.int64()), ("content", pa.binary())]))

    return spark.range(n).mapInArrow(run, "id long, content binary")


def byte_buffers(spark: SparkSession, n: int, size: int, targets: bytes, density: float, *, wide: str = "", seed: int = 1) -> DataFrame:
    """id, content: n buffers of byte_buffer()."""
    return _rows(spark, n, seed, lambda rng: byte_buffer(rng, size, targets, density, wide))


def csv_buffers(spark: SparkSession, n: int, rows: int, columns: int, *, quoted: float = 0.2, length: int = 10, numeric: float = 0.3, crlf: bool = False, seed: int = 1) -> DataFrame:
    """id, content: n buffers of csv_buffer()."""
    return _rows(spark, n, seed, lambda rng: csv_buffer(rng, rows, columns, quoted, length, numeric, crlf))
