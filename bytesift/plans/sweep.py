"""Throughput sweeps: python -m bytesift.plans.sweep [gigabytes] [file for JSON lines]; tabulate() turns those lines into a table.

Buffers are generated, written once as Parquet and scanned from there: what is timed is a whole query, start-up and decoding included.
"""

from __future__ import annotations

import json
import shutil
import sys
import tempfile
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import generate
from ..functions.spec import TargetSpec
from ..operators import csvscan, scan

TARGETS = b",.;:!?()[]{}<>|/+*=&%$#@"
_BUFFER = 1 << 20


def _spec(n: int) -> TargetSpec:
    b = TargetSpec.builder()
    for i in range(n):
        b.codepoints(f"t{i}", chr(TARGETS[i]))
    return b.build()


def _timed(run) -> tuple[float, int]:
    best, rows = float("inf"), 0
    for _ in range(2):  # the first run is the warm-up
        start = time.perf_counter()
        rows = run()
        best = min(best, time.perf_counter() - start)
    return best, rows


def scans(spark: SparkSession, folder: str, gigabytes: float, targets=(1, 4, 8, 24), densities=(0.01, 0.1, 0.3)) -> Iterator[dict]:
    """One result per number of targets and density: matches are counted where they are found."""
    n = max(1, round(gigabytes * 1e9 / _BUFFER))
    for density in densities:
        path = f"{folder}/bytes-{density}"
        generate.byte_buffers(spark, n, _BUFFER, TARGETS, density).write.parquet(path)
        data = spark.read.parquet(path)
        for k in targets:
            spec = _spec(k)
            s, found = _timed(lambda: scan.totals(data, "content", spec).agg(F.sum("n_matches")).first()[0] or 0)
            yield {"bench": "scan", "targets": k, "density": density, "gb": n * _BUFFER / 1e9, "seconds": round(s, 3), "gb_per_s": round(n * _BUFFER / 1e9 / s, 4), "matches": found}


def csv(spark: SparkSession, folder: str, gigabytes: float, columns=(4, 16), quoted=(0.0, 0.3)) -> Iterator[dict]:
    """One result per number of columns and share of quoted fields: the sizes of all fields are summed."""
    for width in columns:
        for share in quoted:
            path = f"{folder}/csv-{width}-{share}"
            generate.csv_buffers(spark, max(1, round(gigabytes * 1e9 / (2000 * width * 9))), 2000, width, quoted=share).write.parquet(path)
            data = spark.read.parquet(path)
            gb = data.agg(F.sum(F.octet_length("content"))).first()[0] / 1e9
            s, fields = _timed(lambda: csvscan.field_sizes(data, "content", keys=["id"]).agg(F.sum("n_fields")).first()[0])
            yield {"bench": "csv", "columns": width, "quoted": share, "gb": gb, "seconds": round(s, 3), "gb_per_s": round(gb / s, 4), "fields": fields}


def tabulate(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of scans() as a table: a row per density, a column of GB/s per number of targets; DataFrame.write.csv(sep="\\t") makes it a TSV file."""
    lines = spark.read.schema("bench string, targets int, density double, gb_per_s double").json(path)
    return lines.where("bench = 'scan'").groupBy("density").pivot("targets").agg(F.max("gb_per_s")).orderBy("density")


def main(gigabytes: float = 1.0, out: str | None = None) -> None:
    spark = SparkSession.builder.master("local[*]").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.mkdtemp(prefix="bytesift-sweep-")
    try:
        lines = [json.dumps(x) for x in (*scans(spark, folder, gigabytes), *csv(spark, folder, gigabytes))]
    finally:
        shutil.rmtree(folder)
    print("\n".join(lines))
    if out:
        with open(out, "w") as f:
            f.write("\n".join(lines) + "\n")


if __name__ == "__main__":
    main(*[float(sys.argv[1])] if sys.argv[1:] else [], *sys.argv[2:3])
