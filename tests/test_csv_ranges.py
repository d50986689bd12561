"""Small ranges do not make a task each, and rows that reach far past their range come back whole."""

import random

import numpy as np
import pytest

from bytesift.functions import kernels
from bytesift.operators.csvscan import Dialect
from bytesift.sources import csv_files


def test_tasks_follow_bytes(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_bytes(b'1,"a\nb"\r\n' * 5000)
    planned, n = csv_files._planned(spark, [str(path)], Dialect(), 100)
    assert n == 2 * spark.sparkContext.defaultParallelism
    ranges = sorted((r.start, r.stop) for r in planned.collect())
    assert ranges == [(a, a + 100) for a in range(0, 45_000, 100)]
    assert csv_files.read_rows(spark, [str(path)], range_bytes=100).where("fields = array('1', 'a\\nb')").count() == 5000


@pytest.mark.parametrize("tail", [1, 2, 5])
def test_bodies_join_to_the_file(tmp_path, monkeypatch, tail):
    monkeypatch.setattr(csv_files, "_TAIL", tail)
    rng = random.Random(tail)
    path = str(tmp_path / "f.csv")
    for _ in range(150):
        content = "".join(rng.choice(["a", ",", '"', "\n", "\r\n", "\r", "xyz", '"q\n,"']) for _ in range(rng.randrange(40))).encode()
        with open(path, "wb") as f:
            f.write(content)
        data = np.frombuffer(content, dtype=np.uint8)
        for size in (1, 3, 8):
            parts = []
            for start in range(0, max(1, len(content)), size):
                state = content[:start].count(b'"') % 2
                body, base = csv_files._body(path, start, min(start + size, len(content)), len(content), state, Dialect())
                assert body == content[base : base + len(body)]
                _, _, s, e, _ = kernels.csv_fields(np.frombuffer(body, dtype=np.uint8), 44, 34)
                parts += [(int(a) + base, int(b) + base) for a, b in zip(s, e)]
            want = kernels.csv_fields(data, 44, 34)
            assert parts == list(zip(want[2].tolist(), want[3].tolist()))
