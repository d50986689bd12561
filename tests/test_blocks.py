"""What Python makes of an Arrow batch is bounded by bytes, not by the rows that Spark puts into a batch."""

import tracemalloc

import numpy as np
import pyarrow as pa

from bytesift.functions import kernels
from bytesift.functions.spec import TargetSpec
from bytesift.operators import csvscan, scan

LETTERS = TargetSpec.builder().codepoints("low", "abcdefgh").codepoint("e", "é").build()
TEXTS = [b"abc\xc3", b"\xa9,d", b"", None, b"x" * 50, "éa".encode(), b'1,"a,b"\n', b""]


def ran(df_operator, table):
    """The rows that the function handed to mapInArrow() makes of one batch."""
    kept = {}

    class Frame:
        schema = {"k": type("C", (), {"dataType": type("T", (), {"simpleString": staticmethod(lambda: "int")})})}

        def where(self, *_):
            return self

        select = groupBy = agg = where

        def mapInArrow(self, run, schema):
            kept["run"] = run
            return self

    df_operator(Frame())
    return kept["run"](iter([table]))


def peak(rows) -> int:
    tracemalloc.start()
    try:
        for _ in rows:
            pass
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_strung_gives_every_row_once():
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(TEXTS, pa.binary())], names=["k", "d"])
    for part in (batch, batch.slice(2), batch.slice(3, 3)):
        want = [(k, v) for k, v in zip(*(c.to_pylist() for c in part.columns)) if v is not None]
        for size in (1, 5, 1000):
            got = []
            for rows, data, ends in kernels.strung(part, 1, size):
                begins = [0, *ends[:-1].tolist()]
                got += [(k, data[a:b].tobytes()) for k, a, b in zip(rows.columns[0].to_pylist(), begins, ends.tolist(), strict=True)]
                assert len(data) <= size or rows.num_rows == 1
            assert got == want


def test_find_and_fields_by_blocks_equal_whole(spark, monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array(range(8), pa.int32()), pa.array(TEXTS, pa.binary())], names=["k", "__data"])
    find = lambda: [r for b in scan._arrow(LETTERS, None, 1)(iter([batch])) for r in b.to_pylist()]
    fields = lambda: [r for b in ran(lambda df: csvscan._rows(df, "k", ["k"], csvscan.Dialect()), batch) for r in b.to_pylist()]
    whole = find(), fields()
    assert [(r["k"], r["pos"], r["name"]) for r in whole[0]] == [(0, 0, "low"), (0, 1, "low"), (0, 2, "low"), (1, 2, "low"), (5, 0, "e"), (5, 2, "low"), (6, 3, "low"), (6, 5, "low")]
    monkeypatch.setattr(kernels, "BLOCK", 3)
    assert (find(), fields()) == whole


def texts():
    rng = np.random.default_rng(1)
    return [bytes(rng.integers(97, 105, 4000, dtype=np.uint8)) for _ in range(4000)]  # 16 MB of matches in one batch


def keyed(values):
    return pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values, pa.binary())], names=["k", "__data"])


def test_memory_of_find():
    assert peak(scan._arrow(LETTERS, None, 1)(iter([keyed(texts())]))) < 80e6


def test_memory_of_totals(spark):
    spec = TargetSpec.builder().codepoints("low", "abcdefgh").build()
    assert peak(ran(lambda df: scan.totals(df, "__data", spec), keyed(texts()).select(["__data"]))) < 20e6


def test_memory_of_csv_rows_and_fields(spark):
    commas = keyed([b"ab," * 1300 + b"\n"] * 4000)
    for operator in (csvscan._rows, csvscan.fields):
        assert peak(ran(lambda df, f=operator: f(df, "k", keys=["k"], dialect=csvscan.Dialect()), commas)) < 160e6
