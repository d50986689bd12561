import random
import re

import numpy as np
import pytest

from bytesift.functions import kernels
from bytesift.functions.spec import SpecError, TargetSpec
from bytesift.operators import csvscan, prefix, scan
from bytesift.operators.csvscan import Dialect
from bytesift.plans import registry


def spec(**groups):
    b = TargetSpec.builder()
    for name, chars in groups.items():
        b.codepoints(name, chars)
    return b.build()


def hits(content: bytes, s: TargetSpec):
    pos, ids = kernels.scan(np.frombuffer(content, dtype=np.uint8), s)
    return [(p, s.names()[i]) for p, i in zip(pos.tolist(), ids.tolist())]


def test_golden_line():
    s = TargetSpec.builder().codepoints("gap", " \t").codepoints("slash", "/").codepoints("hash", "#").range("figure", "0", "9").build()
    got = hits(b"mi/2 #7\tto 9/a".ljust(40, b"\0"), s)
    assert got == [(2, "slash"), (3, "figure"), (4, "gap"), (5, "hash"), (6, "figure"), (7, "gap"), (10, "gap"), (11, "figure"), (12, "slash")]


def test_every_byte_and_code_points():
    assert hits(bytes(range(256)), spec(comma=",", stop=".")) == [(44, "comma"), (46, "stop")]
    s = TargetSpec.builder().codepoint("a", "é").codepoint("b", "ĩ").codepoint("c", "™").codepoint("d", "😀").build()
    assert hits("éĩ™😀é".encode(), s) == [(0, "a"), (2, "b"), (4, "c"), (7, "d"), (11, "a")]
    assert hits(b"\0" * 10 + b"\xe2\x84\0", s) == [] and hits(b"", s) == []


def test_bad_specs():
    b = TargetSpec.builder
    for bad in (lambda: b().build(), lambda: b().codepoints("x", 0xE9).build(), lambda: b().codepoint("x", 0xD800).build(), lambda: b().range("r", 9, 3).build(), lambda: b().codepoints("x", "a").codepoints("y", "a").build(), lambda: b().codepoints("x", "a").codepoints("x", "b").build(), lambda: b().codepoints("x", "a").codepoints("y", "b").options(max_literals=1).build()):
        with pytest.raises(SpecError):
            bad()
    assert b().codepoints("x", "a").range("y", "a", "b").options(on_overlap="first").build().table()[97] == 1


def test_prefix_kernels():
    assert kernels.prefix_xor(np.array([0, 1, 0]), 1)[0].tolist() == [1, 0, 0]
    assert kernels.prefix_sum(np.array([1, -1, 1, -1]))[0].tolist() == [1, 0, 1, 0]
    assert kernels.prefix_sum(np.array([1, 1, 1]), clamp=(0, 2))[0].tolist() == [1, 2, 2]
    assert kernels.shift_right(np.arange(5), 3).tolist() == [0, 0, 0, 0, 1]
    assert kernels.utf8_class(np.frombuffer("aé™😀".encode(), dtype=np.uint8)).tolist() == [1, 2, 0, 3, 0, 0, 4, 0, 0, 0]


def test_strategies_agree_with_regex(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice('ab,."é™😀\n 12') for _ in range(rng.randrange(60))) for _ in range(80)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(3)
    s = TargetSpec.builder().codepoints("sign", ",.").codepoints("quote", '"').codepoint("e", "é").codepoint("tm", "™").codepoint("s", "😀").range("digit", "0", "9").build()
    want = {(k, len(t[: m.start()].encode())) for k, t in enumerate(texts) if t for m in re.finditer('[,."é™😀0-9]', t)}
    rows = {x: {(r.k, r.pos, r.name) for r in scan.find(df, "text", s, keys=["k"], strategy=x).collect()} for x in ("arrow", "sql")}
    assert rows["arrow"] == rows["sql"] and {(k, p) for k, p, _ in rows["arrow"]} == want
    quoted = {x: {(r.k, r.pos) for r in scan.find(df, "text", s, keys=["k"], strategy=x, quote_filter="quote").collect()} for x in ("arrow", "sql")}
    assert quoted["arrow"] == quoted["sql"] < want
    assert {r.k: r.n_matches for r in scan.count(df, "text", s, keys=["k"]).collect()} == {k: len([1 for a, _ in want if a == k]) for k in range(len(texts))}
    with pytest.raises(SpecError):
        scan.find(df, "text", s, keys=["k"], quote_filter="none")


@pytest.mark.parametrize("name", sorted(registry.CSV_CASES))
def test_csv_cases(name):
    content, dialect, want = registry.CSV_CASES[name]
    data = content.encode()
    row, col, start, end, quoted = kernels.csv_fields(np.frombuffer(data, dtype=np.uint8), ord(dialect.delimiter), ord(dialect.quote))
    got: list = [[] for _ in range(int(row.max(initial=-1)) + 1)]
    for r, s, e, q in zip(row, start, end, quoted):
        got[r].append(kernels.unescape(data[s:e], q, ord(dialect.quote)).decode())
    assert got == want


def test_fields_of_many_buffers():
    rng = random.Random(8)
    for _ in range(2000):
        buffers = [bytes(rng.choice(b'ab,"\n\r') for _ in range(rng.randrange(9))) for _ in range(rng.randrange(5))]
        ends = np.cumsum([len(b) for b in buffers]).astype(np.int64) if buffers else np.zeros(0, dtype=np.int64)
        got = [tuple(map(int, f)) for f in zip(*kernels.csv_fields_of(np.frombuffer(b"".join(buffers), dtype=np.uint8), ends, 44, 34))]
        want = []
        for n, b in enumerate(buffers):  # byte by byte
            base, row, col, start, inside = int(ends[n]) - len(b), 0, 0, 0, False
            i = 0
            while i < len(b):
                if b[i] == 34:
                    inside = not inside
                elif not inside and b[i] in (44, 10, 13):
                    want.append((n, row, col, base + start, base + i, int(start < i and b[start] == 34)))
                    row, col = (row, col + 1) if b[i] == 44 else (row + 1, 0)
                    i += b[i : i + 2] == b"\r\n"
                    start = i + 1
                i += 1
            if start < len(b) or col:
                want.append((n, row, col, base + start, base + len(b), int(start < len(b) and b[start] == 34)))
        assert got == want


def test_large_buffer_and_bad_bytes(spark):
    body = b'12,"a ""b"" c",\xff\n' * 60_000
    df = spark.createDataFrame([(1, bytes(body)), (2, b"")], "k int, c binary")
    got = csvscan.fields(df, "c", keys=["k"]).groupBy("col", "value").count().collect()
    assert sorted((r.col, r.value, r["count"]) for r in got) == [(0, "12", 60_000), (1, 'a "b" c', 60_000), (2, "\ufffd", 60_000)]
    assert csvscan.rows(df, "c", keys=["k"]).count() == 60_000


def test_filters(spark):
    from bytesift.operators import filters

    df = spark.createDataFrame([(1, 'a,"b,c",d'), (2, ",,"), (3, "none")], "k int, text string")
    s = spec(comma=",", quote='"')
    find = lambda f: [(r.k, r.pos) for r in scan.find(df, "text", s, keys=["k"], match_filter=f).collect()]
    assert find(filters.QuoteFilter("quote")) == [(1, 1), (1, 2), (1, 6), (1, 7), (2, 0), (2, 1)]
    assert find(filters.Both(filters.QuoteFilter("quote"), filters.EveryNth(2))) == [(1, 1), (1, 6), (2, 0)]
    assert find(filters.NoFilter()) == [(r.k, r.pos) for r in scan.find(df, "text", s, keys=["k"]).collect()]
    with pytest.raises(SpecError):
        find(filters.QuoteFilter("other"))
    with pytest.raises(ValueError):
        scan.find(df.withColumnRenamed("k", "name"), "text", s, keys=["name"])


def test_csv_edges(spark):
    df = spark.createDataFrame([(1, b""), (2, None), (3, b"a,b")], "k int, c binary")
    assert [(r.k, r.fields) for r in csvscan.rows(df, "c", keys=["k"]).collect()] == [(3, ["a", "b"])]
    with pytest.raises(SpecError):
        Dialect(delimiter='"')


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_files_in_ranges_equal_whole(spark, tmp_path, size):
    from bytesift.sources import csv_files

    rng = random.Random(size)
    content = "".join(rng.choice(['a', ',', '"', '\n', '\r\n', '\r', 'xyz', '"",', '"q\n,"']) for _ in range(60)).encode()
    path = tmp_path / "f.csv"
    path.write_bytes(content)
    row, col, start, end, quoted = kernels.csv_fields(np.frombuffer(content, dtype=np.uint8), 44, 34)
    want = list(zip(row.tolist(), col.tolist(), start.tolist(), end.tolist()))
    got = [(r.row, r.col, r.start, r.end) for r in csv_files.read_fields(spark, [str(path)], range_bytes=size).collect()]
    assert sorted(got) == want
    if size == 1000:
        csv_files.register(spark)
        assert spark.read.format("csvscan").load(str(path)).count() == len(want)


def test_stream_equals_whole(spark, tmp_path):
    from bytesift.streaming.carry import find_in_stream

    text = 'ab "x{é}" {1 {™} "}" } é™'
    data = text.encode()
    s = TargetSpec.builder().codepoints("quote", '"').codepoints("open", "{").codepoints("close", "}").codepoint("e", "é").codepoint("tm", "™").build()
    parts = [("s", i, data[a : a + 3]) for i, a in enumerate(range(0, len(data), 3))]
    random.Random(1).shuffle(parts)
    schema = "stream_id string, seq long, data binary"
    spark.createDataFrame(parts, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = find_in_stream(stream, s, quote="quote", opening="open", closing="close").writeStream.format("memory").queryName("found").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.pos, r.name) for r in spark.sql("select * from found").collect())
    assert got == hits(data, s)
    assert spark.sql("select max(depth) d from found").first().d == 2


def test_fit_plane(spark):
    from bytesift.functions.stats import fit_plane

    df = spark.createDataFrame([(float(a), float(b), 2 + 3.0 * a - b) for a in range(5) for b in range(4)], "a double, b double, y double")
    got = fit_plane(df, "y", ["a", "b"])
    assert [round(got[k], 6) for k in ("intercept", "a", "b", "r2")] == [2, 3, -1, 1]


def test_chunks_equal_whole(spark):
    from pyspark.sql import functions as F

    bits = [random.Random(5).randrange(2) for _ in range(50)]
    rows = [(1, i // 7, i % 7, b) for i, b in enumerate(bits)]
    df = spark.createDataFrame(rows, "k int, seq int, pos int, b int")
    got = [r.state for r in prefix.chunk_scan(df, F.col("b"), ["k"], xor=True).orderBy("seq", "pos").collect()]
    assert got == kernels.prefix_xor(np.array(bits))[0].tolist()
