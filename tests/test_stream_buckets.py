"""Streams are worked on by bucket: calls of the state function follow the buckets, not the streams; results stay those of each stream alone."""

import random

import numpy as np
import pytest

from bytesift.functions import kernels
from bytesift.functions.spec import TargetSpec
from bytesift.streaming import carry

SCHEMA = "stream_id string, seq long, data binary"
SPEC = TargetSpec.builder().codepoints("quote", '"').codepoints("open", "{").codepoints("close", "}").codepoint("e", "é").codepoint("tm", "™").codepoint("s", "😀").build()


def want(data: bytes):
    pos, ids = kernels.scan(np.frombuffer(data, dtype=np.uint8), SPEC)
    inside = depth = 0
    out = []
    for p, i in zip(pos.tolist(), ids.tolist()):
        inside ^= int(i == 1)
        depth += 0 if inside else (i == 2) - (i == 3)
        out.append((p, i, inside, depth))
    return out


def run(spark, path, batches, name, **options):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(path))
    q = carry.find_in_stream(stream, SPEC, quote="quote", opening="open", closing="close", **options).writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    found = {}
    for r in spark.table(name).collect():
        found.setdefault(r.stream_id, []).append((r.pos, r.lit, r.inside, r.depth))
    return {k: sorted(v) for k, v in found.items()}


@pytest.mark.parametrize("buckets,block", [(1, 1 << 20), (3, 8)])
def test_many_streams_in_few_buckets(spark, tmp_path, monkeypatch, buckets, block):
    monkeypatch.setattr(carry, "_BLOCK", block)
    rng = random.Random(buckets)
    texts = {f"s{i}": "".join(rng.choice('a"{}é™😀') for _ in range(rng.randrange(1, 40))).encode() + b"." for i in range(60)}
    chunks = [(k, n, data[a : a + 3]) for k, data in texts.items() for n, a in enumerate(range(0, len(data), 3))]
    rng.shuffle(chunks)  # chunks come early, in three batches, and characters are cut in two
    third = len(chunks) // 3 + 1
    got = run(spark, tmp_path / "in", [chunks[a : a + third] for a in range(0, len(chunks), third)], f"many{buckets}", buckets=buckets)
    assert got == {k: w for k, data in texts.items() if (w := want(data))}


def test_missing_chunk_is_told(spark, tmp_path):
    from pyspark.errors import StreamingQueryException

    with pytest.raises(StreamingQueryException, match="chunk 0 is missing"):
        run(spark, tmp_path / "in", [[("x", 1, b"a"), ("x", 2, b"b"), ("y", 0, b"c")]], "missing", max_early=1, buckets=1)
