"""SQL: SELECT ... FROM t, LATERAL scan_bytes(t.text, 'comma=,;digits=0..9'), and scalar functions, after register(spark).

Targets are written name=characters, a range as name=a..b, separated by semicolons; a single character beyond ASCII is a code point.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import kernels
from .spec import SpecBuilder, TargetSpec


@lru_cache(maxsize=256)
def parse_spec(text: str) -> TargetSpec:
    b = SpecBuilder()
    for part in text.split(";"):
        name, _, chars = part.partition("=")
        if len(chars) == 4 and chars[1:3] == "..":
            b.range(name, chars[0], chars[3])
        elif len(chars) == 1 and ord(chars) > 0x7F:
            b.codepoint(name, chars)
        else:
            b.codepoints(name, chars)
    return b.build()


class _ScanBytes:
    def eval(self, content: str, targets: str):
        if content is None:
            return
        spec = parse_spec(targets)
        names = spec.names()
        data = content if isinstance(content, (bytes, bytearray)) else content.encode("utf-8")
        pos, ids = kernels.scan(np.frombuffer(bytes(data), dtype=np.uint8), spec)
        for p, i in zip(pos.tolist(), ids.tolist(), strict=True):
            yield p, i, names[i]


def register(spark: SparkSession) -> None:
    spark.udtf.register("scan_bytes", udtf(_ScanBytes, returnType="pos bigint, lit int, name string"))
