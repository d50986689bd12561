"""The sql strategy needs no shuffle, and gives what arrow gives."""

import random

import pytest

from bytesift.functions.spec import TargetSpec
from bytesift.operators import scan

SPEC = TargetSpec.builder().codepoints("nul", "\0\x7f]^\\-").codepoints("quote", "\"'").codepoint("e", "é").codepoint("tm", "™").codepoint("s", "😀").range("digit", "0", "9").codepoint("pad", 0x80).build()
WIDE_QUOTE = TargetSpec.builder().codepoints("sign", ",.").codepoint("quote", "™").codepoint("e", "é").build()


def frame(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab\0\x7f]^\\-\"'é™😀ĩÿ\x80Ā日\n\r 12") for _ in range(rng.randrange(50))) for _ in range(200)] + ["", None, '"', "'", "a\"b'", "™"]
    return spark.createDataFrame([(k % 7, t) for k, t in enumerate(texts)], "k int, text string").repartition(3)  # keys repeat


@pytest.mark.parametrize("spec", [SPEC, WIDE_QUOTE])
@pytest.mark.parametrize("quote", [None, "quote"])
def test_sql_equals_arrow_without_a_shuffle(spark, spec, quote):
    df = frame(spark).localCheckpoint()
    sql, arrow = (scan.find(df, "text", spec, keys=["k"], quote_filter=quote, strategy=x) for x in ("sql", "arrow"))
    assert sql.dtypes == arrow.dtypes
    want = sorted(map(tuple, arrow.collect()))
    assert want and sorted(map(tuple, sql.collect())) == want
    plan = sql._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
