"""The sets of a pair are held against each other once, and similarities of exactly 0.8 link."""


def test_common_shingles_are_counted_once_and_ties_link(spark):
    from bytesift.llm import lines as L

    # 4 k common shingles of 5 k (0.8 exactly), and of 5 k + 1
    letters = [chr(0x4E00 + k) for k in range(400)]
    rows, want = [], set()
    for k in range(4, 40):
        same = "".join(letters[: 4 * k + 4])  # 4 k shingles
        rows += [(3 * k, same), (3 * k + 1, same + "".join(letters[200 : 200 + k])), (3 * k + 2, same + "".join(letters[200 : 201 + k]))]
        want.add((3 * k, 3 * k + 1))
    pairs = [(x, x + d) for x, _ in want for d in (1, 2)]
    lines = spark.createDataFrame(rows, "node long, line string")
    found = L.verified(L.OF_LINES, spark.createDataFrame(pairs, "x long, y long"), lines)
    assert {(r.x, r.y) for r in found.collect()} == want
    assert found._jdf.queryExecution().optimizedPlan().toString().count("array_intersect(") == 1  # a filter that named it twice made it twice
