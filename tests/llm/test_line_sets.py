"""The exact comparison of lines.py, and its bitmaps, against brute force; arrays of hashes are made before they are gathered."""

import random


def shingles(text, n=5):
    return {text[k : k + n] for k in range(max(1, len(text) - n + 1))}


def test_sets_are_exact_and_made_before_the_aggregation(spark):
    from bytesift.llm import lines as L

    rng = random.Random(21)
    texts = ["".join(rng.choice("abcdé😀") for _ in range(k)) for k in (1, 4, 5, 6, 20, 35, 36, 37, 68, 69, 400)]
    texts += [t[:-3] + "##" + t[-1:] for t in texts] + ["ab" * 300, "ab" * 200 + "c"]
    pairs = [(x, y) for x in range(len(texts)) for y in range(x)]
    sets = [shingles(t) for t in texts]
    want = {(x, y) for x, y in pairs if len(sets[x] & sets[y]) >= L.SIMILARITY * len(sets[x] | sets[y])}
    assert len(want) > 5
    lines = spark.createDataFrame(list(enumerate(texts)), "node long, line string")
    found = L.verified(L.OF_LINES, spark.createDataFrame(pairs, "x long, y long"), lines)
    assert {(r.x, r.y) for r in found.collect()} == want
    gathered = [n for n in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "collect_list(" in n]
    assert gathered and not any("xxhash64(" in n or "array(" in n for n in gathered)  # they were: interpreted, a boxed number at a time

    maps = {r.node: r for r in L._bitmaps(L.OF_LINES, lines).collect()}
    assert [maps[k].n for k in range(len(texts))] == [len(s) for s in sets]
    for x, y in want:
        bits = sum(((maps[x][f"w{w}"] ^ maps[y][f"w{w}"]) & (1 << 64) - 1).bit_count() for w in range(L.WORDS))
        assert bits <= len(sets[x] ^ sets[y])
