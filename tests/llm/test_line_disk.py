"""What lines.py writes for each line, and that bands dealt out in turns are all there."""

import random
from collections import defaultdict


def test_signatures_are_short_and_no_band_is_left_out(spark, docs_of):
    from bytesift.llm import lines as L

    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(300)]
    rows = []
    for i in range(40):
        line = [rng.choice(words) for _ in range(20)]
        rows.append((3 * i, " ".join(line)))
        for k in (1, 2):
            other = list(line)
            other[rng.randrange(20)] = "changed"
            rows.append((3 * i + k, " ".join(other)))
    table = L.materialize(L.signatures(L.OF_LINES, L.lines_of(docs_of(rows)).select("a1", "a2", "line")), "signatures")
    assert sum(8 if kind == "bigint" else 4 for _, kind in table.dtypes) <= 64  # 35 places of eight bytes each were 304

    buckets = defaultdict(list)
    for r in table.collect():
        for j, band in enumerate(L.BANDS):
            buckets[j, tuple(r[f"s{m // L._PACKED}"] >> 8 * (m % L._PACKED) & 255 for m in band)].append(r.node)
    buckets = [sorted(b) for b in buckets.values() if len(b) > 1]
    assert len(buckets) > 300 and L.BANDS_AT_ONCE < len(L.BANDS)
    firsts, members = L._buckets(table)
    assert sorted((r.x, r.y) for r in firsts.collect()) == sorted((b[0], b[-1]) for b in buckets)
    found = defaultdict(list)
    for r in members.collect():
        found[r.key, r.first].append(r.node)
    assert sorted((first, sorted(b)) for (_, first), b in found.items()) == sorted((b[0], b) for b in buckets if len(b) > 2)
